"""Token ids of whole texts: split into words by array operations, each distinct word is encoded once and remembered.

A byte-level BPE merges only inside the words of its split pattern, so ids of a text are those of its words in turn.
The memory of words is bounded; a word that was pushed out is encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from tenuria.llm.frames import ranges, span_hashes

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LETTER, NUMBER, OTHER, SPACE, RARE = range(5)

#: Classes of bytes; two-byte letters up to U+02AF and U+0400..U+047F count byte by byte. RARE: the text is split by PATTERN.
BYTES = np.full(256, OTHER, np.uint8)
BYTES[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCB), 0xD0, 0xD1]] = LETTER
BYTES[48:58] = NUMBER
BYTES[[9, 10, 11, 12, 13, 32]] = SPACE
BYTES[[0xCB, *range(0xCC, 0xD0), *range(0xD2, 0x100)]] = RARE

#: Second bytes after 0xC2.
LATIN = np.full(256, OTHER, np.uint8)
LATIN[[0xAA, 0xB5, 0xBA]] = LETTER
LATIN[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
LATIN[[0x85, 0xA0]] = RARE


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Splitter:
    """Starts of words, for the texts of a block at once."""

    def __init__(self, specials: list[str]):
        import regex

        self.pattern = regex.compile(PATTERN)
        self.specials = specials
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    def exact(self, text: str) -> list[int]:
        """Byte offsets of the words of one text, special tokens as words of their own."""
        out, at = [], 0
        parts, done = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [(text[done : m.start()], False), (m.group(), True)]
            done = m.end()
        for part, special in [*parts, (text[done:], False)]:
            for word in [part] if special else self.pattern.findall(part):
                out.append(at)
                at += len(word.encode())
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = int(offsets[-1])
        if not n:
            return np.zeros(0, np.int64)
        b = data[:n]
        start = np.zeros(n + 4, bool)
        kind = BYTES[b]
        p = np.flatnonzero(b == 0xC2)
        kind[p] = kind[p + 1] = LATIN[b[p + 1]]
        p = np.flatnonzero(b == 0xC3)
        p = p[(b[p + 1] == 0x97) | (b[p + 1] == 0xB7)]
        kind[p] = kind[p + 1] = OTHER
        p = np.flatnonzero(b == 0xE2)
        if len(p):
            p = p[(b[p + 1] == 0x80) & (b[p + 2] >= 0x8B) & (b[p + 2] <= 0xBE) & ~np.isin(b[p + 2], (0xA8, 0xA9, 0xAF))]
            kind[p] = kind[p + 1] = kind[p + 2] = OTHER
        first, full = np.zeros(n + 1, bool), np.diff(offsets) > 0
        first[offsets[:-1][full]] = True
        # A word starts where the kind changes, but a single space before it belongs to it; of white space before
        # a word, the last character stands apart.
        space = kind == SPACE
        start[1:n] = np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & (b[:-1] != 32))
        before = space[:-1] & ~space[1:] & ~first[1:n]
        start[:-5][before] = True
        start[:n] |= first[:n]
        # An apostrophe that starts a word takes the letters of a contraction with it.
        p = np.flatnonzero(b == 39)
        p = p[start[p]]
        if len(p):
            end = offsets[np.searchsorted(offsets, p, side="right")]
            one, two = data[p + 1], data[p + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (p + 1 < end)
            long = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & (p + 2 < end)
            for q, e, k in ((p[short], end[short], 2), (p[long], end[long], 3)):
                start[q + 1] = False
                start[(q + k)[q + k < e]] = True
        rare = set(np.unique(np.searchsorted(offsets, np.flatnonzero(kind == RARE), side="right") - 1).tolist())
        whole = b.tobytes() if self.specials else b""
        for s in map(str.encode, self.specials):
            at = whole.find(s)
            while at >= 0:
                rare.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = whole.find(s, at + 1)
        for d in rare:
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            start[lo:hi] = False
            start[lo + np.array(self.exact(b[lo:hi].tobytes().decode("utf-8", "replace")), np.int64)] = True
        return np.flatnonzero(start[:n])


class WordMemo:
    """encode(words) gives the ids of each word. Words are recognised by two independent 64-bit hashes and never by one alone."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], specials: list[str], slots_log2: int = 20, most_ids: int = 1 << 23):
        self.encode_words, self.split = encode, Splitter(specials)
        self.shift, self.most = np.uint64(64 - slots_log2), most_ids
        size = 1 << slots_log2
        self.one, self.two = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at, self.n = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, and the number of them per text."""
        if self.used > self.most:
            self.one[:] = self.two[:] = 0
            self.used = 0
        starts = self.split.starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        lengths = np.diff(np.append(starts, offsets[-1]))
        one, two = span_hashes(data, starts, lengths)
        slot = one >> self.shift
        known = (self.one[slot] == one) & (self.two[slot] == two)
        at, count = self.at[slot], self.n[slot].astype(np.int64)
        if not known.all():
            miss = np.flatnonzero(~known)
            order = miss[np.lexsort((two[miss], one[miss]))]
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            rep = order[new]
            raw = data.tobytes()
            ids = self.encode_words([raw[s : s + n] for s, n in zip(starts[rep].tolist(), lengths[rep].tolist(), strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            base = self.add(np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum())))
            where = base + np.cumsum(n) - n
            group = np.cumsum(new) - 1
            at[order], count[order] = where[group], n[group]
            s = slot[rep]
            self.one[s], self.two[s] = one[rep], two[rep]
            # Two new words may share a slot: what the slot holds must be of one of them, whole.
            kept = (self.one[s] == one[rep]) & (self.two[s] == two[rep])
            self.at[s[kept]], self.n[s[kept]] = where[kept], n[kept]
        ids = self.pool[ranges(at, count)]
        ends = np.append(0, np.cumsum(count))
        words = np.searchsorted(starts, offsets)
        return ids, np.diff(ends[words])


_HELD: dict = {}


def library_memo(config: str) -> WordMemo:
    """A memo over the tokenizers library; kept while the Python worker lives."""
    if ("library", config) not in _HELD:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(config)
        tok.no_truncation()
        tok.no_padding()

        def encode(words: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

        _HELD["library", config] = WordMemo(encode, special_tokens(config))
    return _HELD["library", config]


def special_tokens(config: str) -> list[str]:
    """Added tokens of a byte-level file; other kinds of files or tokens are refused, as their splits differ."""
    d = json.loads(config)
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in d.get("added_tokens", []))
    pre = d.get("pre_tokenizer") or {}
    if d["model"]["type"] != "BPE" or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
    return [t["content"] for t in d.get("added_tokens", [])]
