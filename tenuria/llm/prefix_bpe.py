"""Exact BPE by dynamic programming over prefixes.

The BPE encoding of a string determines one last token for each of its prefixes. An automaton of the vocabulary reports,
at every position, all tokens that end there; the longest whose predecessor - the last token of the prefix before it - is
compatible with it is the prefix's last token. Following the back-pointers from the end gives the ids. Two tokens are
compatible if no merge of the rules crosses their border while each of them is built.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens inside a text get their own
id. Only the key and the text column are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenuria.llm.frames import ranges, slices, texts, utf8
from tenuria.llm.wordmemo import _HELD, WordMemo, byte_alphabet, special_tokens

NEVER = 1 << 60


class PrefixBpe:
    """Vocabulary, merge rules and automaton of one byte-level BPE file."""

    def __init__(self, config: str):
        import ahocorasick

        model = json.loads(config)["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = {t["content"].encode(): t["id"] for t in json.loads(config).get("added_tokens", [])}
        self.alphabet = byte_alphabet()
        self.letters = {b: c for b, c in enumerate(self.alphabet)}
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            made.setdefault(z, (r, x, y))
        self.made = made
        self.right, self.left = {}, {}
        self.fits: dict[int, bool] = {}
        # Tokens that no merge makes from their own bytes can't come out of BPE.
        usable = {t: s for s, t in vocab.items() if len(s) == 1 or t in made}
        self.automaton = ahocorasick.Automaton()
        for t, s in usable.items():
            self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.text = {t: bytes(self.bytes_of[c] for c in s) for t, s in usable.items()} | {t: s for s, t in self.specials.items()}

    def border(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one end of a token, smallest first, each with the rank of the merge that takes it up."""
        held = self.left if side == 1 else self.right
        if token not in held:
            out, taken, t = [], NEVER, token
            while True:
                out.append((t, taken))
                if t not in self.made:
                    break
                taken, t = self.made[t][0], self.made[t][side]
            held[token] = out[::-1]
        return held[token]

    def compatible(self, a: int, b: int) -> bool:
        """No merge crosses the border of a and b. Of equal ranks, the leftmost goes first."""
        key = a << 32 | b
        if key not in self.fits:
            left, right = self.border(a, 2), self.border(b, 1)
            i = j = 0
            fits = True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                crossing = self.rank.get((x, y), NEVER)
                if crossing < until_x and crossing <= until_y and crossing < NEVER:
                    fits = False
                    break
                if until_x == until_y == NEVER:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = fits
        return self.fits[key]

    def word(self, word: bytes) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        last, back = [0] * (len(word) + 1), [-1] * (len(word) + 1)
        back[0] = 0
        for end, (t, n) in self.automaton.iter("".join([self.letters[b] for b in word])):
            at = end + 1
            # Matches at one position come longest first; the first that fits is the only one.
            if back[at] < 0 and back[at - n] >= 0 and (at == n or self.compatible(last[at - n], t)):
                last[at], back[at] = t, at - n
        out, at = [], len(word)
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def words(self, words: list[bytes]) -> list[list[int]]:
        return [self.word(w) for w in words]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens, where each begins, and its length."""
        n = np.zeros(max(self.text) + 1, np.int64)
        for t, s in self.text.items():
            n[t] = len(s)
        flat = np.frombuffer(b"".join(self.text.get(t, b"") for t in range(len(n))), np.uint8)
        return flat, np.cumsum(n) - n, n


def coder(config: str) -> tuple[WordMemo, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Encoder and decoding table, kept while the Python worker lives."""
    if ("prefix", config) not in _HELD:
        bpe = PrefixBpe(config)
        _HELD["prefix", config] = WordMemo(bpe.words, special_tokens(config)), bpe.table()
    return _HELD["prefix", config]


def decode(ids: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    """Texts of consecutive runs of ids; bytes that are no UTF-8 become U+FFFD."""
    flat, at, n = table
    size = n[ids]
    raw = flat[ranges(at[ids], size)].tobytes()
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def encode_decode(docs: DataFrame, config: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ids (array of int), decoded (the text those ids stand for)."""
    held = docs.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = coder(held.value)
        for batch in batches:
            for some in slices(batch, text):
                ids, n = memo.encode(*utf8(some.column(1)))
                yield pa.RecordBatch.from_arrays([
                    some.column(0),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids.astype(np.int32))),
                    pa.array(decode(ids, n, table), pa.string()),
                ], [key, "ids", "decoded"])

    return texts(docs, key, text).mapInArrow(run, f"{key} long, ids array<int>, decoded string")
