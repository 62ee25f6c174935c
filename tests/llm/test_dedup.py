"""SimHash components and suffix levels against brute force."""

import re

import pytest
import xxhash
from helpers import SMALL, documents, empty, odd_texts

from tenuria.llm import queries, simhash, suffix_levels
from tenuria.llm.components import components


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    label = {i: i for i in range(len(marks))}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j][1]).bit_count() <= 3:
                label[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(marks):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(marks))]


def near_copies(texts):
    out = list(texts)
    for t in texts:
        if t and len(t.split()) > 30:
            out += [t, t + " tail", t.replace(" ", "  ", 2), t.upper()]
    return out


def test_components_of_odd_documents(spark):
    texts = near_copies(odd_texts())
    ids = [None if k % 17 == 3 else (k if k % 23 else 5) for k in range(len(texts))]
    got = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    marks = [(i, brute_fingerprint(t)) for i, t in zip(ids, texts, strict=True)]
    want = [(i, f, c) for (i, f), c in zip(marks, brute_components(marks), strict=True)]
    assert sorted(map(str, ((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got))) == sorted(map(str, want))
    assert len({c for _, _, c in want}) < len(want)


def test_links_at_each_distance(spark):
    base = 0x0123456789ABCDEF
    flips = [(), (0,), (1, 40), (2, 33, 63), (3, 4, 5), (0, 1, 2, 3), (31, 32, 33, 34), (5, 6, 40, 41, 42)]
    marks = [base ^ sum(1 << b for b in f) for f in flips]
    signed = [m - 2**64 if m >> 63 else m for m in marks]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.vertex: r.label for r in components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_simhash_empty_table_and_query(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    marks = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(marks, brute_components(marks), strict=True)}
    assert {tuple(r) for r in queries.op4_simhash(spark, SMALL).collect()} == want


def brute_cut(rows):
    """doc_id, removed bytes, number of runs, kept bytes; a null doc_id is larger than all."""
    big = 1 << 62
    rows = [(big if d is None else d, d, (t or "").encode()) for d, t in rows]
    least = {}
    for k, _, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("batches,block", [(1, 1 << 20), (3, 2000), (5, 600)])
def test_cut_of_odd_documents(spark, batches, block):
    texts = near_copies(odd_texts(seed=batches))
    texts = [t for t in texts if t is None or len(t) < 4000] + ["a" * n for n in (49, 50, 51, 300)] + ["ab" * 100, "ba" * 80]
    ids = [None if k % 19 == 3 else (k if k % 11 else 5) for k in range(len(texts))]
    cut = suffix_levels.remove_repeats(documents(spark, texts, ids), batches, block).collect()
    got = [(r.doc_id, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in cut]
    assert sorted(map(str, got)) == sorted(map(str, brute_cut(list(zip(ids, texts, strict=True)))))


def test_levels_merge_geometrically(spark):
    docs = documents(spark, ["word%d " % k * 30 for k in range(40)]).select("doc_id", "text")
    index = suffix_levels.SuffixLevels(spark, 100_000, batches=4, block_bytes=300)
    index.put(docs)
    held = []
    for k in range(4):
        index.add_batch(index.blocks().where(f"batch = {k}"))
        held.append(sorted(index.levels))
    assert held == [[0], [1], [0, 1], [2]]


def test_cut_text_has_whole_characters(spark):
    passage = "é" * 60
    rows = suffix_levels.remove_repeats(documents(spark, ["x" + passage, "ü" + passage + "ü"]), 2, text=True).collect()
    # The first byte of the last letter is that of the passage too, and is cut with it.
    assert {r.doc_id: r.text for r in rows} == {0: "x" + passage, 1: "ü"}


def test_cut_empty_table_and_query(spark):
    import hashlib

    assert suffix_levels.remove_repeats(empty(spark)).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, len((dict(rows)[d] or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for d, n, s, k in brute_cut(rows)}
    assert {tuple(r) for r in queries.op9_suffix_levels(spark, SMALL).collect()} == want
