"""Token planes, prefix BPE and cached counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, documents, empty, odd_texts
from tokenizers import Tokenizer

from tenuria.llm import prefix_bpe, queries, token_counts, token_planes
from tenuria.llm.frames import tokenizer_file, utf8
from tenuria.llm.wordmemo import WordMemo, library_memo, special_tokens

CONFIG = tokenizer_file()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(CONFIG)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def strange(n, seed):
    rng = random.Random(seed)
    parts = [*"aZ'stmdrevl 0123 \t\n\r\x1c\x1f\x85\xa0é×÷ªµº²½«»¿—’ Жф中\U0001f600ß.,!?-_ˈ́", "<|endoftext|>", "'re", "'ll", " 's", "  ", "don't"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["library", "prefix"])
def test_words_of_any_characters(library, kind):
    texts = strange(3000, 5) + [t or "" for t in odd_texts()]
    memo = library_memo(CONFIG) if kind == "library" else prefix_bpe.coder(CONFIG)[0]
    ids, n = memo.encode(*utf8(pa.array(texts)))
    ends = np.cumsum(n)
    for text, end, k in zip(texts, ends, n, strict=True):
        assert ids[end - k : end].tolist() == ids_of(library, text), repr(text)


def test_memo_forgets_and_stays_exact(library):
    inner = prefix_bpe.PrefixBpe(CONFIG)
    memo = WordMemo(inner.words, special_tokens(CONFIG), slots_log2=4, most_ids=50)
    for text in strange(200, 6):
        assert memo.encode(*utf8(pa.array([text])))[0].tolist() == ids_of(library, text)


def test_prefix_bpe_on_long_words(library):
    rng = random.Random(2)
    bpe = prefix_bpe.PrefixBpe(CONFIG)
    for alphabet in ("ab", "the", "aaaa", "etaoinshrdlu"):
        word = "".join(rng.choice(alphabet) for _ in range(400))
        assert bpe.word(word.encode()) == ids_of(library, word)


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_planes_round_trip(layout):
    for values in ([0], [1, 2, 3], [50256] * 9, [2**31, 7, 0], list(range(0, 70000, 7))):
        ids = np.array(values, np.uint32)
        assert (token_planes.from_planes(token_planes.to_planes(ids, layout), len(ids), layout) == ids).all()


@pytest.mark.parametrize("layout,block", [("byte", 64), ("bit", 1 << 16)])
def test_file_of_documents(spark, tmp_path, library, layout, block):
    texts = odd_texts()
    ids = list(range(len(texts)))
    ids[5] = ids[6] = 4
    path = str(tmp_path / "planes")
    token_planes.write_planes(documents(spark, texts, ids), path, CONFIG, block=block, layout=layout, parts=3)
    rows = sorted(token_planes.read_planes(spark, path).collect(), key=lambda r: r.start)
    want = sorted(zip(ids, [t or "" for t in texts], strict=True))
    at = 0
    for row, (doc_id, text) in zip(rows, want, strict=True):
        expected = np.array([*ids_of(library, text), 0], "<u4")
        assert (row.doc_id, row.start, bytes(row.ids)) == (doc_id, at, expected.tobytes())
        at += len(expected)


def test_rows_of_one_id_are_dealt_out(spark, tmp_path, library):
    texts = [f"{k} text {k * k}" for k in range(400)]
    ids = [None if k % 4 else k for k in range(400)]
    path = str(tmp_path / "planes")
    token_planes.write_planes(documents(spark, texts, ids), path, CONFIG, parts=8)
    rows = sorted(token_planes.read_planes(spark, path).collect(), key=lambda r: r.start)
    want = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == [(d, np.array([*ids_of(library, t), 0], "<u4").tobytes()) for d, t in want]
    held = spark.read.parquet(path).selectExpr("part", "explode(doc_ids) AS d").where("d is null").groupBy("part").count().collect()
    assert len(held) >= 4 and max(r["count"] for r in held) <= 120


def test_empty_tables(spark, tmp_path):
    token_planes.write_planes(empty(spark), str(tmp_path / "p"), CONFIG)
    assert token_planes.read_planes(spark, str(tmp_path / "p")).count() == 0
    assert prefix_bpe.encode_decode(empty(spark), CONFIG).count() == 0
    assert token_counts.token_counts(empty(spark), str(tmp_path / "c"), CONFIG).count() == 0


def test_encode_decode(spark, library):
    texts = odd_texts()
    rows = prefix_bpe.encode_decode(documents(spark, texts), CONFIG).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == ids_of(library, texts[r.doc_id])
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_counts_are_cached_by_content(spark, tmp_path, library):
    cache, texts = str(tmp_path / "cache"), odd_texts()
    texts += texts[:20]
    for part in (texts[:30], texts, texts):
        rows = token_counts.token_counts(documents(spark, part), cache, CONFIG, limit=10).collect()
        for r in rows:
            n = len(ids_of(library, part[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((part[r.doc_id] or "").encode()), n, n > 10)
        assert len(rows) == len(part)
        held = spark.read.parquet(cache)
        assert held.count() == held.select("digest").distinct().count() == len({t or "" for t in part})


def test_queries(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {d: ids_of(library, t) for d, t in texts.items()}
    one = {r.doc_id: r for r in queries.op1_token_planes(spark, SMALL).collect()}
    at = 0
    for d in sorted(ids):
        raw = np.array([*ids[d], 0], "<u4")
        assert (one[d].start, one[d].n_tokens, one[d].ids_crc32) == (at, len(raw), zlib.crc32(raw.tobytes()))
        at += len(raw)
    for r in queries.op3_prefix_bpe(spark, SMALL).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in queries.op5_token_counts(spark, SMALL).collect():
        assert (r.n_tokens, r.over_limit) == (len(ids[r.doc_id]), len(ids[r.doc_id]) > 512)
