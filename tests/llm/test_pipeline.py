"""Every stage against a brute-force version of its rule, on its own input."""

import corpus_pipeline
from helpers import SMALL, documents, empty, odd_texts
from test_dedup import brute_components, brute_cut, brute_fingerprint
from test_search import shingles
from tokenizers import Tokenizer

from tenuria.llm import string_kernel
from tenuria.llm.frames import table, tokenizer_file
from tenuria.session import stored


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = table(spark, SMALL, "documents")
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    before = by_id(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        after = by_id(docs)
        if name == "language_id":
            assert set(after) == {d for d, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "near_dedup":
            marks = [(d, brute_fingerprint(r.text)) for d, r in before.items()]
            assert set(after) == set(brute_components(marks))
        elif name == "passage_dedup":
            want = {d: k.decode("utf-8", "ignore") for d, _, _, k in brute_cut([(d, r.text) for d, r in before.items()])}
            assert {d: r.text for d, r in after.items()} == {d: t for d, t in want.items() if t.strip(" ")}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "decontamination":
            bad = {d for d, r in before.items() for i in items if 5 * len(shingles(i) & shingles(r.text)) >= 4 * len(shingles(i))}
            assert set(after) == set(before) - bad
        else:
            library = Tokenizer.from_str(tokenizer_file())
            assert {d: r.ids for d, r in after.items()} == {d: library.encode(r.text, add_special_tokens=False).ids for d, r in before.items()}
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before = after


def test_run_is_all_stages(spark):
    assert set(corpus_pipeline.run(spark, SMALL).columns) == {"doc_id", "n_tokens", "ids"}


def test_odd_and_empty_documents(spark):
    for docs in (documents(spark, odd_texts(), [None if k % 13 == 2 else k for k in range(len(odd_texts()))]), empty(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SMALL))
            assert docs.count() <= n
            n = docs.count()


PROSE = "the quick brown fox jumps over the lazy dog while seven grey geese fly south past old stone towers near quiet rivers and green hills".split()


def prose(seed, n=60):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randint(0, 99)) for _ in range(n))


def rows_without_ids(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_each_row_without_id_is_decided_alone(spark):
    item = table(spark, SMALL, "benchmark").where("text IS NOT NULL").first().text
    clean = [(None, prose(k), f"s{k}") for k in range(4)]
    docs = rows_without_ids(spark, [(None, f"{prose(50)} {item} {prose(51)}", "bad"), *clean, (7, prose(60), "s7")])
    kept = corpus_pipeline.decontamination(spark, docs, SMALL)
    assert sorted(r.source for r in kept.collect()) == ["s0", "s1", "s2", "s3", "s7"] and kept.columns == docs.columns


def test_one_row_of_each_group_without_ids_stays(spark):
    copies = [(None, prose(1), "a"), (None, prose(1).upper(), "a"), (None, prose(1), "a"), (None, prose(2), "b"), (None, prose(3), "c"), (5, prose(3), "five"), (9, prose(3), "nine")]
    kept = corpus_pipeline.near_dedup(spark, rows_without_ids(spark, copies), SMALL).collect()
    assert sorted(r.source for r in kept) == ["a", "b", "five"]


def test_rows_without_ids_keep_their_own_columns(spark):
    shared = prose(80)
    docs = rows_without_ids(spark, [(None, prose(k), f"s{k}") for k in range(5)] + [(None, shared, "x"), (None, shared, "x"), (2**62, prose(70), "s70")])
    kept = corpus_pipeline.passage_dedup(spark, docs, SMALL).collect()
    assert sorted((r.source, r.text) for r in kept) == sorted([(f"s{k}", prose(k)) for k in (*range(5), 70)] + [("x", shared)])
    keys = [r.row_key for r in corpus_pipeline.keyed(docs).collect()]
    assert sorted(keys) == list(range(2**62, 2**62 + 8))


def test_language_stage_predicts_the_labels(spark, monkeypatch):
    docs, seen, identify = table(spark, SMALL, "documents"), [], string_kernel.identify
    monkeypatch.setattr(string_kernel, "identify", lambda rows, model, **more: seen.append(identify(rows, model, **more)) or seen[0])
    corpus_pipeline.language_id(spark, docs, SMALL)
    pairs = [(r.lang, r.lang_pred) for r in seen[0].where("lang IS NOT NULL AND lang_pred <> 'und'").collect()]
    assert len({p for _, p in pairs}) > 1 and sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


def test_cut_characters_go_whole_and_none_is_made(spark):
    """The second document's first and last letter share a byte each with the first document's."""
    x = "x" * 48
    docs = spark.createDataFrame([(1, f"\u00a9{x}\u00e8", "en", "s", 50), (2, f"\u00e9{x}\u00e9 tail", "en", "s", 55)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(corpus_pipeline.passage_dedup(spark, docs, SMALL))
    assert got[1].text == f"\u00a9{x}\u00e8" and got[2].text == " tail" and got[2].n_chars == 5


def test_columns_of_any_name_pass_through(spark):
    names = "row_key lang_pred score letters_ kept_key own_key left_text found_key doc key_part fingerprint component_id".split()
    docs = table(spark, SMALL, "documents").limit(60).select("*", *[docs_value(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert docs.count() > 0 and all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names)


def docs_value(name):
    from pyspark.sql import functions as F

    return F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name)
