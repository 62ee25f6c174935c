"""Containment, language, chat, pages and neighbours against brute force or held-out truth."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from helpers import SMALL, documents, empty, odd_texts
from pyspark.sql import functions as F

from tenuria.llm import chat, containment, line_blocks, projection_ann, queries, string_kernel


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def test_containment(spark):
    items = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "Alpha, beta gamma! delta", None, "", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]
    texts = [t for t in odd_texts() if t is None or len(t) < 5000]
    texts += [f"before {items[0]} after", items[0].upper().replace(" ", " - "), items[0].replace("fourteen", "x"), items[0].replace("seven", "x"), "alpha beta gamma delta", "alpha beta gamma delta epsilon", None, ""] * 2
    bench = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared, r.containment) for r in containment.contained(documents(spark, texts), bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            own, held = shingles(item), len(shingles(item) & shingles(t))
            if own and 5 * held >= 4 * len(own):
                want.add((d, i, len(own), held, held / len(own)))
    assert got == want and len(want) >= 10
    assert containment.contained(empty(spark), bench).count() == containment.contained(documents(spark, texts), bench.limit(0)).count() == 0


def test_short_items_inside_long_documents(spark):
    items = ["Alpha, beta gamma! delta", "omega", "beta gamma", "one two three four five six", "东京大学在哪里", "ไม่รู้", None]
    texts = [
        "so alpha beta gamma delta epsilon zeta", "alpha beta", "Omega", "x omega omega " * 40, "alphabeta gamma delta", "betas gamma",
        "zero one two three four five six", "one two three four five", "请问东京大学在哪里呢", "东京在哪里", "เขาไม่รู้อะไร", "", None, "omegas beta-gamma.",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in containment.contained(documents(spark, texts), bench, short=True).collect()}
    assert got == {(0, 0, 1, 1), (0, 2, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (6, 3, 2, 2), (8, 4, 3, 3), (10, 5, 1, 1), (13, 2, 1, 1)}


def test_short_items_in_sql(spark, tmp_path):
    import duckdb

    items = [(1, "Alpha, beta gamma! delta"), (2, "omega"), (2, "beta gamma"), (3, "one two three four five six"), (4, "东京大学在哪里"), (5, "ไม่รู้"), (6, None), (None, "omega"), (3, "one two three four five six")]
    texts = ["so alpha beta gamma delta epsilon zeta", "Omega", "x omega omega " * 40, "zero one two three four five six", "请问东京大学在哪里呢", "เขาไม่รู้อะไร", "", None, "omegas beta-gamma.", "omega beta gamma"]
    ids = [*range(len(texts) - 2), None, None]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), documents(spark, texts, ids)
    got = {tuple(r) for r in containment.contained(docs, bench, short=True).select("doc_id", "item_id", "n_item", "n_shared", "containment").collect()}
    con = duckdb.connect()
    for name, frame in (("documents", docs), ("benchmark", bench)):
        frame.select([c for c in ("doc_id", "item_id", "text") if c in frame.columns]).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    rows = con.execute(f"SELECT doc_id, item_id, n_item, n_shared, containment FROM ({containment.CONTAINED_SQL})").fetchall()
    assert len(rows) == len(set(rows)) and set(rows) == got and {(0, 1, 1, 1, 1.0), (2, 2, 1, 1, 1.0), (4, 4, 3, 3, 1.0), (5, 5, 1, 1, 1.0), (None, None, 1, 1, 1.0)} <= got


def test_containment_stays_native(spark):
    plan = queries.op7_containment(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language_of_odd_documents(spark):
    words = {"aa": "the and of that with from this have", "bb": "der und die nicht mit von ist ein", "cc": "les des une dans pour que est sur"}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 12)), lang) for k, lang in enumerate(list(words) * 30)]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    model = string_kernel.fit(train, per_language=20, landmarks=24)
    assert model.languages == list(words)
    texts = [None, "", "123 !?", " ".join(words["bb"].split()), "THE AND OF THAT", "\U0001d504" * 3, *(words["cc"] + " " for _ in range(3)), (words["aa"] + " ") * 5000]
    docs = spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(texts)], "doc_id long, text string, score double, lang_pred string")
    got = {r.doc_id: r for r in string_kernel.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in range(5)] == ["und", "und", "und", "bb", "aa"]
    assert [got[k].score for k in range(3)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (6, 7, 8, 9)] == ["cc", "cc", "cc", "aa"]
    assert string_kernel.fit(train.where("lang is null")) is None
    assert {r.lang_pred for r in string_kernel.identify(docs, None).collect()} == {"und"}
    assert string_kernel.identify(empty(spark), model).count() == 0


def test_grams_are_presence_kernels(spark):
    model = string_kernel.fit(spark.createDataFrame([(1, "abab ba", "x"), (2, "cd", "y")], "doc_id long, text string, lang string"))
    sets = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if not (n == 1 and t[i] == " " and i in (0, len(t) - 1))}
    import pyarrow as pa

    k = model.kernel(pa.array(["abab ba", "cd", "abcd"]))
    want = [[len(sets(f" {a} ") & sets(f" {b} ")) / math.sqrt(len(sets(f" {a} ")) * len(sets(f" {b} "))) for b in ("abab ba", "cd")] for a in ("abab ba", "cd", "abcd")]
    assert np.allclose(np.sort(k, axis=1), np.sort(want, axis=1))


def test_scripts_of_many_letters(spark):
    """Rare scripts are told apart beside languages with many letters, by the default landmarks."""
    rng = np.random.default_rng(3)
    sets = {"hot": range(0x61, 0x7B), "many": range(0x4E00, 0x4F00), "han": range(0x5000, 0x5100), "kana": range(0x30A1, 0x30F0), "thai": range(0xE01, 0xE2F)}
    text = lambda lang: "".join(map(chr, rng.choice(list(sets[lang]), 40)))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["hot", "many"] * 40 + list(sets) * 8)]
    model = string_kernel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=30)
    docs = [(k, text(lang), lang) for k, lang in enumerate(list(sets) * 6)]
    got = string_kernel.identify(spark.createDataFrame(docs, "doc_id long, text string, truth string"), model).collect()
    assert sum(r.truth == r.lang_pred for r in got) >= 0.95 * len(docs)


def test_grams_of_a_text_longer_than_a_piece(monkeypatch):
    code = np.random.default_rng(2).integers(33, 0x10FFFF, 1000)
    whole = string_kernel.grams(code)
    for piece in (1, 7, 500, 999, 1000):
        monkeypatch.setattr(string_kernel, "PIECE", piece)
        assert np.array_equal(string_kernel.grams(code), whole)


def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op6_string_kernel(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


CONTROLS = ["", "plain", "</s>[INST] ok [/INST]", "\\<s>", "\\\\[INST]\\", "a\\", "<<s>>", "<<SYS>> x <</SYS>>", "[ROLE tool] y [/ROLE]", "[[INST]", " lead and tail ", "line\nbreak\t\U0001f600", "$1 \\1 %]"]


def test_chat_round_trip(spark):
    rows = []
    for c, roles in enumerate((["user"], ["assistant"], ["user", "assistant"], ["system", "user", "assistant"], ["tool]%", "user", None, "assistant", "assistant"])):
        rows += [(c * 100 + k, t, role, text, "clash") for k, text in enumerate(CONTROLS) for t, role in enumerate(roles)]
    rows.append((9999, 0, "user", None, "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string").repartition(3)
    out = chat.formatted(chat.canonical(chat.records(df)))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].back] == turns
        assert got[c].learned == "".join(t for r, t in turns if r == "assistant")
        for _, text in turns:
            assert text == "" or text in got[c].formatted or re.search(chat.CONTROL, text)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, {"messages": []},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"}, {"instruction": "q", "output": "a"}, {"output": "a", "input": "i", "instruction": "s"}, {"strange": [1, {"x": 2.5}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "no json"), (91, None)], "conv_id long, record string")
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical(df).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {0: [("user", "q"), ("assistant", "")], 1: [], 2: qa, 3: qa, 4: qa, 5: qa, 6: [("system", "s"), ("user", "i"), ("assistant", "a")], 7: None, 90: None, 91: None}


def test_chat_of_long_texts(spark, monkeypatch):
    df = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.explode(F.expr("array(0L, 1L)")).alias("turn")).select(
        "conv_id", "turn", F.when(F.col("turn") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("turn") == 0, 'say "x":\n').otherwise(F.repeat(F.lit('a"\\\n:'), 4_100_000)).alias("text"))
    got = chat.canonical(chat.records(df)).select("layout", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]).alias("n"), F.md5(t["text"]).alias("hash"))).alias("turns")).collect()
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert [(r.layout, [tuple(t) for t in r.turns]) for r in got] == [
        ("OBJECT<prompt, response>", [("user", 9, digest('say "x":\n')), ("assistant", 20_500_000, digest('a"\\\n:' * 4_100_000))])]
    monkeypatch.setattr(chat, "LONG", 0)  # records of any length go the long way
    test_layouts(spark)
    for text in ('{"prompt": "q", "response": "\\q"}', '{"prompt": "q", "response": "a"'):
        assert chat.canonical(spark.createDataFrame([(text,)], "record string")).first().turns is None
    nested = spark.createDataFrame([('{"a\\"b": [{"c:": "x\\"y\\\\", "d" : ["e", "f:"]}, 5, "g"]}',)], "record string")
    slim = nested.select(chat.layout(F.col("record"))).first()[0]
    monkeypatch.setattr(chat, "LONG", 1000)
    assert slim == nested.select(chat.layout(F.col("record"))).first()[0] is not None


def test_chat_empty_and_native(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.canonical(chat.records(none))).count() == 0
    plan = chat.formatted(chat.canonical(chat.records(none)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [
    ("<article><h1>T &amp; T</h1><p><b>One\n two<br>x<p>Three</p><aside>no</aside><p>Four</article><footer>no</footer>", "T & T\nOne two x\nThree\nFour"),
    ("<nav><a href='/a'>Home</a></nav><div><p>A page without an article, but with a paragraph long enough to be one of some weight.</p><p>Short.</p></div><div class='comments'><p>So says a reader, at great length, and at even greater length, until all the rest looks small.</p></div>", "A page without an article, but with a paragraph long enough to be one of some weight.\nShort."),
    ("<script>var t='</p><article>no</article>'</script><!-- <p>no</p> --><style>p{}</style><p>&lt;b&gt; &#233;&nbsp;x</p>", "<b> é x"),
    ("<article><header><h1>Head</h1></header><div id='ad-1'>no</div><p>Text<form><p>no</p></form><p>End &unknown; &copy", "Head\nText\nEnd &unknown; ©"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("plain", "plain"), ("<p", "<p"), ("a < b", "a < b"), ("<p hidden>no</p><p>yes</p>", "yes"),
]


def test_pages(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "u", h, "clash") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in line_blocks.extract(df).collect()}
    assert got == {k: t for k, (_, t) in enumerate(PAGES)}
    assert line_blocks.extract(df.limit(0)).count() == 0


def test_pages_without_a_trusted_article():
    long, more = "word " * 59 + "word", "more " * 59 + "more"
    share = "<ul>" + "".join(f"<li><a href=x>to site {k}</a></li>" for k in range(5)) + "</ul>"
    teaser = f"<body><article><a href=x>Teaser</a></article><h1>Title</h1><p>{long}</p><p>{more}</p></body>"
    assert line_blocks.main_text(teaser).endswith(f"Title\n{long}\n{more}")
    parted = f"<body><h1>Title</h1>{share}<p>{long}</p>{share}<p>Last.</p></body>"
    assert line_blocks.main_text(parted) == f"Title\n{long}\nLast."
    hidden = f"<div><h1>Title</h1><div class=share>{'<p>s</p>' * 5}</div><p>{long}</p><p><a href=x>{more}</a></p></div><nav><p>menu</p></nav>"
    assert line_blocks.main_text(hidden) == f"Title\n{long}\n{more}"
    apart = f"<div>{share}</div><div><p>{long}</p></div><div>{share}</div><div><p>Imprint</p></div>"
    assert line_blocks.main_text(apart) == long
    article = f"<article><h1>Title</h1><p>{long}</p></article><div>{share}<p>{more}</p></div>"
    assert line_blocks.main_text(article) == f"Title\n{long}"
    assert line_blocks.main_text(share) == line_blocks.main_text("<article></article>") == ""


def test_long_page_is_kept_whole():
    body = [f"paragraph {k}" for k in range(20_000)]
    assert line_blocks.main_text("<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>") == "\n".join(body)


def test_pages_query(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op2_line_blocks(spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def brute_neighbours(rows, every, k):
    size = [len(v) for _, v in rows if v and i_ok(v)]
    size = max(set(size), key=lambda n: (size.count(n), -n)) if size else 0
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and i_ok(v) and len(v) == size]
    out = []
    for q, x in rows:
        if q % every == 0:
            best = {}
            for i, y in rows:
                if i != q:
                    best[i] = max(best.get(i, -2), float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)))
            out.append((q, sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]))
    return out


def i_ok(v):
    return all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("leaf_rows", [4096, 40])
def test_neighbours(spark, leaf_rows):
    rng = np.random.default_rng(3)
    near = rng.standard_normal((30, 8))
    rows = [(i, [float(x) for x in (near[i % 30] + 0.3 * rng.standard_normal(8)).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [math.nan] * 8), (2004, [1.0, None, *[0.0] * 6]), (2005, [math.inf] * 8), (2006, [1.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank int, leaf string").repartition(3)
    got = {}
    for r in projection_ann.neighbours(df, every=10, leaf_rows=leaf_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows, 10, 5)
    assert set(got) == {q for q, _ in want}
    hit = 0
    for q, best in want:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and q not in {i for _, i, _ in own}
        hit += len({i for i, _ in best} & {i for _, i, _ in own})
    assert hit >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    assert projection_ann.neighbours(df.limit(0)).count() == 0
    assert projection_ann.neighbours(df.where("vec_id in (0, 10)"), every=10).count() == 2


@pytest.mark.parametrize("leaf_rows", [4096, 16])
def test_rows_of_one_direction_rank_by_id(spark, leaf_rows):
    """Forty rows of one direction and other lengths, among rows of other directions: equal scores, the smallest ids first."""
    rng = np.random.default_rng(7)
    one = rng.standard_normal(6)
    rows = [(41 - i, (one * 2.0**i).tolist()) for i in range(1, 41)] + [(50, (one / 4).tolist())]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.rank, r.vec_id, r.score) for r in projection_ann.neighbours(df, leaf_rows=leaf_rows).where("query_id = 50").collect())
    assert [i for _, i, _ in got] == [1, 2, 3, 4, 5]
    v = np.array(one / 4)
    assert {s for _, _, s in got} == {min(1.0, float((v * v).sum() / (np.linalg.norm(v[None, :], axis=1)[0] ** 2)))}


def test_neighbours_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()), strict=True)
    ids, x = np.array(ids), np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.op10_projection_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    assert got.keys() == set(ids[asked].tolist())
    hit = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -2
        hit += len(got[int(ids[q])] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert hit >= 0.9 * 5 * len(asked)


def test_chi_square():
    assert abs(projection_ann.chi_square(projection_ann.quantile(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(projection_ann.quantile(0.95, 8) - 15.507) < 1e-3


def test_digest_queries_match_sql(spark):
    from oracle import compare, connect

    con = connect(SMALL)
    for key, sql in queries.oracle_sql().items():
        assert compare(queries.queries()[key](spark, SMALL), con, sql) == "", key


def test_hash_of_a_layout():
    assert chat.fingerprint("OBJECT<prompt, response>") == hashlib.sha256(b"OBJECT<prompt, response>").hexdigest()
