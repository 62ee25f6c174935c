"""Chosen-path join, fill-in-middle and whitening against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import DDL, SMALL, documents, empty, odd_texts

from tenuria.llm import chosen_path, middle_fill, queries, whitening

# -- chosen-path join ---------------------------------------------------------------------


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([" ".join(w)] if w else [])


def brute_links(rows):
    """(doc_id, size, component, kept) per row, by comparing all pairs of sets that share a shingle."""
    sets, label, seen = [brute_set(t) for _, t in rows], list(range(len(rows))), {}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in seen.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            seen.setdefault(x, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(map(str, out))


def brute_components(texts):
    return sorted((int(i), int(c)) for i, _, c, _ in (row.strip("()").split(", ") for row in brute_links(list(enumerate(texts)))))


def found_links(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def varied(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(n)]
    out = [base]
    for _ in range(changes):
        some = list(rng.choice(out))
        some[rng.randrange(len(some))] = rng.choice(words)
        out.append(some)
    return [" ".join(x) for x in out]


def test_links_of_odd_documents(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    texts = odd_texts() + [t for _ in range(12) for t in varied(rng, words, rng.randint(5, 120), 8)]
    texts += [texts[20], texts[21], (texts[22] or "").upper()]
    ids = [None if k % 17 == 3 else (k if k % 23 else 5) for k in range(len(texts))]
    want = brute_links(list(zip(ids, texts, strict=True)))
    assert found_links(chosen_path.near_duplicates(documents(spark, texts, ids))) == want


def test_a_node_that_stays_large_loses_no_link(spark, monkeypatch):
    """Long chains of near copies in one node, compared by classes at the end."""
    rng = random.Random(8)
    words = ["w%d" % i for i in range(900)]
    texts = varied(rng, words, 90, 150) + varied(rng, words, 60, 90)
    monkeypatch.setattr(chosen_path, "NODE", 4)
    assert found_links(chosen_path.near_duplicates(documents(spark, texts))) == brute_links(list(enumerate(texts)))


def test_a_crowd_below_the_threshold_grows_in_proportion(spark, monkeypatch):
    """Records at similarity 0.74 to one another, none linked: no step writes rows for their pairs (op11, round 3)."""
    keep, written = chosen_path.stored, []

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stored", counted)
    most = {}
    for n in (150, 300):
        texts = []
        for k in range(n):
            words = [f"t{i}" for i in range(163)]
            for i in random.Random(k).sample(range(8, 150, 6), 3):
                words[i] = f"own{k}x{i}"
            texts.append(" ".join(words))
        written.clear()
        got = chosen_path.near_duplicates(documents(spark, texts)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == brute_components(texts)
        most[n] = max(written)
    assert most[300] < 3 * most[150]


@pytest.mark.parametrize("size", [1 << 15, 300])
def test_blocks_of_large_nodes_give_the_links(spark, monkeypatch, size):
    """Blocks of many and of few records."""
    rng = random.Random(9)
    texts = varied(rng, ["w%d" % i for i in range(900)], 70, 120) + ["one " * 3, "two"]
    monkeypatch.setattr(chosen_path, "NODE", 6)
    monkeypatch.setattr(chosen_path, "BLOCK", size)
    assert found_links(chosen_path.near_duplicates(documents(spark, texts))) == brute_links(list(enumerate(texts)))


def test_pairs_just_at_the_threshold(spark):
    """Sets of 100 shingles that share 89 (similarity 89 / 111 = 0.802) are linked, those that share 88 (0.786) are not."""
    texts = []
    for k in range(30):
        w = [f"a{k}x{i}" for i in range(103)]
        texts += [" ".join(w), " ".join(w[: 92 - k % 2] + [f"b{k}x{i}" for i in range(11 + k % 2)])]
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(documents(spark, texts)).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(30)] == [k % 2 == 0 for k in range(30)]


def test_chosen_path_query_and_empty_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert found_links(queries.op11_chosen_path(spark, SMALL)) == brute_links(rows)
    assert chosen_path.near_duplicates(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        chosen_path.near_duplicates(empty(spark), 50)


# -- fill-in-middle --------------------------------------------------------------------------


def brute_fill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_of_odd_documents(spark):
    texts = [*odd_texts(), "x<P>y", "<", "<S", "<<M", "é" * 70_000, "a\x00b", "<P", "\U0001f600" * 3]
    ids = [None if k % 19 == 4 else k * 7 for k in range(len(texts))]
    docs = documents(spark, texts, ids)
    got = middle_fill.transformed(docs).withColumn("back", middle_fill.restored(*map(__import__("pyspark").sql.functions.col, ("output", "form")))).collect()
    want = [brute_fill(i, t) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert sorted(r.back for r in got) == sorted(t or "" for t in texts)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


@pytest.mark.parametrize(("unit", "cut"), [("word", r"\S*\s*"), ("line", r"[^\n]*\n?")])
def test_other_units(spark, unit, cut):
    texts = ["a bc  d\ne", "one\n\ntwo\n", "", None, "x", " lead and tail "]
    got = middle_fill.transformed(documents(spark, texts), unit).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        parts = [p for p in re.findall(cut, text) if p]
        assert r.n == len(parts)
        if r.form != "plain":
            p, m = "".join(parts[: r.prefix_units]), "".join(parts[r.prefix_units : r.prefix_units + r.middle_units])
            s = "".join(parts[r.prefix_units + r.middle_units :])
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_fill_query_and_empty_table(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [(*f[:5], sha(f[5]), sha(t or "")) for i, t in rows for f in [brute_fill(i, t)]]
    assert sorted(map(str, (tuple(r) for r in queries.op12_middle_fill(spark, SMALL).collect()))) == sorted(map(str, want))
    assert middle_fill.transformed(empty(spark)).collect() == []


# -- whitening --------------------------------------------------------------------------------


def brute_whitening(vectors):
    """n, exact deviations and the covariance's eigenvalues of the vectors that take part."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * (fit.T @ fit) - np.outer(s, s)) / (n * n)
    values, components = np.linalg.eigh(centred.astype(float))
    return n, [int(((n * np.array(v, object) - s) ** 2).sum()) for v in x], np.array(x, float) - (s / n).astype(float), values[::-1], components[:, ::-1]


def check_whitening(rows, vectors, k):
    n, deviations, centred, values, components = brute_whitening([v for _, v in vectors])
    want = {}
    for (i, _), dev, c in zip(vectors, deviations, centred, strict=True):
        want.setdefault(i, []).append((dev, c))
    assert len(rows) == k * len(vectors)
    sign = {}
    for r in rows:
        e, axis = values[r.component - 1], components[:, r.component - 1]
        near = [abs(c @ axis) / np.sqrt(e) for dev, c in want[r.vec_id] if dev == r.deviation]
        assert r.n == n and any(abs(abs(r.whitened) - v) < 1e-6 for v in near)
        assert r.explained == pytest.approx(e / values.sum(), rel=1e-6) and r.identity_error < 1e-9
        own = [c @ axis / np.sqrt(e) for dev, c in want[r.vec_id] if dev == r.deviation]
        if len(own) == 1 and abs(own[0]) > 1e-3:
            sign.setdefault(r.component, set()).add(bool((own[0] > 0) == (r.whitened > 0)))
    assert all(len(v) == 1 for v in sign.values())


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, n long, component string")


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(20) * 4.0 ** -np.arange(20) * 1000).tolist()) for i in range(200)]
    good += [(7, good[3][1]), (None, good[4][1]), (201, good[5][1])]
    bad = [(300, None), (301, []), (302, [1.0, 2.0]), (303, [None] * 20), (304, [float("nan")] * 20), (305, [float("inf")] + [0.0] * 19), (306, [1e300] * 20)]
    got = whitening.whitened(vectors_frame(spark, good + bad)).collect()
    model, d = whitening.fit(vectors_frame(spark, good + bad))
    assert d == 20 and model.n == len({tuple(np.floor(64 * np.array(v))) for _, v in good})
    assert {r.vec_id for r in got} == {i for i, _ in good} and len(got) == 16 * len(good)
    check_whitening([r for r in got if r.component <= 6], good, 6)
    far = whitening.whitened(vectors_frame(spark, [*good, (202, [1e9] * 20)])).collect()
    assert {r.component for r in far} and max(r.identity_error for r in far) < 1e-4 and {r.deviation for r in far} == {None}


def test_products_and_factors_are_exact():
    rng = np.random.default_rng(1)
    for size in (1 << 10, 1 << 44):
        y = rng.integers(-size, size, (50, 6))
        assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
    a = rng.standard_normal((8, 5))
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (8, 5) and np.allclose(factor @ factor.T, v)
    rotated = whitening.one_sided_jacobi(factor)
    assert np.allclose(rotated @ rotated.T, v)
    assert np.allclose(np.linalg.norm(rotated, axis=0) ** 2, np.linalg.eigvalsh(v)[::-1][:5])


def test_no_variance_and_empty_tables(spark):
    for some in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened(vectors_frame(spark, some)).collect() == []
    line = whitening.whitened(vectors_frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0, 2.0])])).collect()
    assert len(line) == 3 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)


def test_whitening_query(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    good = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    check_whitening(queries.op13_whitening(spark, SMALL).collect(), good, 16)
