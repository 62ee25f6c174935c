from itertools import combinations
from math import factorial

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenuria.operators import boosting, training, tree_contributions
from tenuria.session import settle


@pytest.fixture(scope="module")
def fitted(spark):
    i = F.col("id")
    df = spark.range(600).select(
        i.alias("customer_id"),
        F.expr("date_add(DATE '2024-01-01', cast(id % 240 as int))").alias("prediction_date"),
        (i * 37 % 101).cast("double").alias("a"),
        (i * 53 % 17).cast("double").alias("b"),
        (i * 11 % 7).cast("double").alias("c"),
        F.lit("smb").alias("ltv_tier"),
        F.lit(1.0).alias("sample_weight"),
    ).withColumn("churned_in_window", (F.col("a") > 60) & (F.col("b") > 6) | (F.col("c") == 3) & (F.col("a") < 20))
    frame, names = training.training_frame(df)
    frame = settle(frame)
    return frame, names, training.train_gbt(frame, names, rounds=4, max_depth=3, min_rows=5)


def test_training_frame_features(fitted):
    _, names, _ = fitted
    assert names == ["a", "b", "c", "ltv_tier_encoded"]


def test_contributions_sum_to_the_margin_and_match_the_model(fitted):
    frame, names, model = fitted
    explained = tree_contributions.contributions(model, frame, names)
    model_score = training.score(model, frame).select("customer_id", F.col("score").alias("expected"))
    joined = explained.join(model_score, "customer_id")
    gap = joined.agg(F.max(F.abs(F.col("score") - F.col("expected")))).first()[0]
    assert gap < 1e-9
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["contribution"])
    assert explained.agg(F.max(F.abs(total + F.col("base_value") - F.col("margin")))).first()[0] < 1e-9


def test_contributions_are_shapley_values(fitted):
    """Against the definition: all feature subsets, expectations by descending the leaves."""
    frame, names, model = fitted
    leaf_list = tree_contributions.leaves(model)

    def expected(x, known):
        total = 0.0
        for value, path in leaf_list:
            p = value
            for f, lo, hi, share in path:
                p *= (lo < x[f] <= hi) if f in known else share
            total += p
        return total

    for row in frame.limit(5).collect():
        x, d = [row[n] for n in names], len(names)
        got = tree_contributions.batch_function(leaf_list)(np.array([x]))[0]
        for i in range(d):
            rest = [j for j in range(d) if j != i]
            want = sum(
                factorial(k) * factorial(d - k - 1) / factorial(d) * (expected(x, {*s, i}) - expected(x, set(s)))
                for k in range(d) for s in combinations(rest, k)
            )
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_cover_shares_are_consistent(fitted):
    leaf_list = tree_contributions.leaves(fitted[2])
    assert all(0 < share <= 1 for _, path in leaf_list for *_, share in path)


def test_class_weights_with_an_absent_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "label INT")
    got = rows(training.class_weights(df))[0]
    assert got == {"weight_0": 0.5, "weight_1": 1.0, "scale_pos_weight": 2.0}


def test_cross_validation_and_summary(fitted):
    frame, names, _ = fitted
    folds = settle(training.cross_validate(frame, names, 2, training.train_logistic, maxIter=5))
    got = rows(folds, "fold")
    assert [r["fold"] for r in got] == [0, 1]
    assert all(0 <= r["auc_pr"] <= 1 and 0 <= r["precision_at_10pct"] <= 1 for r in got)
    summary = rows(training.cv_summary(folds))[0]
    assert summary["n_folds"] == 2 and summary["mean_auc_pr"] == pytest.approx(np.mean([r["auc_pr"] for r in got]))
    assert summary["std_auc_pr"] == pytest.approx(np.std([r["auc_pr"] for r in got], ddof=1))


def test_save_and_load(fitted, tmp_path):
    frame, names, model = fitted
    training.save_model(model, str(tmp_path / "m"))
    loaded, features = training.load_model(str(tmp_path / "m"))
    assert features == names
    a, b = (rows(training.score(m, frame).select("customer_id", "score"), "customer_id") for m in (model, loaded))
    assert a == b


def test_batch_score_and_gate(spark, fitted):
    frame, _, model = fitted
    scored = training.batch_score(model, frame)
    assert scored.where("score < 0 OR score > 1 OR intervention_priority IS NULL").count() == 0
    one = lambda a, p: spark.createDataFrame([(a, p)], "auc_pr DOUBLE, precision_at_10pct DOUBLE")
    gate = lambda c, h: rows(training.promotion_gate(c, h))[0]["promote"]
    assert gate(one(0.7, 0.7), one(0.6, 0.7)) and not gate(one(0.7, 0.5), one(0.6, 0.7)) and not gate(one(0.6, 0.9), one(0.7, 0.1))
    assert gate(one(0.7, 0.7), one(0.6, 0.7).where("false"))


def test_importance_lists_every_feature(spark, fitted):
    _, names, model = fitted
    got = rows(training.feature_importance(model, names, spark))
    assert {r["feature"] for r in got} == set(names)
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)


def test_registered_models_use_the_library_configuration():
    p = boosting.Params()
    assert (p.rounds, p.patience, p.max_depth, p.max_leaves, p.min_rows, p.learning_rate) == (500, 50, 6, 31, 20, 0.05)


SMALL = {"max_depth": 4, "max_leaves": 9, "min_rows": 5, "bins": 32}


def same(a, b):
    assert len(a.trees) == len(b.trees) and a.bias == pytest.approx(b.bias)
    for s, t in zip(a.trees, b.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.threshold.tolist() == t.threshold.tolist()
        assert np.allclose(s.value, t.value, rtol=1e-9)


def test_levels_and_tasks_grow_the_same_trees_and_folds_grow_as_alone(fitted):
    frame, names, _ = fitted
    fits = [boosting.Fit(F.col("customer_id") % 4 > i, F.col("customer_id") % 4 == i) for i in (0, 1)]
    apart = [boosting.fit_many(frame, names, fits, rounds=5, patience=9, in_task=n, **SMALL) for n in (boosting.IN_TASK, 90, 0)]
    for pair in zip(*apart, strict=True):
        same(pair[0], pair[1]), same(pair[0], pair[2])
        assert pair[0].validation == pytest.approx(pair[2].validation) and len(pair[0].validation) == 5
    assert all(np.count_nonzero(t.feature < 0) <= 9 for m in apart[0] for t in m.trees)


def test_a_fit_goes_on_from_a_model(fitted):
    frame, names, _ = fitted
    fits = [boosting.Fit(F.lit(True))]
    begun = boosting.fit_many(frame, names, fits, rounds=3, **SMALL)
    same(boosting.fit_many(frame, names, fits, start=begun, rounds=6, **SMALL)[0], boosting.fit_many(frame, names, fits, rounds=6, **SMALL)[0])


def test_first_split_is_the_best_of_all(fitted):
    frame, names, _ = fitted
    model = boosting.fit(frame, names, rounds=1, max_depth=1, row_share=1.0, feature_share=1.0, min_rows=20, bins=128)
    data = frame.select(*names, "label").toPandas()
    y = data["label"].to_numpy()
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    chance = 1 / (1 + np.exp(-model.bias))
    assert chance == pytest.approx((w * y).sum() / w.sum())
    g, h = w * (chance - y), w * chance * (1 - chance)
    gain = lambda m: max(abs(g[m].sum()) - 0.1, 0) ** 2 / (h[m].sum() + 0.1)
    best = max((gain(x <= t) + gain(x > t) - gain(x == x), n) for n in names for x in [data[n].to_numpy()] for t in np.unique(x)
               if min((x <= t).sum(), (x > t).sum()) >= 20)
    tree = model.trees[0]
    assert names[tree.feature[0]] == best[1] and tree.gain[0] == pytest.approx(best[0])


def test_boosting_stops_after_patience_and_keeps_the_best_round(fitted):
    frame, names, _ = fitted
    noise = frame.withColumn("label", (F.xxhash64("customer_id") % 2 == 0).cast("int"))
    model = boosting.fit(noise.where("customer_id % 4 > 0"), names, noise.where("customer_id % 4 = 0"), patience=3, **SMALL)
    best = int(np.argmax(model.validation))
    assert len(model.trees) == best + 1 and len(model.validation) == best + 4 < 500


def test_one_class_nulls_and_empty_frames(spark, fitted):
    frame, names, _ = fitted
    one = boosting.fit(frame.withColumn("label", F.lit(0)), names, rounds=3)
    assert one.trees == () and one.bias == pytest.approx(0.0)
    empty = boosting.fit(frame.where("false"), names, rounds=3)
    assert empty.trees == () and rows(boosting.score(empty, frame.limit(1)))[0]["score"] == pytest.approx(0.5)
    holes = frame.withColumn("a", F.when(F.col("a") > 50, F.col("a")))
    scored = boosting.score(boosting.fit(holes, names, rounds=2, **SMALL), holes)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_average_precision_of_cells():
    cells = np.array([[2, 0], [3, 1], [1, 1]])  # from the lowest cell: rows, positives
    assert boosting.average_precision(cells) == pytest.approx(0.5 * 1 + 0.5 * 2 / 4)
    assert boosting.average_precision(np.zeros((3, 2))) == 0.0


def test_run_table_counts_a_run_once_and_names_the_champion(spark, tmp_path):
    row = lambda name, v: spark.createDataFrame([(name, v)], "run_id STRING, auc_pr DOUBLE")
    path = str(tmp_path / "runs")
    for name, v, promoted in (("a", 0.4, True), ("b", 0.9, False), ("a", 0.5, True), ("c", 0.3, True)):
        training.append_run(row(name, v), path, promoted)
    assert [(r["run_id"], r["auc_pr"]) for r in rows(training.runs(spark, path), "run_id")] == [("a", 0.5), ("b", 0.9), ("c", 0.3)]
    assert [r["run_id"] for r in rows(training.champion(spark, path))] == ["a"]
    assert rows(training.champion(spark, path).where("run_id = 'z'")) == []


def test_bundled_histogram_is_the_sum_of_every_column():
    draw = np.random.default_rng(5)
    sizes, n, nodes = np.array([64, 3, 1, 4, 9, 256, 5]), 4000, 3
    bins = np.stack([draw.integers(0, s, n) for s in sizes]).astype(np.uint8)
    slot, g, h = draw.integers(0, nodes, n).astype(np.uint8), draw.normal(size=n), draw.random(n)
    got = boosting._padded(boosting._histogram(slot, bins, g, h, nodes, sizes), sizes, 256)
    for node in range(nodes):
        for c, column in enumerate(bins):
            for k, v in enumerate((g, h, np.ones(n))):
                assert np.allclose(got[node, c, :, k], np.bincount(column[slot == node], v[slot == node], 256))
    assert len(boosting._bundles(sizes)) < len(sizes)


def test_fits_of_many_rows_shuffle_no_rows_by_node(fitted, monkeypatch):
    """Their blocks run across Arrow batches and lie evenly in the partitions; no level sends its rows to other tasks."""
    frame, names, _ = fitted
    calls = []
    finish = boosting._finish
    monkeypatch.setattr(boosting, "_finish", lambda *a: calls.append(1) or finish(*a))
    few = boosting.fit_many(frame, names, [boosting.Fit(F.lit(True))], rounds=2, in_task=100, **SMALL)[0]
    assert calls
    calls.clear()
    many = boosting.fit_many(frame, names, [boosting.Fit(F.lit(True))], rounds=2, in_task=60, **SMALL)[0]
    assert not calls
    same(few, many)


def test_margins_kept_every_few_rounds_are_those_of_all_trees(fitted):
    frame, names, _ = fitted
    model = boosting.fit_many(frame, names, [boosting.Fit(F.col("customer_id") % 4 > 0, F.col("customer_id") % 4 == 0)], rounds=boosting.KEEP + 2, patience=99, **SMALL)[0]
    held = frame.where("customer_id % 4 = 0").toPandas()
    cells = np.zeros((boosting.SCORE_CELLS, 2))
    at = ((np.clip(model.margins(held[names].to_numpy(float)), -boosting.STEEP, boosting.STEEP) + boosting.STEEP) * ((boosting.SCORE_CELLS - 1) / (2 * boosting.STEEP))).astype(int)
    np.add.at(cells, (at, 0), 1)
    np.add.at(cells, (at[held["label"] == 1], 1), 1)
    assert boosting.average_precision(cells) == pytest.approx(model.validation[len(model.trees) - 1])


def test_small_fits_take_one_job_for_all_rounds(fitted, monkeypatch):
    frame, names, _ = fitted
    fits = [boosting.Fit(F.col("customer_id") % 4 > i, F.col("customer_id") % 4 == i) for i in (0, 1)]
    by_level = boosting.fit_many(frame, names, fits, rounds=6, patience=2, in_task=0, **SMALL)

    def never(*_):
        raise AssertionError("a job per round")

    monkeypatch.setattr(boosting, "_level", never)
    monkeypatch.setattr(boosting, "_finish", never)
    begun = boosting.fit_many(frame, names, fits, rounds=2, patience=2, **SMALL)
    for whole, gone_on, level in zip(boosting.fit_many(frame, names, fits, rounds=6, patience=2, **SMALL),
                                     boosting.fit_many(frame, names, fits, start=begun, rounds=6, patience=2, **SMALL) if all(len(m.trees) == 2 for m in begun) else by_level,
                                     by_level, strict=True):
        same(whole, level), same(gone_on, level)
        assert whole.validation == pytest.approx(level.validation)


@pytest.mark.parametrize(("depth", "width"), [(3, 256), (6, 4096), (8, 1024)])
def test_rows_end_where_descending_the_tree_ends(depth, width):
    """Tables over the cells of bundles, also for trees with more ends than a word has bits."""
    draw = np.random.default_rng(depth)
    sizes, n = [64, 3, 1, 4, 9, 40, 5], 3000
    bins = np.stack([draw.integers(0, s, n) for s in sizes]).astype(np.uint8)
    layout = boosting._layout(sizes, width)
    nodes = [[-1, 0.0, -1, -1, 0.0, 0.0, 0.0, 0]]
    level = [0]
    for _ in range(depth):
        below = []
        for at in level:
            f = int(draw.choice([0, 1, 3, 4, 5, 6]))
            nodes[at] = [f, 0.0, len(nodes), len(nodes) + 1, 0.0, 0.0, 0.0, int(draw.integers(0, sizes[f] - 1))]
            below += [len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, -1, -1, 0.0, 0.0, 0.0, 0] for _ in range(2)]
        level = below
    tree = boosting.Tree(*[np.array(c) for c in zip(*nodes, strict=True)])
    for wanted in (level, level[1::3], [1, *level[len(level) // 2 :: 2]]):
        exits = boosting._exits(tree, layout, wanted)
        at = {node: i for i, node in enumerate(wanted, 1)}
        got = boosting._ends(exits, boosting._pack(bins, layout), np.array([at.get(e, 0) for e in exits.ends]))
        assert got.tolist() == boosting.descend(tree, bins, tree.cut, wanted, np.ones(n, bool)).tolist()


def test_blocks_are_dealt_out_evenly(spark):
    table = spark.sparkContext.parallelize(range(24), 6).zipWithIndex()
    assert [[i for i, _ in part] for part in boosting._dealt(table, 4).glom().collect()] == [list(range(k, 24, 4)) for k in range(4)]


def test_sums_of_pickled_rows_take_the_fast_way():
    """numpy adds at places ten times slower and more where an array's type is not its own instance, as after pickling."""
    import pickle
    import time

    draw = np.random.default_rng(3)
    layout = boosting._layout([64, 64], 4096)
    cells, slopes = boosting._pack(draw.integers(0, 64, (2, 200_000)), layout), draw.random(200_000) + 1j

    def took(slopes):
        tables, times = boosting._Tables(layout, 1), []
        for _ in range(3):
            start = time.perf_counter()
            tables.add(cells, np.zeros(200_000, np.uint8), None, slopes)
            times.append(time.perf_counter() - start)
        return min(times)

    assert took(pickle.loads(pickle.dumps(slopes, 5))) < 5 * took(slopes)
