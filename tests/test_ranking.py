import hashlib
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenuria.operators import metrics, monitoring, playbooks, profiling, thresholds
from tenuria.operators.ranking import EqualWidth, Quantiles, exact_quantiles, mark_first_k, running_totals

SCHEMA = "customer_id BIGINT, score DOUBLE, label INT, cohort STRING"


def cases():
    rng = random.Random(7)
    smooth = [(i, rng.random(), int(rng.random() < 0.2), rng.choice(["a", "b"])) for i in range(400)]
    hot = [(i, 0.5 if i % 3 else rng.random(), int(rng.random() < 0.3), "a") for i in range(400)]
    tiny = [(i, 1e-12 * rng.randrange(1, 90), int(rng.random() < 0.3), "a") for i in range(300)]
    constant = [(i, 0.25, i % 2, "a") for i in range(101)]
    return {"smooth": smooth, "hot": hot, "tiny": tiny, "constant": constant}


def tie(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def brute(data):
    """Metrics row by row, as defined."""
    n, pos = len(data), sum(r[2] for r in data)
    ranked = sorted(data, key=lambda r: (-r[1], tie(r[0])))
    pairs = sum((p[1] > q[1]) + 0.5 * (p[1] == q[1]) for p in data if p[2] for q in data if not q[2])
    ap, recall = 0.0, 0.0
    for s in sorted({r[1] for r in data}, reverse=True):
        up = [r for r in data if r[1] >= s]
        hit = sum(r[2] for r in up)
        ap += (hit / pos - recall) * hit / len(up)
        recall = hit / pos
    k = int(n * 0.1)
    return {"auc_roc": pairs / (pos * (n - pos)), "auc_pr": ap, "precision_at_10pct": sum(r[2] for r in ranked[:k]) / k}


@pytest.mark.parametrize("name", ["smooth", "hot", "tiny", "constant"])
@pytest.mark.parametrize("kind", ["quantiles", "width"])
def test_metrics_match_brute_force(spark, name, kind):
    data = cases()[name]
    df = spark.createDataFrame(data, SCHEMA)
    slots = Quantiles.of(df, "score", 8) if kind == "quantiles" else EqualWidth(0, 1, 16)
    got = rows(metrics.evaluate(df, slots=slots))[0]
    for metric, want in brute(data).items():
        assert got[metric] == pytest.approx(want), metric


def test_segments_match_brute_force(spark):
    data = cases()["smooth"]
    got = {r["cohort"]: r for r in rows(metrics.evaluate(spark.createDataFrame(data, SCHEMA), ["cohort"]))}
    for c in ("a", "b"):
        for metric, want in brute([r for r in data if r[3] == c]).items():
            assert got[c][metric] == pytest.approx(want)


def test_average_precision_is_the_step_sum(spark):
    data = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.7, 0), (5, 0.6, 1), (6, 0.3, 0), (7, 0.2, 0)]
    df = spark.createDataFrame(data, "customer_id INT, score DOUBLE, label INT")
    got = rows(metrics.ranking_metrics(df))[0]["auc_pr"]
    assert got == pytest.approx((1 + 2 / 4 + 3 / 5) / 3)


def test_one_class_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1)], "customer_id INT, score DOUBLE, label INT")
    got = rows(metrics.evaluate(df))[0]
    assert (got["auc_roc"], got["auc_pr"], got["precision_at_10pct"], got["lift_at_10pct"]) == (0, 0, 0, 0)
    none = spark.createDataFrame([(1, 0.9, 0), (2, 0.1, 0)], "customer_id INT, score DOUBLE, label INT")
    lead = rows(metrics.lead_time(none.withColumn("churn_date", F.current_date()).withColumn("prediction_date", F.current_date())))[0]
    assert lead["n_true_positives"] == 0 and lead["std_lead_time_days"] == 0
    assert rows(metrics.recall_window(none))[0]["window_days"] is None


@pytest.mark.parametrize("k", [0, 1, 37, 200, 400])
def test_first_k_is_exact_with_ties(spark, k):
    data = cases()["hot"]
    df = spark.createDataFrame(data, SCHEMA)
    marked = mark_first_k(df, [], "score", "customer_id", F.lit(k), EqualWidth(0, 1, 16))
    got = {r["customer_id"] for r in rows(marked) if r["taken"]}
    assert got == {r[0] for r in sorted(data, key=lambda r: (-r[1], tie(r[0])))[:k]}


def test_running_totals_ascending_with_null_segment(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("x", 1.0, 5)], "s STRING, v DOUBLE, n INT")
    got = rows(running_totals(df, ["s"], "v", ["n"], EqualWidth(0, 4, 4), descending=False), "s", "v")
    assert [(r["s"], r["cum_n"], r["total_n"]) for r in got] == [(None, 2, 5), (None, 5, 5), ("x", 5, 5)]


def test_exact_quantiles(spark):
    values = [float(v) for v in random.Random(3).choices(range(50), k=333)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in rows(exact_quantiles(df, [], "v", probs))}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_thresholds(spark):
    data = cases()["smooth"]
    df = spark.createDataFrame(data, SCHEMA)
    for r in rows(thresholds.sweep(df)):
        up = [x for x in data if x[1] >= r["threshold"]]
        assert r["n_predicted_positive"] == len(up) and r["true_positives"] == sum(x[2] for x in up)
        assert r["true_positives"] + r["false_negatives"] == sum(x[2] for x in data)
        assert sum(r[c] for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")) == len(data)
    none = rows(thresholds.within_capacity(df, 1, 1.1))[0]
    assert none["threshold"] == 0.9 and none["warning"] == "No threshold meets constraints"
    some = rows(thresholds.within_capacity(df, 300, 0.05))[0]
    assert 0 < some["n_interventions"] <= 300 and some["warning"] is None
    point = rows(thresholds.best_f1(df))[0]
    best = max(2 * p * r / (p + r + 1e-8) for s in {x[1] for x in data}
               for up in [[x[2] for x in data if x[1] >= s]]
               for p, r in [(sum(up) / len(up), sum(up) / sum(x[2] for x in data))])
    assert point["f1"] == pytest.approx(best, abs=1e-6)


def test_ks_and_psi_of_a_sample_with_itself_is_zero(spark):
    df = spark.createDataFrame(cases()["smooth"], SCHEMA).withColumn("day", F.lit(1))
    both = df.unionByName(df.withColumn("day", F.lit(2)))
    base = F.col("day") == 1
    assert rows(monitoring.ks(both, base))[0]["ks"] == 0
    long = profiling.long_form(both, ["score"], ["day"])
    assert [r["psi"] for r in rows(monitoring.psi(long, base, "day"))] == pytest.approx([0, 0])
    moved = df.unionByName(df.withColumns({"day": F.lit(2), "score": F.col("score") / 4}))
    long = profiling.long_form(moved, ["score"], ["day"])
    assert {r["day"]: r["psi"] > 0.2 for r in rows(monitoring.psi(long, base, "day"))} == {1: False, 2: True}


def test_ab_halves_every_stratum(spark):
    df = spark.createDataFrame(cases()["smooth"], SCHEMA)
    got = playbooks.ab_assign(df, ["cohort"]).groupBy("cohort").pivot("arm").count()
    for r in rows(got):
        assert 0 <= r["control"] - r["treatment"] <= 1


def test_row_identifier_is_not_a_segment(spark):
    df = spark.createDataFrame(cases()["constant"], SCHEMA)
    with pytest.raises(ValueError):
        metrics.evaluate(df, ["customer_id"])
    with pytest.raises(ValueError):
        playbooks.ab_assign(df, ["customer_id"])


def test_exact_quantiles_open_only_slots_with_wanted_positions(spark):
    rng = np.random.default_rng(5)
    data = [(g, float(v)) for g, n in (("a", 500), ("b", 1), ("c", 37)) for v in np.round(rng.exponential(3, n), 1)]
    data += [(None, 4.0), (None, 4.0), (None, 7.5), ("a", None)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for slots in (None, EqualWidth(0, 30, 7), EqualWidth(0, 1, 1)):
        got = {(r["g"], r["prob"]): r["quantile"] for r in rows(exact_quantiles(df, ["g"], "v", probs, slots))}
        want = {(g, p): np.quantile([v for k, v in data if k == g and v is not None], p) for g in ("a", "b", "c", None) for p in probs}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_capacity_without_a_fallback_names_no_threshold(spark):
    """The query's SQL has no row where no threshold qualifies; the one that does qualify stays the same."""
    df = spark.range(1000).select(F.col("id").alias("customer_id"), (F.col("id") / 1000).alias("score"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    assert rows(thresholds.within_capacity(df, 5, 0.9, fallback=None)) == []
    assert rows(thresholds.within_capacity(df, 400, 0.1, fallback=None)) == rows(thresholds.within_capacity(df, 400, 0.1))
