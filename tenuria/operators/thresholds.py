"""Threshold sweeps and the choice of an operating point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators import metrics
from tenuria.operators.ranking import Slots, match


def sweep(rows: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = D.THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at each threshold (score >= t flags), one pass over the rows.

    Each score meets the first m thresholds; rows are counted per m, and at most
    len(thresholds) + 1 counts per segment are summed from the top.
    """
    thresholds = sorted(thresholds)
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    met = F.size(F.filter(levels, lambda t: F.col("score") >= t))
    per_met = (
        metrics.histogram(rows, by)
        .groupBy(*by, met.alias("met"))
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    )
    collected = per_met.groupBy(*by).agg(
        F.collect_list(F.struct("met", "n", "pos")).alias("_cells"),
        F.sum("n").alias("_n"),
        F.sum("pos").alias("_pos"),
    )
    zero = F.lit(0).cast("long")

    def above(field):
        kept = F.filter("_cells", lambda c: c["met"] > F.col("_i"))
        return F.aggregate(kept, zero, lambda acc, c: acc + c[field])

    at = collected.select(*by, "_cells", "_n", "_pos", F.posexplode(levels).alias("_i", "threshold"))
    flagged = at.select(*by, "threshold", "_n", "_pos", above("n").alias("n_predicted_positive"), above("pos").alias("tp"))
    tp, n = F.col("tp"), F.col("n_predicted_positive")
    return flagged.select(
        *by,
        "threshold",
        "n_predicted_positive",
        (n / F.col("_n").cast("double")).alias("pct_flagged"),
        tp.alias("true_positives"),
        (n - tp).alias("false_positives"),
        (F.col("_pos") - tp).alias("false_negatives"),
        (F.col("_n") - n - F.col("_pos") + tp).alias("true_negatives"),
        C.ratio(tp, n).alias("precision"),
        C.ratio(tp, "_pos").alias("recall"),
        C.ratio(2 * tp, n + F.col("_pos")).alias("f1"),
        C.ratio(C.ratio(tp, n), C.ratio("_pos", "_n")).alias("lift"),
    )


def pr_curve(rows: DataFrame, by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    """Precision and recall at every distinct score."""
    return metrics.cumulative(rows, by, slots).select(
        *by,
        F.col("score").alias("threshold"),
        C.ratio("cum_pos", "cum_n").alias("precision"),
        C.ratio("cum_pos", "total_pos").alias("recall"),
    )


def _point(curve: DataFrame, by, order) -> DataFrame:
    """The curve row with the smallest `order`, then the lowest threshold (a mergeable minimum)."""
    best = curve.groupBy(*by).agg(
        F.min_by(F.struct("threshold", "precision", "recall"), F.struct(order.alias("o"), F.col("threshold"))).alias("b")
    )
    p, r = F.col("b.precision"), F.col("b.recall")
    return best.select(*by, "b.threshold", "b.precision", "b.recall", C.ratio(2 * p * r, p + r).alias("f1"))


def best_f1(rows: DataFrame, by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    curve = pr_curve(rows, by, slots)
    p, r = F.col("precision"), F.col("recall")
    return _point(curve, by, -(2 * (p * r) / (p + r + 1e-8)))


def precision_recall_crossing(rows: DataFrame, by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    """Lowest score with precision >= recall, 0.5 when there is none."""
    curve = pr_curve(rows, by, slots)
    found = curve.groupBy(*by).agg(
        F.coalesce(
            F.min(F.when(F.col("precision") >= F.col("recall"), F.col("threshold"))), F.lit(0.5)
        ).alias("threshold")
    )
    scored = match(rows, F.broadcast(found), by)
    flagged, churned = F.col("score") >= F.col("threshold"), F.col("label") == 1
    counts = scored.groupBy(*by, "threshold").agg(
        F.count_if(flagged & churned).alias("tp"), F.count_if(flagged).alias("n"), F.count_if(churned).alias("pos")
    )
    return counts.select(
        *by,
        "threshold",
        C.ratio("tp", "n").alias("precision"),
        C.ratio("tp", "pos").alias("recall"),
        C.ratio(2 * F.col("tp"), F.col("n") + F.col("pos")).alias("f1"),
    )


def lowest_cost(
    rows: DataFrame, by: Sequence[str] = (), cost_fp: float = D.COST_FALSE_POSITIVE, cost_fn: float = D.COST_FALSE_NEGATIVE
) -> DataFrame:
    """Threshold of the fine grid with the smallest total error cost."""
    grid = sweep(rows, by, D.FINE_THRESHOLDS)
    cost = F.col("false_positives") * F.lit(float(cost_fp)) + F.col("false_negatives") * F.lit(float(cost_fn))
    return _point(grid, by, cost)


def within_capacity(
    rows: DataFrame, max_interventions: int, min_precision: float = 0.5, by: Sequence[str] = (), fallback: float | None = 0.9
) -> DataFrame:
    """Highest recall among thresholds that flag 1..max rows at the required precision.

    Where no threshold qualifies: the fallback with a warning, or no row if there is no fallback.
    """
    grid = sweep(rows, by, D.FINE_THRESHOLDS)
    n = F.col("n_predicted_positive")
    ok = (n >= 1) & (n <= max_interventions) & (F.col("precision") >= min_precision) & (F.col("recall") > 0)
    row = F.struct("threshold", n.alias("n"), "precision", "recall", "true_positives")
    best = grid.groupBy(*by).agg(
        F.max_by(F.when(ok, row), F.when(ok, F.struct("recall", "threshold"))).alias("b")
    )
    if fallback is None:
        best = best.where(F.col("b").isNotNull())
    b = lambda f, default: F.coalesce(F.col(f"b.{f}"), F.lit(default))
    return best.select(
        *by,
        b("threshold", fallback).alias("threshold"),
        b("n", 0).alias("n_interventions"),
        b("precision", 0.0).alias("precision"),
        b("recall", 0.0).alias("recall"),
        b("true_positives", 0).alias("true_positives"),
        (b("n", 0) / F.lit(float(max_interventions))).alias("capacity_utilization"),
        F.when(F.col("b").isNull(), "No threshold meets constraints").alias("warning"),
    )


def by_segment(rows: DataFrame, segment: str, choose=lowest_cost) -> DataFrame:
    """Flag every row by the threshold chosen for its own segment."""
    chosen = choose(rows, [segment]).select(segment, "threshold")
    return match(rows, F.broadcast(chosen), [segment]).withColumn("flagged", F.col("score") >= F.col("threshold"))


def evaluation_report(rows: DataFrame, slots: Slots | None = None, key: str = "customer_id") -> DataFrame:
    """Long table (section, segment, metric, value): overall, per cohort and tier, f1 point, impact there."""

    def long(df: DataFrame, section: str | None = None) -> DataFrame:
        keys = ["section", "segment"]
        if section:
            df = df.withColumns({"section": F.lit(section), "segment": F.lit("all")})
        names = [c for c in df.columns if c not in keys]
        return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
            keys, names, "metric", "value"
        )

    # Every row counts once overall, once for its cohort and once for its tier.
    views = F.array(
        F.struct(F.lit("overall").alias("section"), F.lit("all").alias("segment")),
        F.struct(F.lit("by_cohort").alias("section"), F.col("cohort").alias("segment")),
        F.struct(F.lit("by_ltv_tier").alias("section"), F.col("ltv_tier").alias("segment")),
    )
    segmented = rows.select(key, "score", "label", F.explode(views).alias("v")).select(
        key, "score", "label", "v.section", "v.segment"
    )
    point = best_f1(rows, (), slots)
    flagged = match(rows, F.broadcast(point.select("threshold")), [])
    impact = metrics.business_impact(flagged, threshold=F.col("threshold"))
    return (
        long(metrics.evaluate(segmented, ["section", "segment"], key=key, slots=slots))
        .unionByName(long(point, "threshold"))
        .unionByName(long(impact, "business_impact"))
    )
