"""Evaluation of (label, score) rows, overall or per segment, from one score histogram.

`by` columns are closed domains: cohort, tier, contract, prediction date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators.ranking import TIE_DIGITS, Key, Slots, check_segments, mark_first_k, match, running_totals

K_PCTS = (0.1, 0.2)


def histogram(rows: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(by, score, n, pos): ties collapse on the map side."""
    return rows.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def cumulative(rows: DataFrame, by: Sequence[str] = (), slots: Slots | None = None, score="score", label="label") -> DataFrame:
    """Histogram with running totals from the highest score down."""
    return running_totals(histogram(rows, by, score, label), by, score, ["n", "pos"], slots)


def _counts(threshold: float, score: str = "score") -> dict[str, Column]:
    flagged = F.col(score) >= threshold
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return {
        "tp": total(F.when(flagged, pos)),
        "fp": total(F.when(flagged, neg)),
        "fn": total(F.when(~flagged, pos)),
        "tn": total(F.when(~flagged, neg)),
    }


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": C.ratio(tp + tn, tp + fp + fn + tn),
        "precision": C.ratio(tp, tp + fp),
        "recall": C.ratio(tp, tp + fn),
        "f1": C.ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion(rows: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    counts = histogram(rows, by).groupBy(*by).agg(*[c.alias(n) for n, c in _counts(threshold).items()])
    return counts.withColumns(_rates())


def _auc_roc() -> Column:
    """Rank statistic: each positive beats the negatives scored below it, ties count half."""
    p, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    negatives = F.col("total_n") - F.col("total_pos")
    below = negatives - (F.col("cum_n") - F.col("cum_pos"))
    return F.sum(p * (below + 0.5 * neg))


def _average_precision() -> Column:
    gained = F.col("pos").cast("double") / F.nullif("total_pos", F.lit(0))
    return F.sum(gained * (F.col("cum_pos") / F.col("cum_n")))


def _ranked_columns() -> dict[str, Column]:
    """auc_roc and auc_pr as aggregates of running totals; 0 where a segment has one class."""
    negatives = F.max("total_n") - F.max("total_pos")
    two = (F.max("total_pos") > 0) & (negatives > 0)
    pairs = F.max("total_pos").cast("double") * negatives
    return {
        "auc_roc": F.when(two, _auc_roc() / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(0.0)),
        "auc_pr": F.when(two, _average_precision()).otherwise(F.lit(0.0)),
    }


def ranking_metrics(rows: DataFrame, by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    """auc_roc and auc_pr (average precision, step sum) per segment."""
    return cumulative(rows, by, slots).groupBy(*by).agg(*[c.alias(n) for n, c in _ranked_columns().items()])


def _squared(error: Column) -> Column:
    """A squared error as a decimal: sums of it do not depend on the order of tasks."""
    return F.pow(error, 2).cast("decimal(20,12)")


def brier(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum(_squared(F.col("score") - F.col("label"))).cast("double")
    return rows.groupBy(*by).agg((total / F.count("*")).alias("brier"))


def k_of(pct: float) -> Column:
    """int(n * pct), truncating the double product."""
    return F.floor(F.col("total_n") * F.lit(float(pct)))


def top_k(rows: DataFrame, by: Sequence[str], pct: float, key: Key, slots: Slots | None = None) -> DataFrame:
    """The top share of each segment by (score, hash of the whole row key)."""
    return mark_first_k(rows, by, "score", key, k_of(pct), slots).where("taken").drop("taken")


def _label_share(rows: DataFrame, ranked: DataFrame, by: Sequence[str], pcts: Sequence[float], key: Key) -> DataFrame:
    """(by, precision_at_<p>pct ...): label share among the first k rows by (score, hash of key).

    Positives above the crossing score come from `ranked`, the running totals. Of the rows tied at that
    score only one hash bucket is sorted; the buckets before it are counted.
    """
    check_segments(by, key)
    names = {float(p): f"precision_at_{round(p * 100)}pct" for p in pcts}
    k = F.floor(F.col("total_n") * F.col("_pct"))
    crossing = (
        ranked.withColumn("_pct", F.explode(F.array(*[F.lit(p) for p in names])))
        .withColumn("_k", k)
        .where((F.col("cum_n") - F.col("n") < F.col("_k")) & (F.col("cum_n") >= F.col("_k")))
        .select(*by, "_pct", "_k", "score", (F.col("_k") - F.col("cum_n") + F.col("n")).alias("_need"),
                (F.col("cum_pos") - F.col("pos")).alias("_ahead"))
    )
    # One row per segment and share: segments are closed domains, which bounds the broadcast.
    tied = match(rows.select(*by, "score", "label", C.tie_order(key).alias("_hash")), F.broadcast(crossing), [*by, "score"])
    tied = tied.withColumn("_bucket", F.substring("_hash", 1, TIE_DIGITS))
    group = [*by, "_pct"]
    counts = tied.groupBy(*group, "_bucket").agg(
        F.count("*").alias("_n"), F.sum("label").alias("_p"), *[F.first(c).alias(c) for c in ("_need", "_ahead", "_k")]
    )
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumns({"_cum": F.sum("_n").over(w), "_cum_p": F.sum("_p").over(w)})
    hit = at.where((F.col("_cum") - F.col("_n") < F.col("_need")) & (F.col("_cum") >= F.col("_need"))).select(
        *group, "_bucket", "_k", (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_rest"),
        (F.col("_ahead") + F.col("_cum_p") - F.col("_p")).alias("_before"),
    )
    inside = match(tied.select(*group, "_bucket", "_hash", "label"), F.broadcast(hit), [*group, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_hash"))
    share = (F.max("_before") + F.sum("label")) / F.max("_k").cast("double")
    per_share = inside.withColumn("_rank", rank).where("_rank <= _rest").groupBy(*group).agg(share.alias("_share"))
    return per_share.groupBy(*by).agg(
        *[F.max(F.when(F.col("_pct") == p, F.col("_share"))).alias(n) for p, n in names.items()]
    )


def _with_precision(out: DataFrame, rows, ranked, by, pcts, key) -> DataFrame:
    """Join precision@k to per-segment rows holding churn_rate; 0 when the cut is empty."""
    out = match(out, _label_share(rows, ranked, by, pcts, key), by, "left")
    for pct in pcts:
        name = f"{round(pct * 100)}pct"
        p = F.coalesce(f"precision_at_{name}", F.lit(0.0))
        out = out.withColumns({f"precision_at_{name}": p, f"lift_at_{name}": C.ratio(p, "churn_rate")})
    return out


def precision_at(rows: DataFrame, by: Sequence[str] = (), pcts: Sequence[float] = K_PCTS, key: Key = "customer_id",
                 slots: Slots | None = None) -> DataFrame:
    """precision_at_<p>pct and lift_at_<p>pct per segment, with churn_rate."""
    ranked = cumulative(rows, by, slots)
    base = ranked.groupBy(*by).agg((F.max("total_pos") / F.max("total_n").cast("double")).alias("churn_rate"))
    return _with_precision(base, rows, ranked, by, pcts, key)


def evaluate(rows: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, key: Key = "customer_id",
             slots: Slots | None = None) -> DataFrame:
    """All metrics, one row per segment, in one plan over one histogram; add n_samples and churn_rate."""
    ranked = cumulative(rows, by, slots)
    pos, neg = F.col("pos").cast("decimal(18,0)"), (F.col("n") - F.col("pos")).cast("decimal(18,0)")
    errors = pos * _squared(F.col("score") - 1) + neg * _squared(F.col("score"))
    out = ranked.groupBy(*by).agg(
        F.max("total_n").alias("n_samples"),
        (F.max("total_pos") / F.max("total_n").cast("double")).alias("churn_rate"),
        (F.sum(errors).cast("double") / F.max("total_n")).alias("brier"),
        *[c.alias(n) for n, c in {**_counts(threshold), **_ranked_columns()}.items()],
    )
    return _with_precision(out.withColumns(_rates()), rows, ranked, by, K_PCTS, key)


def recall_window(rows: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, window_days: int = 30) -> DataFrame:
    """Churners caught and missed; `window_days` is NULL when there was none to catch."""
    churned, flagged = F.col("label") == 1, F.col("score") >= threshold
    agg = rows.groupBy(*by).agg(
        F.count_if(churned & flagged).alias("churners_caught"),
        F.count_if(churned & ~flagged).alias("churners_missed"),
        F.count_if(churned).alias("total_churners"),
    )
    return agg.withColumn("recall_in_window", C.ratio("churners_caught", "total_churners")).withColumn(
        "window_days", F.when(F.col("total_churners") > 0, F.lit(window_days))
    )


def lead_time(rows: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Days of warning over true positives; distinct day counts bound the median's buffer."""
    days = F.datediff("churn_date", "prediction_date")
    hit = (F.col("label") == 1) & (F.col("score") >= threshold) & (days >= 0)
    d = F.when(hit, days)
    zero = F.lit(0.0)
    return rows.groupBy(*by).agg(
        F.coalesce(F.avg(d), zero).alias("mean_lead_time_days"),
        F.coalesce(F.median(d), zero).alias("median_lead_time_days"),
        F.coalesce(F.min(d).cast("double"), zero).alias("min_lead_time_days"),
        F.coalesce(F.max(d).cast("double"), zero).alias("max_lead_time_days"),
        F.when(F.count(d) == 0, zero).otherwise(F.stddev_samp(d)).alias("std_lead_time_days"),
        F.count(d).alias("n_true_positives"),
    )


def business_impact(
    rows: DataFrame,
    by: Sequence[str] = (),
    threshold: float | Column = 0.5,
    ltv: str = "estimated_ltv",
    cost: float = D.INTERVENTION_COST,
    save_rate: float = D.SAVE_RATE,
) -> DataFrame:
    """Expected saved and lost revenue against the cost of contacting everyone flagged."""
    churned, flagged = F.col("label") == 1, F.col("score") >= threshold
    money = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(ltv))).cast("double"), F.lit(0.0))
    agg = rows.groupBy(*by).agg(
        F.count_if(churned & flagged).alias("true_positives"),
        F.count_if(~churned & flagged).alias("false_positives"),
        F.count_if(churned & ~flagged).alias("false_negatives"),
        F.count_if(~churned & ~flagged).alias("true_negatives"),
        (money(churned & flagged) * save_rate).alias("expected_saved_revenue"),
        money(churned & ~flagged).alias("lost_revenue"),
    )
    spent = F.col("total_interventions") * F.lit(float(cost))
    return (
        agg.withColumn("total_interventions", F.col("true_positives") + F.col("false_positives"))
        .withColumn("intervention_cost", spent)
        .withColumn("net_benefit", F.col("expected_saved_revenue") - F.col("intervention_cost"))
        .withColumn("roi", F.col("net_benefit") / F.greatest(F.col("intervention_cost"), F.lit(1.0)))
    )


def calibration(rows: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Reliability per equal-width score bin: rows, mean score, observed rate."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return rows.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.avg(F.col("label").cast("double")).alias("observed_rate"),
    )
