"""Data quality, drift, model health and retraining triggers over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators import metrics
from tenuria.operators.ranking import Slots, exact_quantiles, match, running_totals

BINS = 10
EPSILON = 1e-6


def quality_daily(rows: DataFrame, time_col: str, columns: Sequence[str]) -> DataFrame:
    """Per day: hours from the last row to midnight, and the share of NULL cells in percent."""
    day = F.to_date(time_col)
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns[1:]), F.when(F.col(columns[0]).isNull(), 1).otherwise(0))
    midnight = F.unix_seconds(F.date_add(day, 1).cast("timestamp"))
    last = F.max(F.unix_micros(F.col(time_col).cast("timestamp")))
    return rows.groupBy(day.alias("day")).agg(
        ((F.max(midnight) * 1000000 - last) / F.lit(3600000000.0)).alias("feature_freshness_hours"),
        (F.sum(nulls) * 100 / (F.count("*") * F.lit(float(len(columns))))).alias("missing_rate_pct"),
    )


def status(value: Column | str, metric: str) -> Column:
    """OK, WARNING or CRITICAL for a monitored metric."""
    side, warning, critical = D.MONITOR_THRESHOLDS[metric]
    v = C.col(value)
    worse = (lambda t: v > t) if side == "above" else (lambda t: v < t)
    return F.when(worse(critical), "CRITICAL").when(worse(warning), "WARNING").otherwise("OK")


def psi(long: DataFrame, baseline: Column, date_col: str = "prediction_date", slots: Slots | None = None) -> DataFrame:
    """Population stability per (metric, date) against the rows where `baseline` holds.

    `long` has metric, value, date. Bins are baseline deciles, a value on an edge belongs to the
    lower bin; shares are floored at 1e-6. One row of edges per metric is what gets broadcast.
    """
    probs = [i / BINS for i in range(1, BINS)]
    edges = (
        exact_quantiles(long.where(baseline), ["metric"], "value", probs, slots)
        .groupBy("metric")
        .agg(F.array_sort(F.collect_list("quantile")).alias("_edges"))
    )
    placed = match(long.where(F.col("value").isNotNull()), F.broadcast(edges), ["metric"])
    bin_ = F.size(F.filter("_edges", lambda e: F.col("value") > e))
    placed = placed.withColumn("_bin", bin_).withColumn("_base", baseline)

    def shares(*keys):
        counts = F.array(*[F.count_if(F.col("_bin") == b) for b in range(BINS)])
        grouped = placed.groupBy(*keys).agg(counts.alias("_c"), F.count("*").alias("_t"))
        floor = F.lit(EPSILON)
        return grouped.select(
            *keys, F.transform("_c", lambda c: F.greatest(c / F.col("_t").cast("double"), floor)).alias("_s")
        )

    current = shares("metric", date_col)
    base_counts = F.array(*[F.count_if(F.col("_base") & (F.col("_bin") == b)) for b in range(BINS)])
    expected = placed.groupBy("metric").agg(base_counts.alias("_c"), F.count_if("_base").alias("_t")).select(
        "metric",
        F.transform("_c", lambda c: F.greatest(c / F.col("_t").cast("double"), F.lit(EPSILON))).alias("_e"),
    )
    terms = F.zip_with("_s", "_e", lambda a, e: (a - e) * F.ln(a / e))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return match(current, F.broadcast(expected), ["metric"]).select("metric", date_col, total.alias("psi"))


def ks(rows: DataFrame, baseline: Column, score: str = "score", by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between baseline rows and the others."""
    cells = rows.groupBy(*by, score).agg(F.count_if(baseline).alias("n0"), F.count_if(~baseline).alias("n1"))
    run = running_totals(cells, by, score, ["n0", "n1"], slots, descending=False)
    gap = F.abs(C.ratio("cum_n0", "total_n0") - C.ratio("cum_n1", "total_n1"))
    return run.groupBy(*by).agg(F.max(gap).alias("ks")).withColumn("drifted", F.col("ks") > D.KS_THRESHOLD)


def prediction_drift(rows: DataFrame, date_col: str = "prediction_date", baseline_mean: float | None = None) -> DataFrame:
    """Mean score per day and its distance from the baseline (the first day's mean by default).

    Scores are summed as decimals, so the means do not depend on the order of tasks.
    """
    total = F.sum(F.col("score").cast("decimal(18,9)")).cast("double")
    per_day = rows.groupBy(date_col).agg((total / F.count("score")).alias("prediction_mean"), F.count("*").alias("n"))
    first = F.first("prediction_mean").over(
        Window.partitionBy().orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )  # one row per day
    base = F.lit(float(baseline_mean)) if baseline_mean is not None else first
    return per_day.withColumn("drift", F.col("prediction_mean") - base)


def model_daily(rows: DataFrame, by: Sequence[str] = ("prediction_date",), floor: float = 0.5, slots: Slots | None = None) -> DataFrame:
    """AUC-PR and precision@10 % per day (and segment), with the floor test."""
    out = metrics.evaluate(rows, list(by), slots=slots).select(
        *by, "n_samples", "churn_rate", "auc_pr", F.col("precision_at_10pct")
    )
    return out.withColumn("below_floor", F.col("auc_pr") < floor)


def business_daily(rows: DataFrame, date_col: str = "prediction_date", ltv: str = "estimated_ltv") -> DataFrame:
    """Rates from the booleans flagged, attempted, successful; clipped to [0, 1]."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    money = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col(ltv))).cast("double"), F.lit(0.0))
    agg = rows.groupBy(date_col).agg(
        F.count_if("flagged").alias("high_risk_flagged"),
        F.count_if("attempted").alias("interventions_attempted"),
        F.count_if("successful").alias("interventions_successful"),
        money("flagged").alias("revenue_at_risk"),
        money("successful").alias("revenue_saved"),
    )
    return agg.withColumns(
        {
            "intervention_rate": clip(C.ratio("interventions_attempted", "high_risk_flagged")),
            "save_rate": clip(C.ratio("interventions_successful", "interventions_attempted")),
        }
    )


def _recent(daily: DataFrame, date_col: str, days: int) -> DataFrame:
    """The frame with its row numbers from both ends; one row per day."""
    w = Window.partitionBy()
    return daily.withColumns(
        {
            "_last": F.row_number().over(w.orderBy(F.desc(date_col))),
            "_first": F.row_number().over(w.orderBy(F.asc(date_col))),
        }
    )


def alerts(daily: DataFrame, date_col: str = "prediction_date", days: int = 7) -> DataFrame:
    """(severity, alert) from the last rows of a daily frame with psi, missing_rate_pct, auc_pr."""
    recent = F.col("_last") <= days
    last_auc = F.max(F.when(F.col("_last") == 1, F.col("auc_pr")))
    facts = _recent(daily, date_col, days).agg(
        F.max(F.when(recent, F.col("psi"))).alias("psi"),
        F.max(F.when(recent, F.col("missing_rate_pct"))).alias("missing"),
        last_auc.alias("auc"),
    )

    def alert(cond, severity, text):
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("alert")))

    found = F.array(
        alert(F.col("psi") > 0.2, "CRITICAL", D.ALERT_DRIFT),
        alert(F.col("missing") > 3.0, "WARNING", D.ALERT_MISSING),
        alert(F.col("auc") < 0.45, "CRITICAL", D.ALERT_BELOW),
        alert((F.col("auc") >= 0.45) & (F.col("auc") < 0.5), "WARNING", D.ALERT_DEGRADING),
    )
    return facts.select(F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select("a.*")


def retrain(daily: DataFrame, date_col: str = "prediction_date", days: int = 7, drop: float = 0.10, psi_limit: float = 0.20,
            min_save_rate: float = 0.30, brier_rise: float = 0.20) -> DataFrame:
    """(check_name, value, decision, recommendation) for performance, drift, save rate and calibration.

    `daily` has auc_pr, psi, save_rate and, optionally, brier.
    """
    first, last = F.col("_first") <= days, F.col("_last") <= days
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    facts = {
        "auc0": mean(first, "auc_pr"),
        "auc1": mean(last, "auc_pr"),
        "psi": F.max(F.when(last, F.col("psi"))),
        "save": mean(last, "save_rate"),
    }
    if "brier" in daily.columns:
        facts |= {"b0": mean(first, "brier"), "b1": mean(last, "brier")}
    row = _recent(daily, date_col, days).agg(*[c.alias(n) for n, c in facts.items()])

    def decide(value, trigger, warn):
        return F.when(trigger(value), "TRIGGERED").when(warn(value), "WARNING").otherwise("OK")

    def item(name, value, trigger, warn):
        return F.struct(F.lit(name).alias("check_name"), value.alias("value"), decide(value, trigger, warn).alias("decision"))

    auc_drop = C.ratio(F.col("auc0") - F.col("auc1"), "auc0")
    items = [
        item("performance_drop", auc_drop, lambda v: v > drop, lambda v: v > drop * 0.7),
        item("drift_psi", F.col("psi"), lambda v: v > psi_limit, lambda v: v > psi_limit * 0.5),
        item("business_roi", F.col("save"), lambda v: v < min_save_rate, lambda v: v < min_save_rate * 1.2),
    ]
    if "brier" in daily.columns:
        rise = C.ratio(F.col("b1") - F.col("b0"), "b0")
        items.append(item("calibration", rise, lambda v: v > brier_rise, lambda v: v > brier_rise * 0.7))
    checked = row.select(F.array(*items).alias("i"))
    has = lambda d: F.exists("i", lambda x: x["decision"] == d)
    overall = F.when(has("TRIGGERED"), "RETRAIN").when(has("WARNING"), "MONITOR").otherwise("NONE")
    return checked.select(overall.alias("recommendation"), F.inline("i"))


def threshold_counts(daily: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, threshold, days_triggered, pct_of_period) for metric -> ('above' | 'below', limit)."""
    def hit(metric, side, limit):
        v = F.col(metric)
        return F.count_if(v > limit if side == "above" else v < limit)

    items = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("threshold"), hit(m, s, t).alias("days_triggered"))
            for m, (s, t) in limits.items()
        ]
    )
    return daily.agg(F.count("*").alias("_n"), items.alias("i")).select("_n", F.inline("i")).select(
        "metric", "threshold", "days_triggered", C.ratio(F.col("days_triggered") * 100, "_n").alias("pct_of_period")
    )


def threshold_table(daily: DataFrame, date_col: str = "prediction_date") -> DataFrame:
    """Latest value of every monitored metric present, its limits and status."""
    present = [m for m in D.MONITOR_THRESHOLDS if m in daily.columns]
    latest = daily.agg(*[F.max_by(F.col(m).cast("double"), F.col(date_col)).alias(m) for m in present])
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).alias("value"),
                F.lit(D.MONITOR_THRESHOLDS[m][1]).alias("warning"),
                F.lit(D.MONITOR_THRESHOLDS[m][2]).alias("critical"),
                status(m, m).alias("status"),
            )
            for m in present
        ]
    )
    return latest.select(F.inline(items))
