"""Temporal leakage audit: every statistic of every feature from one pass over the rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators.snapshots import as_dates, dates_array

FINDING = ("feature", "check_type", "passed", "message", "severity")


def numeric_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features present in the frame and numeric; others get name checks only."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [f for f in features if f in numeric]


def statistics(df: DataFrame, features: Sequence[str], target: str, prediction_date, churn_date: str = "churn_date") -> DataFrame:
    """One row per numeric feature: correlation, class ranges, and mean for future churners vs the rest.

    Features become rows that are aggregated where they are (one partial row per feature and task):
    a handful of aggregates that compile, rather than hundreds in one row.
    """
    future = F.coalesce(F.col(churn_date) > C.day(prediction_date), F.lit(False)) if churn_date in df.columns else F.lit(False)
    names = numeric_features(df, features)
    null = F.lit(None).cast("double")
    wide = df.select(
        F.col(target).cast("double").alias("y"),
        future.alias("ahead"),
        *[F.nanvl(F.col(n).cast("double"), null).alias(n) for n in names],
    )
    x, y, ahead = F.col("x"), F.col("y"), F.col("ahead")
    if names:
        long = wide.unpivot(["y", "ahead"], names, "feature", "x")
    else:
        long = wide.select("y", "ahead", F.lit("").alias("feature"), null.alias("x")).where("false")
    return long.groupBy("feature").agg(
        C.pearson(x, y).alias("corr"),
        F.avg(F.when(ahead, x)).alias("future_mean"),
        F.avg(F.when(~ahead, x)).alias("rest_mean"),
        F.stddev_samp(x).alias("std"),
        F.min(F.when(y == 1, x)).alias("pos_min"),
        F.max(F.when(y == 1, x)).alias("pos_max"),
        F.min(F.when(y == 0, x)).alias("neg_min"),
        F.max(F.when(y == 0, x)).alias("neg_max"),
    )


def correlation_severity(corr="corr") -> Column:
    size = F.abs(F.col(corr))
    return F.when(size > D.CORR_CRITICAL, "critical").when(size > D.CORR_WARNING, "warning")


def future_pattern() -> Column:
    return F.coalesce(F.abs(F.col("future_mean") - F.col("rest_mean")) > 2 * F.col("std"), F.lit(False))


def separated() -> Column:
    return F.coalesce(
        (F.col("pos_min") > F.col("neg_max")) | (F.col("pos_max") < F.col("neg_min")), F.lit(False)
    )


def name_findings(features: Sequence[str]) -> list[tuple]:
    """Findings that need the name only: one per pattern that a name contains."""
    out = []
    for f in features:
        low = f.lower()
        out += [(f, "suspicious_name", False, m, "warning") for p, m in D.NAME_PATTERNS.items() if p in low]
    for f in features:
        dated = "Raw date column used as feature. Should be engineered into relative features."
        out += [(f, "raw_date", False, dated, "warning") for p in D.DATE_PATTERNS if p in f.lower()]
    return out


def findings(df: DataFrame, features: Sequence[str], target: str, prediction_date, churn_date: str = "churn_date") -> DataFrame:
    """All findings in long form. Features missing from the frame are skipped by the data checks."""
    present = [f for f in features if f in df.columns]

    def finding(check: str, message: Column, severity: Column) -> Column:
        return F.struct(
            F.col("feature"), F.lit(check).alias("check_type"), F.lit(False).alias("passed"),
            message.alias("message"), severity.alias("severity"),
        )

    high = F.when(
        F.abs("corr") > D.CORR_CRITICAL,
        F.format_string("Extremely high correlation with target (%.3f). Likely leakage.", "corr"),
    ).otherwise(F.format_string("High correlation with target (%.3f). Review for leakage.", "corr"))
    data_checks = F.array(
        finding("target_correlation", high, correlation_severity()),
        finding(
            "future_pattern",
            F.lit("Feature shows different pattern for future churners. May indicate leakage."),
            F.when(future_pattern(), "warning"),
        ),
        finding(
            "perfect_separation",
            F.lit("Feature perfectly separates classes. Definite leakage."),
            F.when(separated(), "critical"),
        ),
    )
    from_data = (
        statistics(df, present, target, prediction_date, churn_date)
        .select(F.explode(data_checks).alias("f"))
        .where("f.severity IS NOT NULL")
        .select("f.*")
    )
    named = name_findings(present)
    if not named:
        return from_data
    # Name checks are constants: a few rows per feature, built in the plan.
    rows = F.from_json(
        F.lit(json.dumps([dict(zip(FINDING, n, strict=True)) for n in named])),
        "array<struct<feature string, check_type string, passed boolean, message string, severity string>>",
    )
    return from_data.unionByName(df.sparkSession.range(1).select(F.inline(rows)))


def summary(found: DataFrame) -> DataFrame:
    """Counts and feature names per severity (names joined in order)."""
    def names(severity):
        hits = F.collect_list(F.when(F.col("severity") == severity, F.col("feature")))
        return F.array_join(F.array_sort(hits), ",")

    return found.agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if("passed").alias("passed"),
        names("critical").alias("critical_features"),
        names("warning").alias("warning_features"),
    )


def window_definitions(activity: DataFrame, definitions: Mapping[str, Mapping], dates, date_col: str = "activity_date") -> DataFrame:
    """Audit window definitions against the data.

    Per definition and snapshot: whether the window includes P, whether its lookback is invalid, the
    rows it takes in and how many of those are dated P or later. Activity is first counted per day,
    so what meets the definitions is bounded by the calendar.
    """
    dates = as_dates(dates)
    specs = [
        (n, int(s.get("lookback_days", 0)), bool(s.get("includes_today", False))) for n, s in definitions.items()
    ]
    longest = max([s[1] for s in specs] + [0])
    per_day = activity.groupBy(F.col(date_col).alias("day")).agg(F.count("*").alias("n"))
    reach = F.filter(dates_array(dates), lambda p: (p >= F.col("day")) & (p <= F.date_add("day", longest)))
    near = per_day.withColumn("prediction_date", F.explode(reach)).select(
        "prediction_date", "n", F.datediff("prediction_date", "day").alias("age")
    )
    rules = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.lit(b).alias("lookback"), F.lit(t).alias("today")) for n, b, t in specs]
    )
    counted = (
        near.withColumn("r", F.explode(rules))
        .where((F.col("age") <= F.col("r.lookback")) & ((F.col("age") > 0) | F.col("r.today")))
        .groupBy(F.col("r.feature").alias("feature"), "prediction_date")
        .agg(F.sum("n").alias("rows_in_window"), F.sum(F.when(F.col("age") <= 0, F.col("n")).otherwise(0)).alias("rows_at_or_after"))
    )
    grid = (
        activity.sparkSession.range(1)
        .select(F.explode(rules).alias("r"))
        .select(F.col("r.feature").alias("feature"), F.col("r.lookback").alias("lookback_days"),
                F.col("r.today").alias("includes_today"), F.explode(dates_array(dates)).alias("prediction_date"))
    )
    severity = F.when(F.col("lookback_days") <= 0, "critical").when(F.col("includes_today"), "warning").otherwise("none")
    return grid.join(counted, ["feature", "prediction_date"], "left").select(
        "feature",
        "prediction_date",
        F.col("includes_today").alias("window_includes_today"),
        (F.col("lookback_days") <= 0).alias("invalid_window"),
        severity.alias("severity"),
        F.coalesce("rows_in_window", F.lit(0)).alias("rows_in_window"),
        F.coalesce("rows_at_or_after", F.lit(0)).alias("rows_at_or_after"),
    )


def validate_gold(gold: DataFrame, target: str = "churned_in_window", max_missing: float = 0.05) -> DataFrame:
    """(rule, violations): leaky column names, missing target above the limit, negative login counts."""
    leaky = [c for c in gold.columns if "future" in c or "churn_date" in c]
    logins = [c for c in gold.columns if c.startswith("logins_")]
    negative = F.lit(False)
    for c in logins:
        negative = negative | (F.coalesce(F.col(c), F.lit(0)) < 0)
    rules = F.array(
        F.struct(F.lit("leaky_column_names").alias("rule"), F.lit(len(leaky)).cast("long").alias("violations")),
        F.struct(
            F.lit("missing_target_rate").alias("rule"),
            F.when(F.count_if(F.col(target).isNull()) > F.count("*") * F.lit(max_missing),
                   F.count_if(F.col(target).isNull())).otherwise(F.lit(0)).alias("violations"),
        ),
        F.struct(F.lit("negative_logins").alias("rule"), F.count_if(negative).alias("violations")),
    )
    return gold.agg(rules.alias("r")).select(F.explode("r").alias("r")).select("r.*")
