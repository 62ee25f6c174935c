"""Exploration of customers and behaviour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators.ranking import Slots, exact_quantiles

BOX = (0.0, 0.25, 0.5, 0.75, 1.0)
BOX_NAMES = ("min", "q1", "median", "q3", "max")


def derived_months(customers: DataFrame) -> DataFrame:
    """Signup and churn month (yyyy-MM) and months lived before churn, rounded half to even."""
    return customers.withColumns(
        {
            "signup_month": F.date_format("signup_date", "yyyy-MM"),
            "churn_month": F.date_format("churn_date", "yyyy-MM"),
            "months_to_churn": F.bround(F.datediff("churn_date", "signup_date") / F.lit(30.0), 0).cast("int"),
        }
    )


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, and the overall rate: one aggregation."""
    n = F.count("*")
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in df.columns]
    )
    total = F.lit(0).cast("long")
    wide = df.agg(n.alias("n_rows"), per_column.alias("c")).withColumn(
        "_all", F.aggregate("c", total, lambda acc, x: acc + x["n_missing"])
    )
    k = len(df.columns)
    return wide.select(
        "n_rows",
        F.lit(k).alias("n_columns"),
        C.ratio(F.col("_all") * 100, F.col("n_rows") * k).alias("overall_missing_pct"),
        F.inline("c"),
    ).withColumn("missing_pct", C.ratio(F.col("n_missing") * 100, "n_rows")).where("n_missing > 0")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates")
    )


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, metric, value): numeric columns as rows."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "metric", "value")


def distributions(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), slots: Slots | None = None) -> DataFrame:
    """Count, mean, deviation and exact quartiles per column (and segment)."""
    long = long_form(df, columns, by)
    keys = [*by, "metric"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    quartiles = exact_quantiles(long, keys, "value", BOX, slots).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in zip(BOX, BOX_NAMES, strict=True)]
    )
    return moments.join(quartiles, keys, "left")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; bin 0 and bins + 1 hold what lies outside."""
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))


def _rate() -> Column:
    return F.avg(F.coalesce(F.col("churn_label"), F.lit(False)).cast("double"))


def segment_summary(customers: DataFrame, by: Sequence[str] = ("cohort", "ltv_tier")) -> DataFrame:
    return customers.groupBy(*by).agg(
        F.count("*").alias("n_customers"), _rate().alias("churn_rate"), F.avg(F.col("estimated_ltv").cast("double")).alias("avg_ltv")
    )


def segment_pivot(customers: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts as a matrix; the column values are given, so no extra job looks for them."""
    return customers.groupBy(rows).pivot(columns, list(values)).count().fillna(0)


def churn_by_dimension(customers: DataFrame, dims: Sequence[str] = ("cohort", "contract_type", "ltv_tier")) -> DataFrame:
    """Churn rate per value of each dimension and overall: grouping sets, one job."""
    cols = [F.col(d) for d in dims]
    grouped = customers.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
        F.count("*").alias("n_customers"),
        _rate().alias("churn_rate"),
        F.avg(F.col("monthly_charges").cast("double")).alias("avg_monthly_charges"),
        F.avg(F.col("estimated_ltv").cast("double")).alias("avg_ltv"),
        F.min("signup_date").alias("first_signup"),
        F.max("signup_date").alias("last_signup"),
    )
    dim = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, d) for d in dims], F.lit("overall"))
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d), F.lit("unknown"))) for d in dims], F.lit("all"))
    return grouped.select(
        dim.alias("dimension"), value.alias("value"), "n_customers", "churn_rate", "avg_monthly_charges", "avg_ltv",
        "first_signup", "last_signup",
    )


def churn_3d(customers: DataFrame) -> DataFrame:
    churned = F.coalesce(F.col("churn_label"), F.lit(False))
    return customers.groupBy("cohort", "ltv_tier", "contract_type").agg(
        F.count("*").alias("total"), F.count_if(churned).alias("churned"), _rate().alias("churn_rate")
    )


def churn_deviation(customers: DataFrame) -> DataFrame:
    """Segment churn rate minus the overall rate; the overall comes from the segment sums."""
    churned = F.coalesce(F.col("churn_label"), F.lit(False))
    segments = customers.groupBy("cohort", "ltv_tier").agg(F.count("*").alias("n"), F.count_if(churned).alias("c"))
    everyone = Window.partitionBy()  # at most cohorts x tiers rows
    overall = F.sum("c").over(everyone) / F.sum("n").over(everyone).cast("double")
    rate = F.col("c") / F.col("n").cast("double")
    return segments.select(
        F.concat_ws(" / ", "cohort", "ltv_tier").alias("segment"),
        F.col("n").alias("n_customers"),
        rate.alias("churn_rate"),
        (rate - overall).alias("deviation"),
    )


def cohort_heatmap(customers: DataFrame, last: int = 12) -> DataFrame:
    """(signup_month, months_since_signup 0..last): churned and rate, dense, from one group-by."""
    rows = derived_months(customers)
    churned = F.coalesce(F.col("churn_label"), F.lit(False))
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("months_since_signup"), F.count_if(churned & (F.col("months_to_churn") == m)).alias("churned_count"))
            for m in range(last + 1)
        ]
    )
    grouped = rows.groupBy("signup_month").agg(F.count("*").alias("cohort_size"), cells.alias("cells"))
    return grouped.select("signup_month", "cohort_size", F.inline("cells")).withColumn(
        "churn_rate", C.ratio("churned_count", "cohort_size")
    )


def heatmap_matrix(heatmap: DataFrame, last: int = 12) -> DataFrame:
    """One row per signup month, a column per month since signup."""
    wide = heatmap.groupBy("signup_month").pivot("months_since_signup", list(range(last + 1))).agg(F.first("churn_rate"))
    return wide.select("signup_month", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"month_{m}") for m in range(last + 1)])


def cohort_trend(heatmap: DataFrame) -> DataFrame:
    return heatmap.groupBy("months_since_signup").agg(
        F.avg("churn_rate").alias("avg_churn_rate"), F.sum("churned_count").alias("total_churned")
    )


def engagement_by_status(daily: DataFrame, customers: DataFrame) -> DataFrame:
    """Per customer with activity: daily means and day count, Churned or Retained.

    Days are reduced to one row per customer before the join.
    """
    means = daily.groupBy("customer_id").agg(
        F.avg("login_count").alias("avg_logins"),
        F.avg("features_used").alias("avg_features"),
        F.avg(F.col("session_duration_minutes").cast("double")).alias("avg_session"),
        F.count("*").alias("active_days"),
    )
    status = F.when(F.coalesce(F.col("churn_label"), F.lit(False)), "Churned").otherwise("Retained")
    return means.join(customers.select("customer_id", status.alias("churn_status")), "customer_id")


def engagement_box(per_customer: DataFrame, slots: Slots | None = None) -> DataFrame:
    """Box statistics per status and metric."""
    return distributions(per_customer, ["avg_logins", "avg_features", "avg_session"], ["churn_status"], slots)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for every unordered pair, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C.pearson(F.col(a), F.col(b)).alias("corr")) for a, b in pairs]
    )
    return df.agg(cells.alias("c")).select(F.inline("c"))


def corr_with_label(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), C.pearson(F.col(c), F.col(label)).alias("corr"))
            for c in columns
        ]
    )
    return df.agg(cells.alias("c")).select(F.inline("c")).withColumn("abs_corr", F.abs("corr"))


def kpi_summary(customers: DataFrame) -> DataFrame:
    """Totals, means, month range and the worst cohort and contract, all from one grouping-sets job."""
    dims = churn_by_dimension(customers)

    def overall(c):
        return F.max(F.when(F.col("dimension") == "overall", F.col(c)))

    def worst(d):
        here = F.col("dimension") == d
        return F.min_by(F.when(here, F.col("value")), F.when(here, F.struct(-F.col("churn_rate"), F.col("value"))))

    return dims.agg(
        overall("n_customers").alias("total_customers"),
        overall("churn_rate").alias("churn_rate"),
        overall("avg_monthly_charges").alias("avg_monthly_charges"),
        overall("avg_ltv").alias("avg_ltv"),
        F.date_format(overall("first_signup"), "yyyy-MM").alias("first_month"),
        F.date_format(overall("last_signup"), "yyyy-MM").alias("last_month"),
        worst("cohort").alias("worst_cohort"),
        worst("contract_type").alias("worst_contract"),
    )
