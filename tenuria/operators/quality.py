"""Data-quality rules as (table, rule, violations), every row checked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria import defaults as D


def check(df: DataFrame, table: str, rules: Mapping[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Count rows for which a rule is true (true = violation), plus rows repeating an earlier key.

    With a key the rows are first grouped by it, so one shuffle serves all rules; the
    groups carry counts only and a hot key folds on the map side.
    """
    counts = {n: F.count_if(F.coalesce(c, F.lit(False))) for n, c in rules.items()}
    if key:
        per_key = df.groupBy(*key).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in counts.items()])
        totals = {n: F.coalesce(F.sum(f"`{n}`"), F.lit(0)) for n in rules}
        totals["unique_" + "_".join(key)] = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
        df = per_key
    else:
        totals = counts
    out = F.array(
        *[F.struct(F.lit(n).alias("rule"), c.cast("long").alias("violations")) for n, c in totals.items()]
    )
    return df.agg(out.alias("r")).select(F.inline("r")).select(F.lit(table).alias("name"), "rule", "violations")


def missing(*columns: str) -> dict[str, Column]:
    return {f"{c}_required": F.col(c).isNull() for c in columns}


def one_of(column: str, allowed: Sequence[str]) -> dict[str, Column]:
    return {f"{column}_known": ~F.col(column).isin(*allowed)}


def not_negative(*columns: str) -> dict[str, Column]:
    return {f"{c}_not_negative": F.col(c) < 0 for c in columns}


def bronze(customers: DataFrame) -> DataFrame:
    rules = missing("customer_id", "signup_date", "monthly_charges", "contract_type", "churn_label")
    rules |= not_negative("monthly_charges") | one_of("contract_type", list(D.CONTRACT_MONTHS))
    return check(customers, "bronze.customers", rules, ["customer_id"])


def silver(customers: DataFrame) -> DataFrame:
    rules = missing("customer_id", "cohort", "ltv_tier", "tenure_days", "estimated_ltv")
    rules |= not_negative("tenure_days", "estimated_ltv") | one_of("cohort", D.COHORTS) | one_of("ltv_tier", D.TIERS)
    return check(customers, "silver.customers", rules, ["customer_id"])


def gold(rows: DataFrame) -> DataFrame:
    rules = missing("customer_id", "prediction_date", "logins_30d", "churned_in_window")
    rules |= not_negative("logins_30d") | one_of("cohort", D.COHORTS)
    return check(rows, "gold.customer_360", rules, ["customer_id", "prediction_date"])
