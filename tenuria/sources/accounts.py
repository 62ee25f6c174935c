"""Adapter: customer / orders / lineitem -> customers, daily engagement, tickets.

An account is an episode of one customer's orders; a gap of more than 365 days
starts a new one. Everything that needs an order of rows within a customer works on
(customer, day) rows, so the busiest customer costs at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import silver
from tenuria.sources.star import read

END = "2001-08-01"
GAP_DAYS = 365
ADDONS = (
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
)
SEGMENT_CONTRACT = {
    "BUILDING": "Month-to-month",
    "MACHINERY": "Month-to-month",
    "AUTOMOBILE": "One year",
    "FURNITURE": "One year",
    "HOUSEHOLD": "Two year",
}


def attributes(customer: DataFrame) -> DataFrame:
    """Demographic, contract and service columns of a customer row."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    flag = F.when(k % 5 != 0, k % 2 == 0)
    yes = lambda cond: F.when(cond, "Yes").otherwise("No")
    addons: list[Column] = [
        yes(F.floor(nation / F.lit(2.0**i)) % 2 == 1).alias(name) for i, name in enumerate(ADDONS[:5])
    ]
    addons.append(yes(k % 3 == 0).alias(ADDONS[5]))
    return customer.select(
        "c_custkey",
        C.mapped("c_mktsegment", SEGMENT_CONTRACT).alias("contract_type"),
        F.abs("c_acctbal").cast("decimal(10,2)").alias("monthly_charges"),
        F.when(k % 2 == 0, "Credit card").otherwise("Bank transfer").alias("payment_method"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
        flag.alias("senior_citizen"),
        flag.alias("partner"),
        flag.alias("dependents"),
        flag.alias("phone_service"),
        yes(k % 3 == 0).alias("multiple_lines"),
        F.when(k % 4 == 0, "No").when(k % 4 == 1, "DSL").when(k % 4 == 2, "Fiber optic").alias("internet_service"),
        *addons,
        flag.alias("paperless_billing"),
    )


def episodes(orders: DataFrame) -> DataFrame:
    """(o_custkey, activity_date, login_count, customer_id): one row per customer and order day."""
    days = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("activity_date")).agg(
        F.count("*").alias("login_count")
    )
    w = Window.partitionBy("o_custkey").orderBy("activity_date")
    gap = F.datediff("activity_date", F.lag("activity_date").over(w))
    starts = days.withColumn("starts", F.when(gap.isNull() | (gap > GAP_DAYS), 1).otherwise(0))
    episode = F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return starts.select(
        "o_custkey", "activity_date", "login_count", (F.col("o_custkey") * 100 + episode).alias("customer_id")
    )


def account_days(spark: SparkSession, directory: str) -> DataFrame:
    return episodes(read(spark, directory, "orders"))


def customers(spark: SparkSession, directory: str, days: DataFrame | None = None) -> DataFrame:
    """Bronze-shaped customers (26 columns), one row per account. `days`: account_days that several tables share."""
    life = (
        (account_days(spark, directory) if days is None else days)
        .groupBy("o_custkey", "customer_id")
        .agg(F.min("activity_date").alias("signup_date"), F.max("activity_date").alias("last_day"))
        .withColumn(
            "churn_date",
            F.when(F.date_add("last_day", GAP_DAYS) < C.day(END), F.date_add("last_day", 1)),
        )
        .drop("last_day")
    )
    joined = life.join(
        attributes(read(spark, directory, "customer")), F.col("o_custkey") == F.col("c_custkey")
    )
    tenure = C.tenure_days("signup_date", "churn_date", END)
    return joined.withColumns(
        {
            "tenure_days": tenure,
            "cohort": C.cohort_of(tenure),
            "ltv_tier": C.ltv_tier("monthly_charges"),
            "estimated_ltv": F.round(C.ltv_tenure("monthly_charges", "contract_type", tenure), 2).cast("decimal(12,2)"),
            "sample_weight": C.sample_weight(C.ltv_tier("monthly_charges")),
            "churn_label": F.col("churn_date").isNotNull(),
        }
    ).drop("o_custkey", "c_custkey")


def engagement(spark: SparkSession, directory: str, days: DataFrame | None = None) -> DataFrame:
    """(customer_id, activity_date) with logins, line items, distinct parts, quantity."""
    orders = read(spark, directory, "orders")
    lines = (
        read(spark, directory, "lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", F.to_date("o_orderdate").alias("activity_date"))
        .agg(
            F.count("*").alias("features_used"),
            F.count_distinct("l_partkey").alias("unique_features"),
            F.sum(F.col("l_quantity").cast("decimal(10,2)")).alias("minutes"),
        )
    )
    return (
        (episodes(orders) if days is None else days)
        .join(lines, ["o_custkey", "activity_date"], "left")
        .select(
            "customer_id",
            "activity_date",
            "login_count",
            F.coalesce("features_used", F.lit(0)).alias("features_used"),
            F.coalesce("unique_features", F.lit(0)).alias("unique_features"),
            F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)).alias("session_duration_minutes"),
        )
    )


def returned_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Returned line items, repeated (order, line) keys included."""
    return read(spark, directory, "lineitem").where("l_returnflag = 'R'").drop("l_returnflag")


def deduplicated_lines(lines: DataFrame) -> DataFrame:
    return silver.dedup_first(
        lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )


def tickets(spark: SparkSession, directory: str, days: DataFrame | None = None) -> DataFrame:
    """Bronze-shaped tickets from returned line items."""
    orders = read(spark, directory, "orders")
    accounts = (episodes(orders) if days is None else days).select("o_custkey", "activity_date", "customer_id")
    owners = orders.select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("activity_date")
    )
    sentiment = 0.5 - 10 * F.col("l_discount")
    return (
        deduplicated_lines(returned_lines(spark, directory))
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(accounts, ["o_custkey", "activity_date"])
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ticket_id"),
            "customer_id",
            F.col("l_shipdate").alias("created_at"),
            F.when(
                F.col("l_linestatus") != "O", F.expr("timestampadd(HOUR, cast(l_quantity as int), l_shipdate)")
            ).alias("resolved_at"),
            F.element_at(F.array(*map(F.lit, ("billing", "technical", "account", "feature_request", "general"))),
                         (F.col("l_linenumber") % 5 + 1).cast("int")).alias("category"),
            C.mapped(
                "o_orderpriority",
                {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"},
                "low",
            ).alias("priority"),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sentiment)).cast("decimal(3,2)").alias("sentiment_score"),
            (F.col("l_tax") > 0.06).alias("escalated"),
        )
    )
