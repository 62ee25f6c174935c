"""Adapter: events -> customers, daily engagement, tickets.

All per-user history is derived from (user, day) rows, so a user that owns a third of the
events is collapsed by map-side aggregation before anything is keyed on the user alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators.silver import events_to_daily
from tenuria.sources.accounts import attributes
from tenuria.sources.star import read

END = "2024-01-30"
CHURN_BEFORE = "2024-01-29"
PREDICTION_DATE = "2024-01-29"

EVENT_TYPES = {"login": "view", "feature": ("click", "purchase"), "ticket": "error"}


def bronze_events(spark: SparkSession, directory: str) -> DataFrame:
    return read(spark, directory, "events").select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        "event_type",
        F.col("ts").alias("event_timestamp"),
        F.col("props").alias("event_properties"),
        F.col("value").cast("decimal(12,2)").alias("minutes"),
    )


def user_days(spark: SparkSession, directory: str) -> DataFrame:
    """(customer_id, activity_date) with all daily measures, days before signup included."""
    return events_to_daily(
        bronze_events(spark, directory),
        login_types=("view",),
        feature_types=("click", "purchase"),
        feature_key=F.get_json_object("event_properties", "$.k").cast("int"),
        minutes=F.col("minutes"),
        extra={"signups": F.count_if(F.col("event_type") == "signup")},
    )


def lifetimes(days: DataFrame) -> DataFrame:
    """(customer_id, signup_date, churn_date) from (user, day) rows."""
    last = F.max("activity_date")
    return days.groupBy("customer_id").agg(
        F.coalesce(
            F.min(F.when(F.col("signups") > 0, F.col("activity_date"))), F.min("activity_date")
        ).alias("signup_date"),
        F.when(last < C.day(CHURN_BEFORE), F.date_add(last, 1)).alias("churn_date"),
    )


def customers(spark: SparkSession, directory: str, days: DataFrame | None = None) -> DataFrame:
    """Bronze-shaped customers, one row per user; `days` may be a stored user_days."""
    life = lifetimes(user_days(spark, directory) if days is None else days)
    joined = life.join(
        attributes(read(spark, directory, "customer")), F.col("customer_id") == F.col("c_custkey")
    ).drop("c_custkey")
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
    )


def engagement(spark: SparkSession, directory: str, days: DataFrame | None = None) -> DataFrame:
    """Daily engagement on or after signup. The window holds one row per day of a user."""
    days = user_days(spark, directory) if days is None else days
    mine = Window.partitionBy("customer_id")
    first_signup = F.min(F.when(F.col("signups") > 0, F.col("activity_date"))).over(mine)
    since = F.coalesce(first_signup, F.min("activity_date").over(mine))
    return (
        days.withColumn("signup_date", since)
        .where("activity_date >= signup_date")
        .select(
            "customer_id",
            "activity_date",
            "login_count",
            "features_used",
            "unique_features",
            "session_duration_minutes",
        )
    )


def tickets(spark: SparkSession, directory: str) -> DataFrame:
    """Bronze-shaped tickets from error events."""
    k, value = F.col("event_id"), F.col("value")
    sentiment = (50 - value) / 50
    return (
        read(spark, directory, "events")
        .where("event_type = 'error'")
        .select(
            k.alias("ticket_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("created_at"),
            F.when(
                k % 10 != 0, F.expr("timestampadd(SECOND, cast(round(value * 3600) as int), ts)")
            ).alias("resolved_at"),
            F.element_at(F.array(*map(F.lit, ("billing", "technical", "account", "feature_request", "general"))),
                         (k % 5 + 1).cast("int")).alias("category"),
            F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))),
                         (k % 4 + 1).cast("int")).alias("priority"),
            F.when(k % 7 != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sentiment)))
            .cast("decimal(5,4)")
            .alias("sentiment_score"),
            F.when(k % 11 != 0, value > 100).alias("escalated"),
        )
    )
