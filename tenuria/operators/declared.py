"""Features the data model declares without a computation; the definitions are ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators.features import KEY
from tenuria.operators.snapshots import snapshot_aggregate

MONTH = 30


def _within(a, days, value):
    return F.when(a <= days, value).otherwise(F.lit(0))


def engagement(daily: DataFrame, dates) -> DataFrame:
    """14-day depth and intensity, session velocity, feature trend, login acceleration, active-day share."""
    login, used = F.col("login_count"), F.col("features_used")
    minutes = F.col("session_duration_minutes").cast("double")
    sums = {
        "features_used_14d": lambda a: _within(a, 14, used),
        "session_minutes_14d": lambda a: _within(a, 14, minutes),
        "_active": lambda a: _within(a, MONTH, F.when(login > 0, 1).otherwise(0)),
    }
    for i in range(4):
        span = lambda a, i=i: (a > i * D.WEEK) & (a <= (i + 1) * D.WEEK)
        sums[f"_l{i + 1}"] = lambda a, s=span: F.when(s(a), login).otherwise(0)
        sums[f"_f{i + 1}"] = lambda a, s=span: F.when(s(a), used).otherwise(0)
        sums[f"_m{i + 1}"] = lambda a, s=span: F.when(s(a), minutes).otherwise(0)
    agg = snapshot_aggregate(daily, "customer_id", "activity_date", dates, MONTH, sums)
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in sums}
    return agg.select(
        *KEY,
        n["features_used_14d"].alias("features_used_14d"),
        n["session_minutes_14d"].alias("session_minutes_14d"),
        C.velocity(n["_m1"], n["_m2"]).alias("session_velocity_wow"),
        C.trend_normalised(n["_f1"], n["_f2"], n["_f3"], n["_f4"]).alias("feature_trend_4w"),
        (C.velocity(n["_l1"], n["_l2"]) - C.velocity(n["_l2"], n["_l3"])).alias("login_acceleration"),
        (n["_active"] / F.lit(float(MONTH))).alias("dau_mau_ratio"),
    )


def support(tickets: DataFrame, dates) -> DataFrame:
    """Ticket counts over 7 and 90 days, negative share and mean resolution time over 30 (silver tickets)."""
    resolution, one = F.col("resolution_days").cast("double"), F.lit(1)
    agg = snapshot_aggregate(
        tickets,
        "customer_id",
        "created_date",
        dates,
        90,
        {
            "tickets_7d": lambda a: _within(a, 7, one),
            "tickets_90d": lambda a: _within(a, 90, one),
            "_n": lambda a: _within(a, MONTH, one),
            "_negative": lambda a: _within(a, MONTH, F.when(F.col("sentiment_score") < 0, 1).otherwise(0)),
            "_days": lambda a: F.when(a <= MONTH, resolution),
            "_resolved": lambda a: _within(a, MONTH, F.when(resolution.isNotNull(), 1).otherwise(0)),
        },
    )
    return agg.select(
        *KEY,
        F.coalesce("tickets_7d", F.lit(0)).alias("tickets_7d"),
        F.coalesce("tickets_90d", F.lit(0)).alias("tickets_90d"),
        C.ratio("_negative", "_n").alias("negative_ticket_pct"),
        C.ratio("_days", "_resolved").alias("avg_resolution_days_30d"),
    )


def activation(customers: DataFrame, daily: DataFrame, events: DataFrame, prediction_date, step: Column,
               feature_types, setup_days: int = 14) -> DataFrame:
    """First feature use, first-week depth and distinct setup steps of the first two weeks.

    Events shrink to distinct (customer, day, step) before the join, so a busy customer is bounded
    by days x steps.
    """
    p = C.day(prediction_date)
    known = customers.where(F.col("signup_date") <= p).select("customer_id", "signup_date")
    week = (F.col("activity_date") >= F.col("signup_date")) & (
        F.col("activity_date") <= F.date_add("signup_date", D.FIRST_WEEK_DAYS)
    )
    use = (F.col("features_used") > 0) & (F.col("activity_date") >= F.col("signup_date"))
    behaviour = (
        known.join(daily.where(F.col("activity_date") < p), "customer_id", "left")
        .groupBy("customer_id", "signup_date")
        .agg(
            F.min(F.when(use, F.datediff("activity_date", "signup_date"))).alias("days_to_first_feature_use"),
            F.sum(F.when(week, F.col("features_used")).otherwise(0)).alias("first_week_features_used"),
            F.sum(F.when(week, F.col("session_duration_minutes")).otherwise(0)).alias("first_week_session_minutes"),
        )
    )
    steps = (
        events.where(F.col("event_type").isin(*feature_types))
        .groupBy("customer_id", F.to_date("event_timestamp").alias("day"), step.alias("step"))
        .agg(F.lit(1).alias("seen"))
        .join(known, "customer_id")
        .where((F.col("day") < p) & (F.col("day") >= F.col("signup_date"))
               & (F.col("day") < F.date_add("signup_date", setup_days)))
        .groupBy("customer_id")
        .agg(F.count_distinct("step").alias("steps"))
    )
    return behaviour.join(steps, "customer_id", "left").select(
        "customer_id",
        "days_to_first_feature_use",
        "first_week_features_used",
        "first_week_session_minutes",
        F.coalesce("steps", F.lit(0)).alias("setup_steps_completed"),
    )


def billing(events: DataFrame, prediction_date, failed: Column, late: Column, renewal: Column, expansion: Column,
            days: int = 90) -> DataFrame:
    """Payment failures and late payments in [P - days, P); renewals and expansions over all history."""
    p = C.day(prediction_date)
    d = F.to_date("event_timestamp")
    recent = d >= F.date_sub(p, days)
    return events.where(d < p).groupBy("customer_id").agg(
        F.count_if(failed & recent).alias(f"payment_failures_{days}d"),
        F.count_if(late & recent).alias(f"late_payments_{days}d"),
        F.count_if(renewal).alias("previous_renewals"),
        F.count_if(expansion).alias("expansion_events"),
    )
