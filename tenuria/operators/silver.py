"""Bronze -> silver: cleaning, typing and daily aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria.functions import columns as C

ADDON_COLUMNS = (
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
)


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by `order`, the remaining columns breaking ties.

    A minimum over one struct instead of row_number(): it has a map-side partial, so a key
    that owns most of the rows shrinks to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*key, "first.*").select(*df.columns)


def dedup_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, distinct keys and rows that dedup_first removes."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").cast("long").alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.sum(F.col("n") - 1).cast("long").alias("rows_removed"),
    )


def align_columns(df: DataFrame, schema, false_when_null: Sequence[str] = ()) -> DataFrame:
    """Project by name into `schema` order with its types; missing columns become NULL."""
    out = []
    for field in schema.fields:
        c = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in false_when_null:
            c = F.coalesce(c.cast("boolean"), F.lit(False))
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def silver_customers(bronze: DataFrame, as_of) -> DataFrame:
    """The 20-column customer projection; tenure runs to the churn date or `as_of`."""
    tenure = C.tenure_days("signup_date", "churn_date", as_of)
    false = F.lit(False)
    return bronze.select(
        "customer_id",
        "signup_date",
        tenure.alias("tenure_days"),
        C.cohort_of(tenure).alias("cohort"),
        C.ltv_tier("monthly_charges").alias("ltv_tier"),
        "contract_type",
        C.contract_months("contract_type").alias("contract_months"),
        "monthly_charges",
        C.ltv_flat("monthly_charges").alias("estimated_ltv"),
        F.coalesce("phone_service", false).alias("has_phone"),
        C.has_internet("internet_service").alias("has_internet"),
        C.internet_type("internet_service").alias("internet_type"),
        C.n_addons(ADDON_COLUMNS).alias("n_addon_services"),
        F.coalesce("paperless_billing", false).alias("paperless_billing"),
        "payment_method",
        F.coalesce("senior_citizen", false).alias("is_senior"),
        F.coalesce("partner", false).alias("has_partner"),
        F.coalesce("dependents", false).alias("has_dependents"),
        "churn_label",
        "churn_date",
    )


def silver_tickets(bronze: DataFrame) -> DataFrame:
    """Ticket date, resolution time in days, NULL sentiment -> 0, NULL escalation -> false."""
    seconds = F.expr("timestampdiff(SECOND, created_at, resolved_at)")
    return bronze.select(
        "ticket_id",
        "customer_id",
        F.to_date("created_at").alias("created_date"),
        (seconds / F.lit(86400.0)).alias("resolution_days"),
        "category",
        "priority",
        F.coalesce(F.col("sentiment_score").cast("double"), F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("escalated", F.lit(False)).alias("was_escalated"),
    )


def silver_engagement(daily: DataFrame) -> DataFrame:
    """Pre-aggregated days with the two ticket counters at 0."""
    return daily.select(
        "customer_id",
        "activity_date",
        "login_count",
        "session_duration_minutes",
        "features_used",
        "unique_features",
        F.lit(0).alias("support_tickets_opened"),
        F.lit(0).alias("support_tickets_resolved"),
    )


def daily_measures(
    login_types: Sequence[str], feature_types: Sequence[str], feature_key: Column, minutes: Column
) -> dict[str, Column]:
    """Aggregates of one (customer, day); all mergeable, valid in batch and streaming.

    The distinct feature count is the size of a set: exact for any codes, partial on the map side, and
    needs no second shuffle. A set holds the codes one customer used in one day.
    """
    uses = F.col("event_type").isin(*feature_types)
    return {
        "login_count": F.count_if(F.col("event_type").isin(*login_types)),
        "features_used": F.count_if(uses),
        "unique_features": F.size(F.collect_set(F.when(uses, feature_key))),
        "session_duration_minutes": F.coalesce(F.sum(minutes), F.lit(0)).cast("double"),
    }


def events_to_daily(
    events: DataFrame,
    login_types: Sequence[str],
    feature_types: Sequence[str],
    feature_key: Column,
    minutes: Column,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Raw events -> one row per (customer, day). `feature_key` may have any values; null ones are not counted."""
    measures = daily_measures(login_types, feature_types, feature_key, minutes) | dict(extra or {})
    return events.groupBy("customer_id", F.to_date("event_timestamp").alias("activity_date")).agg(
        *[c.alias(name) for name, c in measures.items()]
    )


def ticket_days(tickets: DataFrame) -> DataFrame:
    """(customer_id, activity_date) with tickets opened and resolved that day."""
    moved = tickets.select(
        "customer_id",
        F.explode(
            F.array(
                F.struct(F.to_date("created_at").alias("day"), F.lit(1).alias("opened"), F.lit(0).alias("resolved")),
                F.struct(F.to_date("resolved_at").alias("day"), F.lit(0).alias("opened"), F.lit(1).alias("resolved")),
            )
        ).alias("m"),
    ).where("m.day IS NOT NULL")
    return moved.groupBy("customer_id", F.col("m.day").alias("activity_date")).agg(
        F.sum("m.opened").alias("support_tickets_opened"), F.sum("m.resolved").alias("support_tickets_resolved")
    )


def with_ticket_days(daily: DataFrame, tickets: DataFrame) -> DataFrame:
    """Daily engagement with its ticket counters filled; days with tickets only are kept."""
    zero = F.lit(0)
    return daily.join(ticket_days(tickets), ["customer_id", "activity_date"], "full").select(
        "customer_id",
        "activity_date",
        F.coalesce("login_count", zero).alias("login_count"),
        F.coalesce("session_duration_minutes", F.lit(0.0)).alias("session_duration_minutes"),
        F.coalesce("features_used", zero).alias("features_used"),
        F.coalesce("unique_features", zero).alias("unique_features"),
        F.coalesce("support_tickets_opened", zero).alias("support_tickets_opened"),
        F.coalesce("support_tickets_resolved", zero).alias("support_tickets_resolved"),
    )
