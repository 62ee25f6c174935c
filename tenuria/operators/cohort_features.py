"""Customer features, `cohort` variant: windows depend on the cohort at the prediction date."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators.features import KEY, first_days, first_week, known_days, to_first_login
from tenuria.operators.snapshots import as_dates, expand_base, snapshot_aggregate

MEASURES = {"logins": "login_count", "features_used": "features_used", "session_minutes": "session_duration_minutes"}
ALL_WINDOWS = tuple(sorted({w for ws in D.COHORT_WINDOWS.values() for w in ws}))


def cohort_at_prediction(customers: DataFrame, dates) -> DataFrame:
    """Customers known at each P with tenure and cohort as of P."""
    grid = expand_base(customers, dates)
    tenure = F.datediff("prediction_date", "signup_date")
    return grid.withColumn("tenure_at_prediction", tenure).withColumn("cohort", C.cohort_of(tenure))


def has_window(cohort, days: int) -> Column:
    """Whether the cohort observes a window of `days`; unknown cohorts count as established."""
    known = {c: days in ws for c, ws in D.COHORT_WINDOWS.items()}
    return C.mapped(cohort, known, known[D.DEFAULT_COHORT])


def cohort_windows(df: DataFrame) -> DataFrame:
    """Add window_short / medium / long of each row's cohort."""
    def nth(i):
        ws = {c: (w[i] if i < len(w) else w[-1]) for c, w in D.COHORT_WINDOWS.items()}
        return C.mapped("cohort", ws, ws[D.DEFAULT_COHORT])

    return df.withColumns({"window_short": nth(0), "window_medium": nth(1), "window_long": nth(2)})


def history(daily: DataFrame, dates, period: int = D.WEEK) -> DataFrame:
    """Everything the engagement features need, one pass over daily activity."""
    sums = {}
    for name, source in MEASURES.items():
        for w in ALL_WINDOWS:
            sums[f"{name}_{w}d"] = lambda a, s=source, w=w: F.when(a <= w, F.col(s)).otherwise(F.lit(0))
    for i in range(4):
        sums[f"_w{i + 1}"] = lambda a, i=i: F.when(
            (a > i * period) & (a <= (i + 1) * period), F.col("login_count")
        ).otherwise(0)
    for i in range(2):
        sums[f"_u{i + 1}"] = lambda a, i=i: F.when(
            (a > i * period) & (a <= (i + 1) * period), F.col("features_used")
        ).otherwise(0)
    return snapshot_aggregate(
        daily,
        "customer_id",
        "activity_date",
        dates,
        max(*ALL_WINDOWS, 4 * period),
        sums,
        lifetime_sums={"_minutes": F.col("session_duration_minutes").cast("double"), "_logins": F.col("login_count")},
        lifetime_maxes={
            "_adopted": F.col("unique_features"),
            "_last_login": F.when(F.col("login_count") > 0, F.col("activity_date")),
            "_last_use": F.when(F.col("features_used") > 0, F.col("activity_date")),
        },
    )


def engagement(rows: DataFrame, daily: DataFrame, dates) -> DataFrame:
    """Windowed sums (NULL where the cohort lacks the window), recency, adoption, velocity, slope."""
    joined = rows.select(*KEY, "cohort").join(history(daily, dates), list(KEY), "left")
    zero = F.lit(0)
    windows = [
        F.when(has_window("cohort", w), F.coalesce(F.col(f"{m}_{w}d"), zero)).alias(f"{m}_{w}d")
        for m in MEASURES
        for w in ALL_WINDOWS
    ]
    week = {n: F.coalesce(F.col(n), zero) for n in ("_w1", "_w2", "_w3", "_w4", "_u1", "_u2")}

    def since(last):
        return F.coalesce(F.datediff("prediction_date", last), F.lit(D.NEVER))

    return joined.select(
        *KEY,
        *windows,
        since("_last_login").alias("days_since_last_login"),
        since("_last_use").alias("days_since_last_feature_use"),
        C.ratio(F.coalesce("_adopted", zero), F.lit(float(D.TOTAL_FEATURES))).alias("feature_adoption_pct"),
        C.ratio("_minutes", "_logins").alias("avg_session_duration"),
        C.velocity(week["_w1"], week["_w2"]).alias("login_velocity_wow"),
        C.velocity(week["_u1"], week["_u2"]).alias("feature_velocity_wow"),
        C.trend_slope([week["_w4"], week["_w3"], week["_w2"], week["_w1"]]).alias("login_trend_4w"),
    )


def support(rows: DataFrame, tickets: DataFrame, dates, days: int = 30, flag: str = "escalated") -> DataFrame:
    """In-window ticket count, mean and minimum sentiment, escalated share; 0 when there is none."""
    sentiment = F.col("sentiment_score").cast("double")
    agg = snapshot_aggregate(
        tickets,
        "customer_id",
        "created_date",
        dates,
        days,
        {
            "_n": lambda a: F.when(a <= days, 1).otherwise(0),
            "_rated": lambda a: F.when((a <= days) & sentiment.isNotNull(), 1).otherwise(0),
            "_sentiment": lambda a: F.when(a <= days, sentiment),
            "_flagged": lambda a: F.when((a <= days) & F.col(flag), 1).otherwise(0),
            "_flags": lambda a: F.when((a <= days) & F.col(flag).isNotNull(), 1).otherwise(0),
        },
        window_mins={"_lowest": lambda a: F.when(a <= days, sentiment)},
    )
    keys = list(KEY)
    return (
        rows.select(*KEY)
        .join(agg, keys, "left")
        .select(
            *KEY,
            F.coalesce("_n", F.lit(0)).alias(f"tickets_{days}d"),
            C.ratio("_sentiment", "_rated").alias(f"avg_sentiment_{days}d"),
            F.coalesce("_lowest", F.lit(0.0)).alias(f"min_sentiment_{days}d"),
            C.ratio("_flagged", "_flags").alias(f"escalation_rate_{days}d"),
        )
    )


def activation(rows: DataFrame, daily: DataFrame) -> DataFrame:
    """New users only (others get no row), for P on or after signup: first login, first-week logins, best first-week adoption."""
    new = rows.where(F.col("cohort") == "new_user").select(*KEY, "signup_date")
    return (
        new.drop("signup_date")
        .join(first_days(new, daily), "customer_id")
        .select(
            *KEY,
            F.coalesce(to_first_login(), F.lit(D.NEVER)).alias("days_to_first_login"),
            first_week("logins").alias("first_week_logins"),
            C.ratio(F.array_max(known_days("best")), F.lit(float(D.TOTAL_FEATURES))).alias("onboarding_completion_pct"),
        )
    )


def contract_columns(tenure="tenure_days") -> Mapping[str, Column]:
    """Renewal (unknown contracts as two-year), encoding, remaining value, tenure."""
    tenure = F.coalesce(C.col(tenure), F.lit(0))
    renewal = C.days_to_renewal("contract_type", tenure, D.CONTRACT_PERIOD_DAYS["Two year"])
    return {
        "days_to_renewal": renewal,
        "contract_type_encoded": C.encoded("contract_type", D.CONTRACT_CODES),
        "contract_value_remaining": F.col("monthly_charges").cast("double") * (renewal / F.lit(30.0)),
        "tenure_days": tenure,
    }


def contract(rows: DataFrame) -> DataFrame:
    return rows.select(
        *KEY,
        *[c.alias(n) for n, c in contract_columns().items()],
        F.coalesce(F.col("estimated_ltv").cast("double"), F.lit(0.0)).alias("estimated_ltv"),
    )


def label(horizon: int | Column = D.HORIZON_DAYS) -> Column:
    """Needs the churn flag and a churn date in (P, P + horizon]."""
    return F.coalesce(F.col("churn_label"), F.lit(False)) & C.churned_within(
        "churn_date", F.col("prediction_date"), horizon
    )


def label_by_cohort() -> Column:
    """Same, with the horizon of the row's cohort."""
    horizon = C.mapped("cohort", D.COHORT_HORIZON, D.COHORT_HORIZON[D.DEFAULT_COHORT])
    return label(horizon)


def features_cohort(customers: DataFrame, daily: DataFrame, tickets: DataFrame, dates) -> DataFrame:
    """One row per (customer, P): all groups joined on the key.

    `tickets` are bronze-shaped with created_date. Missing tenure_days / estimated_ltv columns
    default to 0.
    """
    for name in ("tenure_days", "estimated_ltv"):
        if name not in customers.columns:
            customers = customers.withColumn(name, F.lit(0))
    dates = as_dates(dates)
    rows = cohort_at_prediction(customers, dates)
    keys = list(KEY)
    own = rows.select(
        *KEY,
        "cohort",
        "ltv_tier",
        *[c.alias(n) for n, c in contract_columns().items()],
        F.coalesce(F.col("estimated_ltv").cast("double"), F.lit(0.0)).alias("estimated_ltv"),
        label().alias("churned_in_window"),
        C.sample_weight("ltv_tier").alias("sample_weight"),
    )
    return (
        own.join(engagement(rows, daily, dates), keys, "left")
        .join(support(rows, tickets, dates), keys, "left")
        .join(activation(rows, daily), keys, "left")
    )
