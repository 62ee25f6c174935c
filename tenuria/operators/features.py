"""Customer 360 features, `sql` variant: fixed windows for every customer.

`customer_360` is one left join per source on (customer_id, prediction_date); each source is
aggregated once, so a table is shuffled once, on the customer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria import defaults as D
from tenuria.functions import columns as C
from tenuria.operators.snapshots import as_dates, expand_base, snapshot_aggregate

KEY = ("customer_id", "prediction_date")


def _within(age, days, value):
    return F.when(age <= days, value).otherwise(F.lit(0))


def _between(age, newer, older, value):
    return F.when((age > newer) & (age <= older), value).otherwise(F.lit(0))


def base(customers: DataFrame, dates, point_in_time: bool = False) -> DataFrame:
    """Customers known at each P with renewal and weight.

    `point_in_time` measures tenure at P (leak free); otherwise the stored tenure is used, which
    for churned customers runs to the churn date.
    """
    grid = expand_base(customers, dates)
    if point_in_time:
        grid = grid.withColumn("tenure_days", F.datediff("prediction_date", "signup_date")).withColumn(
            "cohort", C.cohort_of("tenure_days")
        )
    renewal = C.days_to_renewal("contract_type", "tenure_days")
    return grid.withColumn("days_to_renewal", renewal).withColumn("sample_weight", C.sample_weight("ltv_tier"))


def engagement(daily: DataFrame, dates, windows: Sequence[int] = D.WINDOWS, period: int = D.WEEK) -> DataFrame:
    """Engagement, recency, velocity and trend features from one pass over daily activity."""
    short, mid, long = windows
    login, used, minutes = (F.col(c) for c in ("login_count", "features_used", "session_duration_minutes"))
    minutes = minutes.cast("double")
    sums = {
        f"logins_{short}d": lambda a: _within(a, short, login),
        f"logins_{mid}d": lambda a: _within(a, mid, login),
        f"logins_{long}d": lambda a: _within(a, long, login),
        f"features_used_{short}d": lambda a: _within(a, short, used),
        f"features_used_{long}d": lambda a: _within(a, long, used),
        f"session_minutes_{short}d": lambda a: _within(a, short, minutes),
        f"session_minutes_{long}d": lambda a: _within(a, long, minutes),
        "_u1": lambda a: _within(a, period, used),
        "_u2": lambda a: _between(a, period, 2 * period, used),
    }
    for i in range(4):
        sums[f"_w{i + 1}"] = lambda a, i=i: _between(a, i * period, (i + 1) * period, login)
    per_login = F.when(login > 0, minutes / login)
    agg = snapshot_aggregate(
        daily,
        "customer_id",
        "activity_date",
        dates,
        max(long, 4 * period),
        sums,
        lifetime_sums={"_ratio": per_login, "_active": F.when(login > 0, 1).otherwise(0)},
        lifetime_maxes={
            "_adopted": F.col("unique_features"),
            "_last_login": F.when(login > 0, F.col("activity_date")),
            "_last_use": F.when(used > 0, F.col("activity_date")),
        },
    )
    zero = F.lit(0)
    named = [F.coalesce(F.col(n), zero).alias(n) for n in sums if not n.startswith("_")]
    week = {n: F.coalesce(F.col(n), zero) for n in ("_w1", "_w2", "_w3", "_w4", "_u1", "_u2")}

    def since(last):
        return F.coalesce(F.datediff("prediction_date", last), F.lit(D.NEVER))

    return agg.select(
        *KEY,
        *named,
        C.ratio("_adopted", F.lit(float(D.TOTAL_FEATURES))).alias("feature_adoption_pct"),
        C.ratio("_ratio", "_active").alias("avg_session_duration"),
        since("_last_login").alias("days_since_last_login"),
        since("_last_use").alias("days_since_last_feature_use"),
        C.velocity(week["_w1"], week["_w2"]).alias("login_velocity_wow"),
        C.velocity(week["_u1"], week["_u2"]).alias("feature_velocity_wow"),
        C.trend_normalised(week["_w1"], week["_w2"], week["_w3"], week["_w4"]).alias("login_trend_4w"),
    )


def support(tickets: DataFrame, dates, days: int = D.WINDOWS[2]) -> DataFrame:
    """Ticket count and mean sentiment in the window; in-window escalations over all earlier tickets."""
    one = F.lit(1)
    sentiment = F.col("sentiment_score").cast("double")
    agg = snapshot_aggregate(
        tickets,
        "customer_id",
        "created_date",
        dates,
        days,
        {
            "_n": lambda a: _within(a, days, one),
            "_sentiment": lambda a: F.when(a <= days, sentiment),
            "_escalated": lambda a: F.when((a <= days) & F.col("was_escalated"), 1).otherwise(0),
        },
        lifetime_sums={"_all": one},
    )
    return agg.select(
        *KEY,
        F.coalesce("_n", F.lit(0)).alias(f"tickets_{days}d"),
        C.ratio("_sentiment", "_n").alias(f"avg_sentiment_{days}d"),
        F.coalesce(C.ratio("_escalated", "_all"), F.lit(0.0)).alias(f"escalation_rate_{days}d"),
    )


def first_days(new: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per customer of `new`: signup_date, first_day and first_login (of all days), and the arrays `logins`,
    `features` (sums) and `best` (maximum): before signup (first entry) and on each day from signup to FIRST_WEEK_DAYS after it.

    A customer's history is joined once, not once per snapshot, and each row of it falls into at most one entry.
    """
    people = new.groupBy("customer_id").agg(F.min("signup_date").alias("signup_date"))
    days = people.join(daily.select("customer_id", "activity_date", "login_count", "unique_features"), "customer_id", "left")
    offset = F.datediff("activity_date", "signup_date")
    place = F.when(offset < 0, -1).otherwise(offset)

    def by_day(how, measure):
        return F.array(*[F.coalesce(how(F.when(place == i, F.col(measure))), F.lit(0)).cast("long") for i in range(-1, D.FIRST_WEEK_DAYS + 1)])

    return days.groupBy("customer_id", "signup_date").agg(
        F.min("activity_date").alias("first_day"),
        F.min(F.when(F.col("login_count") > 0, F.col("activity_date"))).alias("first_login"),
        by_day(F.sum, "login_count").alias("logins"),
        by_day(F.sum, "unique_features").alias("features"),
        by_day(F.max, "unique_features").alias("best"),
    )


def known_days(days) -> Column:
    """The entries of an array of first_days that lie before P."""
    return F.slice(days, F.lit(1), F.datediff("prediction_date", "signup_date") + 1)


def to_first_login() -> Column:
    """Days from signup to the first login, if that was before P."""
    return F.when(F.col("first_login") < F.col("prediction_date"), F.datediff("first_login", "signup_date"))


def first_week(days) -> Column:
    """Sum of an array of first_days over the days before P."""
    return F.aggregate(known_days(days), F.lit(0).cast("long"), lambda a, x: a + x)


def activation(base_rows: DataFrame, daily: DataFrame) -> DataFrame:
    """First-week behaviour of new users, for P on or after signup; customers whose only activity is at or after P are left out."""
    new = base_rows.where(F.col("cohort") == "new_user").select(*KEY, "signup_date")
    return (
        new.drop("signup_date")
        .join(first_days(new, daily), "customer_id")
        .where("first_day IS NULL OR first_day < prediction_date")
        .select(
            *KEY,
            to_first_login().alias("days_to_first_login"),
            C.ratio(first_week("features"), F.lit(float(D.TOTAL_FEATURES))).alias("onboarding_completion_pct"),
            first_week("logins").alias("first_week_logins"),
        )
    )


def feature_names(windows: Sequence[int] = D.WINDOWS) -> list[str]:
    """Columns of the 360 in table order."""
    s, m, l = windows
    return [
        *KEY,
        "cohort",
        "ltv_tier",
        "days_to_first_login",
        "onboarding_completion_pct",
        "first_week_logins",
        f"logins_{s}d",
        f"logins_{m}d",
        f"logins_{l}d",
        f"features_used_{s}d",
        f"features_used_{l}d",
        "feature_adoption_pct",
        f"session_minutes_{s}d",
        f"session_minutes_{l}d",
        "avg_session_duration",
        "days_since_last_login",
        "days_since_last_feature_use",
        "login_velocity_wow",
        "feature_velocity_wow",
        "login_trend_4w",
        f"tickets_{l}d",
        f"avg_sentiment_{l}d",
        f"escalation_rate_{l}d",
        "contract_type",
        "days_to_renewal",
        "contract_value_remaining",
        "tenure_days",
        "estimated_ltv",
        "sample_weight",
        "churned_in_window",
        "churn_date",
    ]


def customer_360(
    customers: DataFrame,
    daily: DataFrame,
    tickets: DataFrame,
    dates,
    windows: Sequence[int] = D.WINDOWS,
    period: int = D.WEEK,
    horizon: int = D.HORIZON_DAYS,
    point_in_time: bool = False,
    active_only: bool = False,
) -> DataFrame:
    """One feature row per (customer, prediction date).

    `active_only` keeps customers that have not churned by P (the rows a model should see).
    """
    dates = as_dates(dates)
    if len(dates) > 1:  # all parts meet by customer; a customer's snapshots are made where its rows are
        customers = customers.repartition("customer_id")
    rows = base(customers, dates, point_in_time)
    if active_only:
        rows = rows.where(F.col("churn_date").isNull() | (F.col("churn_date") > F.col("prediction_date")))
    joined = rows
    for part in (
        engagement(daily, dates, windows, period),
        support(tickets, dates, windows[2]),
        activation(rows, daily),
    ):
        if len(dates) == 1:
            joined = joined.join(part.drop("prediction_date"), "customer_id", "left")
        else:
            joined = joined.join(part, list(KEY), "left")

    never = {"days_since_last_login", "days_since_last_feature_use"}
    as_is = {*KEY, "cohort", "ltv_tier", "days_to_first_login", "onboarding_completion_pct", "first_week_logins",
             "contract_type", "days_to_renewal", "tenure_days", "estimated_ltv", "sample_weight", "churn_date"}
    renewal = F.coalesce("days_to_renewal", F.col("contract_months") * 30)
    out = []
    for name in feature_names(windows):
        if name == "contract_value_remaining":
            out.append(C.contract_value("monthly_charges", renewal).alias(name))
        elif name == "churned_in_window":
            out.append(C.churned_within("churn_date", F.col("prediction_date"), horizon).alias(name))
        elif name in as_is:
            out.append(F.col(name))
        else:
            out.append(F.coalesce(F.col(name), F.lit(D.NEVER if name in never else 0)).alias(name))
    return joined.select(*out)


def gold_check(gold: DataFrame) -> DataFrame:
    """Rows and churn rate per cohort."""
    return gold.groupBy("cohort").agg(
        F.count("*").alias("n_customers"), F.avg(F.col("churned_in_window").cast("double")).alias("churn_rate")
    )
