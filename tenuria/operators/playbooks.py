"""Retention playbooks: rules over the customer 360 and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators.ranking import EqualWidth, Slots, mark_first_k, match, running_totals


def churn_taxonomy(gold: DataFrame, payment_failures: Column | str, low_logins: int = 2, renewal_days: int = 90) -> DataFrame:
    """Kind of churn a customer is heading for; the first rule that holds wins."""
    low = F.col("logins_30d") < low_logins
    near = F.col("days_to_renewal") <= renewal_days
    kind = (
        F.when(C.col(payment_failures) > 0, "involuntary")
        .when(low & near, "silent")
        .when(low, "engagement_decay")
        .otherwise("contractual_voluntary")
    )
    return gold.withColumn("churn_type", kind)


def lifecycle_stage(tenure: Column | str) -> Column:
    """By tenure in days; the ranges touch, the later stage wins."""
    t = C.col(tenure)
    return F.when(t >= 180, "expand").when(t >= 90, "retain").when(t >= 15, "engage").otherwise("activate")


def churn_cost(gold: DataFrame, expansion_rate: float = 0.2, replacement_rate: float = 0.1) -> DataFrame:
    """Remaining contract value + lost expansion + replacement, the latter two as shares of LTV."""
    ltv = F.col("estimated_ltv").cast("double")
    return gold.withColumns({"expansion_loss": ltv * expansion_rate, "replacement_cost": ltv * replacement_rate}).withColumn(
        "churn_cost", F.col("contract_value_remaining") + F.col("expansion_loss") + F.col("replacement_cost")
    )


def uplift_quadrant(rows: DataFrame, churn: str = "score", save: str = "save_score", cut_churn: float = 0.5, cut_save: float = 0.5,
                    slots: Slots | None = None) -> DataFrame:
    """Priority = P(churn) x P(save) x LTV with its rank (equal priorities share one), and the quadrant."""
    high, saved = F.col(churn) >= cut_churn, F.col(save) >= cut_save
    quadrant = (
        F.when(high & saved, "persuadable").when(~high & saved, "sure_thing").when(high, "lost_cause").otherwise("sleeping_dog")
    )
    scored = rows.withColumn("quadrant", quadrant).withColumn(
        "priority", F.col(churn) * F.col(save) * F.col("estimated_ltv").cast("double")
    )
    cells = scored.groupBy("priority").agg(F.count("*").alias("n"))
    ranks = running_totals(cells, [], "priority", ["n"], slots).select(
        "priority", (F.col("cum_n") - F.col("n") + 1).alias("rank")
    )
    return match(scored, ranks, ["priority"])


def top_n_capacity(rows: DataFrame, capacity: int, churn: str = "score", key: str = "customer_id") -> DataFrame:
    """The `capacity` customers with the highest expected loss."""
    loss = F.col(churn) * F.col("estimated_ltv").cast("double")
    return rows.withColumn("expected_loss", loss).orderBy(F.desc("expected_loss"), key).limit(capacity)


def activation_sla(gold: DataFrame) -> DataFrame:
    """(customer_id, sla_day, action) for every missed activation milestone of a new user."""
    tenure, onboarding = F.col("tenure_days"), F.coalesce("onboarding_completion_pct", F.lit(0.0))
    no_login = F.col("days_to_first_login").isNull() | (F.col("days_to_first_login") > 3)

    def missed(cond, day, action):
        return F.when(cond, F.struct(F.lit(day).alias("sla_day"), action.alias("action")))

    late = F.when(F.col("ltv_tier") == "enterprise", "CSM outreach").otherwise("Guided tour")
    found = F.array(
        missed((tenure >= 3) & no_login, 3, F.lit("Check-in")),
        missed((tenure >= 7) & (onboarding < 0.5), 7, F.lit("Onboarding assist")),
        missed((tenure >= 14) & (onboarding < 0.5), 14, late),
    )
    return (
        gold.where("cohort = 'new_user'")
        .select("customer_id", "ltv_tier", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
        .select("customer_id", "ltv_tier", "x.sla_day", "x.action")
    )


def weekly_logins(daily: DataFrame, anchor) -> DataFrame:
    """(customer_id, week_start, logins): weeks counted from `anchor`."""
    week = F.floor(F.datediff("activity_date", C.day(anchor)) / 7).cast("int")
    return daily.groupBy("customer_id", F.date_add(C.day(anchor), week * 7).alias("week_start")).agg(
        F.sum("login_count").alias("logins")
    )


def velocity_alert(daily: DataFrame, customers: DataFrame, anchor, until, drop: float = 0.2) -> DataFrame:
    """Customers whose weekly logins fell by more than `drop` two weeks running, complete weeks only."""
    return falling_weeks(weekly_logins(daily, anchor), customers, until, drop)


def falling_weeks(weeks: DataFrame, customers: DataFrame, until, drop: float = 0.2) -> DataFrame:
    """`velocity_alert` over weekly totals (customer_id, week_start, logins).

    Every week's total is also sent to the next two weeks as their history, so weeks without any
    login are covered and no per-customer ordering is needed.
    """
    sent = weeks.select(
        "customer_id",
        F.col("logins"),
        F.posexplode(F.array(*[F.date_add("week_start", 7 * i) for i in range(3)])).alias("_lag", "week_start"),
    ).where(F.date_add("week_start", 7) <= C.day(until))
    lag = lambda i: F.coalesce(F.sum(F.when(F.col("_lag") == i, F.col("logins"))), F.lit(0))
    history = sent.groupBy("customer_id", "week_start").agg(
        lag(0).alias("logins"), lag(1).alias("logins_prev"), lag(2).alias("logins_prev2")
    )
    keep = 1.0 - drop
    falling = history.where(
        (F.col("logins") < F.col("logins_prev") * keep) & (F.col("logins_prev") < F.col("logins_prev2") * keep)
    )
    action = F.when(F.col("ltv_tier") == "enterprise", "CSM call").otherwise("Re-engagement campaign")
    return falling.join(customers.select("customer_id", "ltv_tier"), "customer_id").withColumn("action", action)


def renewal_review(rows: DataFrame, churn: str = "score", days: int = 90) -> DataFrame:
    """Customers close to renewal with the action of their risk level."""
    level = C.risk_level(churn)
    action = (
        F.when(level.isin("critical", "high"), "Executive renewal meeting")
        .when(level == "medium", "Value review call")
        .otherwise("Standard renewal notice")
    )
    return rows.where(F.col("days_to_renewal") <= days).withColumns({"risk_level": level, "action": action})


def ab_assign(rows: DataFrame, strata: Sequence[str], key: str = "customer_id") -> DataFrame:
    """Half of each stratum, by hash order, is treatment; exact, and no stratum is sorted as a whole."""
    k = F.floor(F.col("total_n") / 2)
    constant = rows.withColumn("_same", F.lit(0.0))
    marked = mark_first_k(constant, list(strata), "_same", key, k, EqualWidth(0.0, 1.0, 1), name="_treated").drop("_same")
    return marked.withColumn("arm", F.when(F.col("_treated"), "treatment").otherwise("control")).drop("_treated")


def ab_readout(assigned: DataFrame, outcome: str = "label") -> DataFrame:
    """Churn rate per arm, their difference and the two-proportion z statistic."""
    y = F.col(outcome).cast("double")
    arm = lambda a, c: F.when(F.col("arm") == a, c)
    agg = assigned.agg(
        F.count(arm("treatment", F.lit(1))).alias("n_treatment"),
        F.count(arm("control", F.lit(1))).alias("n_control"),
        F.avg(arm("treatment", y)).alias("rate_treatment"),
        F.avg(arm("control", y)).alias("rate_control"),
        F.avg(y).alias("_p"),
    )
    diff = F.col("rate_treatment") - F.col("rate_control")
    spread = F.sqrt(
        F.col("_p") * (1 - F.col("_p")) * (1 / F.nullif("n_treatment", F.lit(0)) + 1 / F.nullif("n_control", F.lit(0)))
    )
    return agg.withColumn("difference", diff).withColumn("z", C.ratio(diff, spread)).drop("_p")
