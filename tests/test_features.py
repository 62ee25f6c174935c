import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenuria.operators import cohort_features, features, silver, snapshots

P = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def three(spark):
    """Three customers with ten active days before P and two tickets."""
    customers = spark.createDataFrame(
        [
            ("C1", dt.date(2023, 12, 15), "smb", "Month-to-month", 500.0, False, None),
            ("C2", dt.date(2023, 10, 1), "mid_market", "One year", 2000.0, True, dt.date(2024, 1, 20)),
            ("C3", dt.date(2023, 1, 1), "enterprise", "Two year", 15000.0, False, None),
        ],
        "customer_id STRING, signup_date DATE, ltv_tier STRING, contract_type STRING, monthly_charges DOUBLE, "
        "churn_label BOOLEAN, churn_date DATE",
    )
    days = [(c, P - dt.timedelta(days=i), 1, 2, 10.0, 3) for c in ("C1", "C2", "C3") for i in range(1, 11)]
    daily = spark.createDataFrame(
        days,
        "customer_id STRING, activity_date DATE, login_count INT, features_used INT, session_duration_minutes DOUBLE, unique_features INT",
    )
    tickets = spark.createDataFrame(
        [("T1", "C1", P - dt.timedelta(days=5), 0.5, False), ("T2", "C2", P - dt.timedelta(days=20), -0.2, True)],
        "ticket_id STRING, customer_id STRING, created_date DATE, sentiment_score DOUBLE, escalated BOOLEAN",
    )
    return customers, daily, tickets


def test_cohort_variant(three):
    got = {r["customer_id"]: r for r in rows(cohort_features.features_cohort(*three, P))}
    assert [got[c]["cohort"] for c in ("C1", "C2", "C3")] == ["new_user", "established", "mature"]
    assert [got[c]["sample_weight"] for c in ("C1", "C2", "C3")] == [1.0, 3.0, 10.0]
    assert got["C1"]["logins_7d"] == 7 and got["C1"]["logins_30d"] is None
    assert got["C3"]["logins_14d"] == 10 and got["C3"]["logins_7d"] is None and got["C3"]["logins_60d"] == 10
    assert got["C2"]["escalation_rate_30d"] == 1.0 and got["C2"]["min_sentiment_30d"] == -0.2
    assert got["C3"]["tickets_30d"] == 0 and got["C3"]["min_sentiment_30d"] == 0.0
    assert got["C1"]["tenure_days"] == 0 and got["C1"]["estimated_ltv"] == 0.0
    assert got["C2"]["churned_in_window"] is True and got["C1"]["churned_in_window"] is False
    assert got["C1"]["days_to_first_login"] == 7 and got["C2"]["days_to_first_login"] is None
    assert got["C1"]["onboarding_completion_pct"] == pytest.approx(3 / 15)


def _silver(customers, tickets):
    full = customers.withColumns(
        {
            "tenure_days": F.datediff(F.lit(P), "signup_date"),
            "cohort": F.when(F.col("customer_id") == "C1", "new_user").otherwise("mature"),
            "contract_months": F.lit(1),
            "estimated_ltv": F.lit(100.0),
        }
    )
    return full, tickets.withColumnRenamed("escalated", "was_escalated")


def test_sql_variant(three):
    customers, daily, tickets = three
    c, t = _silver(customers, tickets)
    got = {r["customer_id"]: r for r in rows(features.customer_360(c, daily, t, P))}
    assert got["C1"]["logins_7d"] == 7 and got["C1"]["logins_14d"] == 10
    assert got["C1"]["avg_session_duration"] == 10.0
    assert got["C1"]["days_since_last_login"] == 1
    assert got["C1"]["login_velocity_wow"] == pytest.approx((7 - 3) / 3)
    assert got["C1"]["login_trend_4w"] == 0.0
    # signed up 17 days before P, first login 10 days before
    assert got["C1"]["days_to_first_login"] == 7
    assert got["C1"]["onboarding_completion_pct"] == pytest.approx(3 / 15)
    assert got["C2"]["days_to_first_login"] is None
    assert got["C2"]["churned_in_window"] is True
    assert len(got["C1"]) == 32


def test_rows_from_p_on_never_count(spark, three):
    customers, daily, tickets = three
    c, t = _silver(customers, tickets)
    later = daily.withColumn("activity_date", F.date_add("activity_date", 10)).where(F.col("activity_date") >= F.lit(P))
    before = rows(features.customer_360(c, daily, t, P), "customer_id")
    after = rows(features.customer_360(c, daily.unionByName(later), t, P), "customer_id")
    assert before == after


def test_activation_future_only_is_null_and_none_is_zero(spark):
    customers = spark.createDataFrame(
        [("A", P, "new_user"), ("B", P, "new_user")], "customer_id STRING, signup_date DATE, cohort STRING"
    ).withColumn("prediction_date", F.lit(P))
    daily = spark.createDataFrame(
        [("A", P, 1, 1)], "customer_id STRING, activity_date DATE, login_count INT, unique_features INT"
    )
    got = rows(features.activation(customers, daily))
    assert [(r["customer_id"], r["days_to_first_login"], r["first_week_logins"]) for r in got] == [("B", None, 0)]


def test_activation_equals_definition(spark):
    """First week by day, days before signup, several P, a day on signup + 7, no activity, activity from P on only."""
    signups = {"A": dt.date(2024, 1, 10), "B": dt.date(2024, 1, 20), "C": dt.date(2024, 1, 1), "D": dt.date(2024, 1, 25)}
    grid = [dt.date(2024, 1, 10), dt.date(2024, 1, 14), dt.date(2024, 1, 18), dt.date(2024, 1, 30)]
    base = [(c, p, s, "new_user") for c, s in signups.items() for p in grid if p >= s]
    days = [("A", dt.date(2024, 1, 5), 2, 3), ("A", dt.date(2024, 1, 10), 0, 5), ("A", dt.date(2024, 1, 13), 4, 1),
            ("A", dt.date(2024, 1, 17), 1, 2), ("A", dt.date(2024, 1, 18), 9, 9), ("B", dt.date(2024, 2, 3), 1, 1),
            ("C", dt.date(2024, 1, 9), 3, 3), ("D", dt.date(2024, 1, 25), 0, 4), ("E", dt.date(2024, 1, 1), 1, 1)]
    rows_df = spark.createDataFrame(base, "customer_id STRING, prediction_date DATE, signup_date DATE, cohort STRING")
    daily = spark.createDataFrame(days, "customer_id STRING, activity_date DATE, login_count INT, unique_features INT")
    sql, cohort = {}, {}
    for c, p, s, _ in base:
        own = [d for d in days if d[0] == c]
        known = [d for d in own if d[1] < p]
        week = [d for d in known if (d[1] - s).days <= 7]
        first = min(((d[1] - s).days for d in known if d[2] > 0), default=None)
        logins = sum(d[2] for d in week)
        if not own or known:
            sql[c, p] = (first, pytest.approx(sum(d[3] for d in week) / 15), logins)
        cohort[c, p] = (999 if first is None else first, pytest.approx(max((d[3] for d in week), default=0) / 15), logins)
    names = ("days_to_first_login", "onboarding_completion_pct", "first_week_logins")
    for operator, want in ((features.activation, sql), (cohort_features.activation, cohort)):
        got = {(r.customer_id, r.prediction_date): tuple(r[n] for n in names) for r in operator(rows_df, daily).collect()}
        assert got == want


def test_many_snapshots_equal_single_ones(spark, three):
    customers, daily, tickets = three
    c, t = _silver(customers, tickets)
    # sparse history: gaps longer than the windows, and activity before the first snapshot
    extra = daily.where("customer_id <> 'C2'").withColumn("activity_date", F.date_sub("activity_date", 75))
    daily = daily.unionByName(extra)
    dates = snapshots.date_grid(dt.date(2023, 10, 5), dt.date(2024, 3, 1), 13)
    for point_in_time in (False, True):
        many = rows(features.customer_360(c, daily, t, dates, point_in_time=point_in_time), "customer_id", "prediction_date")
        single = [r for d in dates for r in rows(features.customer_360(c, daily, t, d, point_in_time=point_in_time))]
        assert many == sorted(single, key=lambda r: (r["customer_id"], str(r["prediction_date"])))


def test_window_agg(three):
    _, daily, _ = three
    for how, want in {"sum": 7, "mean": 1.0, "count": 7, "max": 1, "min": 1, "std": 0.0, "last": 1}.items():
        got = rows(snapshots.window_agg(daily, "customer_id", "activity_date", "login_count", P, 7, how), "customer_id")
        assert got[0][f"login_count_{how}_7d"] == want
    with pytest.raises(ValueError):
        snapshots.window_agg(daily, None, "activity_date", "login_count", P, 7, "median")


def test_dedup_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 9, None)], "k INT, o INT, v STRING")
    got = rows(silver.dedup_first(df, ["k"], ["o"]), "k")
    assert [(r["k"], r["o"], r["v"]) for r in got] == [(1, 1, "a"), (2, 9, None)]
    assert rows(silver.dedup_report(df, ["k"])) == [{"rows_before": 4, "rows_after": 2, "rows_removed": 2}]


def test_ticket_days_outer_join(spark):
    daily = spark.createDataFrame(
        [("A", P, 1, 5.0, 2, 1)],
        "customer_id STRING, activity_date DATE, login_count INT, session_duration_minutes DOUBLE, features_used INT, unique_features INT",
    )
    opened = dt.datetime(2024, 1, 1, 9)
    tickets = spark.createDataFrame(
        [("A", opened, dt.datetime(2024, 1, 3)), ("B", opened, None)],
        "customer_id STRING, created_at TIMESTAMP, resolved_at TIMESTAMP",
    )
    got = [(r["customer_id"], str(r["activity_date"]), r["login_count"], r["support_tickets_opened"], r["support_tickets_resolved"])
           for r in rows(silver.with_ticket_days(daily, tickets), "customer_id", "activity_date")]
    assert got == [("A", "2024-01-01", 1, 1, 0), ("A", "2024-01-03", 0, 0, 1), ("B", "2024-01-01", 0, 1, 0)]


def test_even_and_uneven_grids_agree(spark):
    """Positions by arithmetic against the filter over dates that uneven grids use."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tenuria.operators import snapshots

    even = snapshots.date_grid("2024-01-10", "2024-04-01", 7)
    uneven = [*even, even[-1] + dt.timedelta(days=400)]
    assert snapshots.Grid.of(even) and not snapshots.Grid.of(uneven) and not snapshots.Grid.of(even[:1])
    days = spark.range(400).select((F.col("id") % 9).alias("customer_id"), F.expr("date_add(DATE '2023-11-01', cast(id * 7 % 199 as int))").alias("day"), (F.col("id") % 5).alias("v"))
    def run(dates):
        out = snapshots.snapshot_aggregate(days, "customer_id", "day", dates, 10, {"w": lambda a: F.when(a <= 10, F.col("v"))}, {"s": F.col("v")}, {"m": F.col("v")})
        return sorted(map(tuple, out.where(F.col("prediction_date") <= F.lit(even[-1])).collect()), key=str)
    assert run(even) == run(uneven)
    people = days.select("customer_id", F.col("day").alias("signup_date"))
    expand = lambda dates: sorted(map(str, snapshots.expand_base(people, dates).where(F.col("prediction_date") <= F.lit(even[-1])).collect()))
    assert expand(even) == expand(uneven)


def test_many_snapshots_shuffle_rows_once_by_customer(spark):
    """Before they are copied to their snapshots; the parts of the 360 then join as they lie."""
    dates = snapshots.date_grid("2024-01-10", "2024-04-01", 7)
    days = spark.range(500).selectExpr("id % 40 AS customer_id", "date_add(DATE '2024-01-01', cast(id % 90 AS int)) AS day", "id AS v")
    out = snapshots.snapshot_aggregate(days, "customer_id", "day", dates, 30, {"w": lambda a: F.when(a <= 30, F.col("v"))}, {"s": F.col("v")})
    other = days.repartition("customer_id").selectExpr("customer_id", "explode(array(DATE '2024-01-10', DATE '2024-01-17')) AS prediction_date")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (out, other.join(out, ["customer_id", "prediction_date"], "left"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1, 2]
