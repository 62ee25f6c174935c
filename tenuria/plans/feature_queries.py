"""Registered queries: gold features of both variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import cohort_features, declared, features, snapshots
from tenuria.plans import inputs
from tenuria.plans.check_ctes import gold
from tenuria.plans.inputs import A_DATE, B_DATE, account_tables, activity_tables
from tenuria.plans.registry import Check, query
from tenuria.session import stored
from tenuria.sources import activity

P_B = "DATE '2024-01-29'"
P_A = "DATE '1998-06-01'"


@query(
    "base_renewal_weight",
    Check(
        f"""
        SELECT customer_id, tenure_days % n.period AS into_period, n.period - tenure_days % n.period AS days_to_renewal,
            w.weight AS sample_weight
        FROM a_silver_customers c
        JOIN (VALUES ('Month-to-month', 30), ('One year', 365), ('Two year', 730)) n(contract, period) ON n.contract = contract_type
        JOIN (VALUES ('smb', 1.0), ('mid_market', 3.0), ('enterprise', 10.0)) w(tier, weight) ON w.tier = ltv_tier
        WHERE signup_date <= {P_A}""",
        "customer_id days_to_renewal", "sample_weight",
    ),
)
def base_renewal_weight(spark, d):
    return features.base(account_tables(spark, d).silver_customers, A_DATE).select(
        "customer_id", "days_to_renewal", "sample_weight"
    )


def _b_age(body):
    return f"WITH x AS (SELECT *, {P_B} - activity_date AS age FROM b_engagement WHERE activity_date < {P_B}) {body}"


_WINDOW_COLUMNS = "logins_7d logins_14d logins_30d features_used_7d features_used_30d"


def _engagement(columns):
    def run(spark, d):
        return features.engagement(activity_tables(spark, d).engagement, B_DATE).select("customer_id", *columns)

    return run


query(
    "engagement_windows",
    Check(
        _b_age("""
        SELECT customer_id, COALESCE(SUM(login_count) FILTER (WHERE age <= 7), 0) AS logins_7d, COALESCE(SUM(login_count) FILTER (WHERE age <= 14), 0) AS logins_14d,
            COALESCE(SUM(login_count) FILTER (WHERE age <= 30), 0) AS logins_30d, COALESCE(SUM(features_used) FILTER (WHERE age <= 7), 0) AS features_used_7d,
            COALESCE(SUM(features_used) FILTER (WHERE age <= 30), 0) AS features_used_30d,
            COALESCE(SUM(session_duration_minutes) FILTER (WHERE age <= 7), 0) AS session_minutes_7d,
            COALESCE(SUM(session_duration_minutes) FILTER (WHERE age <= 30), 0) AS session_minutes_30d FROM x GROUP BY customer_id"""),
        f"customer_id {_WINDOW_COLUMNS}", "session_minutes_7d session_minutes_30d",
    ),
)(_engagement((*_WINDOW_COLUMNS.split(), "session_minutes_7d", "session_minutes_30d")))

query(
    "feature_adoption",
    Check(_b_age("SELECT customer_id, MAX(unique_features) / 15.0::DOUBLE AS feature_adoption_pct FROM x GROUP BY customer_id"),
          "customer_id", "feature_adoption_pct"),
)(_engagement(("feature_adoption_pct",)))

query(
    "avg_session_sql",
    Check(
        _b_age("SELECT customer_id, COALESCE(AVG(session_duration_minutes / NULLIF(login_count, 0)), 0) AS avg_session_duration "
               "FROM x GROUP BY customer_id"),
        "customer_id", "avg_session_duration"),
)(_engagement(("avg_session_duration",)))

query(
    "recency",
    Check(
        _b_age("SELECT customer_id, COALESCE(MIN(CASE WHEN login_count > 0 THEN age END), 999) AS days_since_last_login, "
               "COALESCE(MIN(CASE WHEN features_used > 0 THEN age END), 999) AS days_since_last_feature_use FROM x GROUP BY customer_id"),
        "customer_id days_since_last_login days_since_last_feature_use"),
)(_engagement(("days_since_last_login", "days_since_last_feature_use")))

_B_WEEKS = _b_age("""
    SELECT customer_id, COALESCE(SUM(login_count) FILTER (WHERE age <= 7), 0) AS w1, COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 8 AND 14), 0) AS w2,
        COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 15 AND 21), 0) AS w3, COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 22 AND 28), 0) AS w4,
        COALESCE(SUM(features_used) FILTER (WHERE age <= 7), 0) AS f1, COALESCE(SUM(features_used) FILTER (WHERE age BETWEEN 8 AND 14), 0) AS f2,
        COALESCE(SUM(features_used) FILTER (WHERE age BETWEEN 15 AND 21), 0) AS f3, COALESCE(SUM(features_used) FILTER (WHERE age BETWEEN 22 AND 28), 0) AS f4,
        COALESCE(SUM(session_duration_minutes) FILTER (WHERE age <= 7), 0) AS m1, COALESCE(SUM(session_duration_minutes) FILTER (WHERE age BETWEEN 8 AND 14), 0) AS m2,
        COALESCE(SUM(features_used) FILTER (WHERE age <= 14), 0) AS f14, COALESCE(SUM(session_duration_minutes) FILTER (WHERE age <= 14), 0) AS m14,
        COUNT(*) FILTER (WHERE age <= 30 AND login_count > 0) AS active
    FROM x GROUP BY customer_id""")


def _velocity_sql(now, before):
    return f"CASE WHEN {before} > 0 THEN {now} / CAST({before} AS DOUBLE) - 1 WHEN {now} > 0 THEN 1 ELSE 0 END"


query(
    "velocity_wow",
    Check(
        f"SELECT customer_id, {_velocity_sql('w1', 'w2')} AS login_velocity_wow, {_velocity_sql('f1', 'f2')} AS feature_velocity_wow "
        "FROM b_weeks",
        "customer_id", "login_velocity_wow feature_velocity_wow", extra=(("b_weeks", _B_WEEKS),)),
)(_engagement(("login_velocity_wow", "feature_velocity_wow")))

query(
    "trend_4w_norm",
    Check(
        "SELECT customer_id, CASE WHEN w3 + w4 = 0 THEN 0 ELSE (w1 + w2 - (w3 + w4)) / CAST(1 + w1 + w2 + w3 + w4 AS DOUBLE) END "
        "AS login_trend_4w FROM b_weeks",
        "customer_id", "login_trend_4w", extra=(("b_weeks", _B_WEEKS),)),
)(_engagement(("login_trend_4w",)))


@query(
    "support_sql",
    Check(
        f"""
        SELECT customer_id, COUNT(*) FILTER (WHERE recent) AS tickets_30d,
            COALESCE(AVG(sentiment_score) FILTER (WHERE recent), 0) AS avg_sentiment_30d,
            COUNT(*) FILTER (WHERE recent AND was_escalated) / CAST(COUNT(*) AS DOUBLE) AS escalation_rate_30d
        FROM (SELECT *, {P_B} - created_date <= 30 AS recent FROM b_silver_tickets WHERE created_date < {P_B}) GROUP BY customer_id""",
        "customer_id tickets_30d", "avg_sentiment_30d escalation_rate_30d",
    ),
)
def support_sql(spark, d):
    return features.support(activity_tables(spark, d).silver_tickets, B_DATE).drop("prediction_date")


@query(
    "activation_sql",
    Check(
        f"""
        SELECT c.customer_id, MIN(CASE WHEN login_count > 0 THEN activity_date - signup_date END) AS days_to_first_login,
            COALESCE(SUM(unique_features) FILTER (WHERE activity_date - signup_date <= 7), 0) / CAST(15 AS DOUBLE) AS onboarding_completion_pct,
            COALESCE(SUM(login_count) FILTER (WHERE activity_date - signup_date <= 7), 0) AS first_week_logins
        FROM b_silver_customers c LEFT JOIN b_engagement e ON e.customer_id = c.customer_id
        WHERE cohort = 'new_user' AND signup_date <= {P_B} AND (activity_date IS NULL OR activity_date < {P_B})
        GROUP BY c.customer_id""",
        "customer_id days_to_first_login first_week_logins", "onboarding_completion_pct",
    ),
)
def activation_sql(spark, d):
    t = activity_tables(spark, d)
    return features.activation(features.base(t.silver_customers, B_DATE), t.engagement).drop("prediction_date")


@query(
    "contract_value_remaining",
    Check("SELECT customer_id, contract_value_remaining FROM b_gold", "customer_id", "contract_value_remaining"),
)
def contract_value_remaining(spark, d):
    base = features.base(activity_tables(spark, d).silver_customers, B_DATE)
    renewal = F.coalesce("days_to_renewal", F.col("contract_months") * 30)
    return base.select("customer_id", C.contract_value("monthly_charges", renewal).alias("contract_value_remaining"))


@query(
    "label_window",
    Check(
        f"SELECT customer_id, (churn_date IS NOT NULL AND churn_date - {P_A} BETWEEN 1 AND 90) IS TRUE AS churned_in_window "
        f"FROM a_silver_customers WHERE signup_date <= {P_A}",
        "customer_id", "", "churned_in_window",
    ),
)
def label_window(spark, d):
    base = features.base(account_tables(spark, d).silver_customers, A_DATE)
    return base.select("customer_id", C.churned_within("churn_date", A_DATE, inputs.A_HORIZON).alias("churned_in_window"))


def gold_check(body: str, windows=(7, 14, 30), **extra) -> Check:
    s, m, l = windows
    return Check(
        body,
        f"customer_id days_to_first_login first_week_logins logins_{s}d logins_{m}d logins_{l}d features_used_{s}d "
        f"features_used_{l}d days_since_last_login days_since_last_feature_use tickets_{l}d days_to_renewal tenure_days",
        f"onboarding_completion_pct feature_adoption_pct session_minutes_{s}d session_minutes_{l}d avg_session_duration "
        f"login_velocity_wow feature_velocity_wow login_trend_4w avg_sentiment_{l}d escalation_rate_{l}d "
        "contract_value_remaining estimated_ltv sample_weight",
        "prediction_date cohort ltv_tier contract_type churned_in_window churn_date",
        **extra,
    )


@query("customer_360", gold_check("SELECT * FROM b_gold"))
def customer_360(spark, d):
    return inputs.activity_gold(spark, d)


@query("customer_360_accounts", gold_check("SELECT * FROM a_gold", inputs.A_WINDOWS))
def customer_360_accounts(spark, d):
    return inputs.account_gold(spark, d)


@query(
    "snapshots_weekly",
    gold_check(
        "SELECT * FROM weekly",
        extra=(
            ("b_last", "SELECT DATE '2024-01-30' AS last_day"),
            ("weekly_p", "SELECT DATE '2001-05-02' + CAST(i AS INTEGER) AS p FROM range(0, 61, 7) t(i)"),
            ("weekly", gold("a_", "weekly_p")),
        ),
    ),
)
def snapshots_weekly(spark, d):
    """Nine weekly snapshots in one job: from 90 to 30 days before the last day of data."""
    return account_tables(spark, d).gold(snapshots.date_grid("2001-05-02", "2001-07-01", 7))


@query("snapshots_model", gold_check("SELECT * FROM a_train", inputs.A_WINDOWS))
def snapshots_model(spark, d):
    return inputs.account_gold(spark, d, inputs.A_SNAPSHOTS)


@query(
    "gold_check_by_cohort",
    Check(
        "SELECT cohort, COUNT(*) AS n_customers, COUNT(*) FILTER (WHERE churned_in_window) / CAST(COUNT(*) AS DOUBLE) AS churn_rate "
        "FROM a_train GROUP BY cohort",
        "n_customers", "churn_rate", "cohort",
    ),
)
def gold_check_by_cohort(spark, d):
    return features.gold_check(inputs.account_gold(spark, d, inputs.A_SNAPSHOTS))


# -- cohort variant -------------------------------------------------------------

_COHORT_ROWS = f"""
    SELECT *, {P_A} - signup_date AS age_at_p,
        CASE WHEN {P_A} - signup_date > 180 THEN 'mature' WHEN {P_A} - signup_date > 30 THEN 'established' ELSE 'new_user' END AS stage
    FROM a_customers WHERE signup_date <= {P_A}"""
_COHORT_SPANS = """
    SELECT * FROM (VALUES ('new_user', 7, 14, 14), ('established', 7, 14, 30), ('mature', 14, 30, 60)) v(stage, ws, wm, wl)"""
_COHORT_DAYS = f"SELECT *, {P_A} - activity_date AS age FROM a_engagement WHERE activity_date < {P_A}"


def _cohort_windows_sql(measures) -> str:
    parts = []
    for name, source in measures.items():
        for w in cohort_features.ALL_WINDOWS:
            parts.append(
                f"CASE WHEN {w} IN (ANY_VALUE(ws), ANY_VALUE(wm), ANY_VALUE(wl)) THEN "
                f"COALESCE(SUM({source}) FILTER (WHERE age <= {w}), 0) END AS {name}_{w}d"
            )
    return ",\n".join(parts)


_COHORT_ENGAGEMENT = f"""
    SELECT r.customer_id, {_cohort_windows_sql(cohort_features.MEASURES)},
        COALESCE(MIN(age) FILTER (WHERE login_count > 0), 999) AS days_since_last_login,
        COALESCE(MIN(age) FILTER (WHERE features_used > 0), 999) AS days_since_last_feature_use,
        COALESCE(MAX(unique_features), 0) / CAST(15 AS DOUBLE) AS feature_adoption_pct,
        COALESCE(SUM(session_duration_minutes) / NULLIF(SUM(login_count), 0), 0) AS avg_session_duration,
        COALESCE(SUM(login_count) FILTER (WHERE age <= 7), 0) AS w1, COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 8 AND 14), 0) AS w2,
        COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 15 AND 21), 0) AS w3, COALESCE(SUM(login_count) FILTER (WHERE age BETWEEN 22 AND 28), 0) AS w4,
        COALESCE(SUM(features_used) FILTER (WHERE age <= 7), 0) AS f1, COALESCE(SUM(features_used) FILTER (WHERE age BETWEEN 8 AND 14), 0) AS f2
    FROM coh_rows r JOIN coh_spans s ON r.stage = s.stage LEFT JOIN coh_days d ON d.customer_id = r.customer_id
    GROUP BY r.customer_id"""
_COHORT_SUPPORT = f"""
    SELECT r.customer_id, COUNT(ticket_id) AS tickets_30d, COALESCE(AVG(CAST(sentiment_score AS DOUBLE)), 0) AS avg_sentiment_30d,
        COALESCE(MIN(sentiment_score), 0) AS min_sentiment_30d,
        COALESCE(AVG(CASE WHEN escalated THEN 1.0 WHEN NOT escalated THEN 0.0 END), 0) AS escalation_rate_30d
    FROM coh_rows r LEFT JOIN a_tickets t ON t.customer_id = r.customer_id AND {P_A} - CAST(created_at AS DATE) BETWEEN 1 AND 30
    GROUP BY r.customer_id"""
_COHORT_ACTIVATION = f"""
    SELECT r.customer_id, COALESCE(MIN(activity_date - signup_date) FILTER (WHERE login_count > 0), 999) AS days_to_first_login,
        COALESCE(SUM(login_count) FILTER (WHERE activity_date - signup_date <= 7), 0) AS first_week_logins,
        COALESCE(MAX(unique_features) FILTER (WHERE activity_date - signup_date <= 7), 0) / CAST(15 AS DOUBLE) AS onboarding_completion_pct
    FROM coh_rows r LEFT JOIN coh_days d ON d.customer_id = r.customer_id WHERE stage = 'new_user' GROUP BY r.customer_id"""
_COHORT_CONTRACT = """
    SELECT customer_id, tenure_days, estimated_ltv, period - tenure_days % period AS days_to_renewal, code AS contract_type_encoded,
        CAST(monthly_charges AS DOUBLE) * ((period - tenure_days % period) / CAST(30 AS DOUBLE)) AS contract_value_remaining
    FROM coh_rows r JOIN (VALUES ('Month-to-month', 30, 0), ('One year', 365, 1), ('Two year', 730, 2)) v(contract, period, code)
      ON v.contract = contract_type"""
_COHORT = (
    ("coh_rows", _COHORT_ROWS),
    ("coh_spans", _COHORT_SPANS),
    ("coh_days", _COHORT_DAYS),
    ("coh_engagement", _COHORT_ENGAGEMENT),
    ("coh_support", _COHORT_SUPPORT),
    ("coh_activation", _COHORT_ACTIVATION),
    ("coh_contract", _COHORT_CONTRACT),
)


@query(
    "cohort_at_prediction",
    Check("SELECT customer_id, age_at_p AS tenure_at_prediction, stage AS cohort FROM coh_rows",
          "customer_id tenure_at_prediction", "", "cohort", extra=_COHORT),
)
def cohort_at_prediction(spark, d):
    return cohort_features.cohort_at_prediction(account_tables(spark, d).customers, A_DATE).select(
        "customer_id", "tenure_at_prediction", "cohort"
    )


@query(
    "cohort_windows",
    Check("SELECT customer_id, ws AS window_short, wm AS window_medium, wl AS window_long FROM coh_rows r JOIN coh_spans s ON r.stage = s.stage",
          "customer_id window_short window_medium window_long", extra=_COHORT),
)
def cohort_windows(spark, d):
    rows = cohort_features.cohort_at_prediction(account_tables(spark, d).customers, A_DATE)
    return cohort_features.cohort_windows(rows).select("customer_id", "window_short", "window_medium", "window_long")


_CW = [f"{m}_{w}d" for m in cohort_features.MEASURES for w in cohort_features.ALL_WINDOWS]
_CW_INTS = " ".join(c for c in _CW if not c.startswith("session"))
_CW_REALS = " ".join(c for c in _CW if c.startswith("session"))


def _cohort_engagement(columns):
    def run(spark, d):
        t = account_tables(spark, d)
        rows = cohort_features.cohort_at_prediction(t.customers, A_DATE)
        return cohort_features.engagement(rows, t.engagement, A_DATE).select("customer_id", *columns)

    return run


query(
    "engagement_cohort",
    Check(f"SELECT customer_id, {', '.join(_CW)} FROM coh_engagement", f"customer_id {_CW_INTS}", _CW_REALS, extra=_COHORT),
)(_cohort_engagement(_CW))
query(
    "recency_cohort",
    Check("SELECT * FROM coh_engagement", "customer_id days_since_last_login days_since_last_feature_use", "feature_adoption_pct",
          extra=_COHORT),
)(_cohort_engagement(["days_since_last_login", "days_since_last_feature_use", "feature_adoption_pct"]))
query(
    "avg_session_ratio",
    Check("SELECT * FROM coh_engagement", "customer_id", "avg_session_duration", extra=_COHORT),
)(_cohort_engagement(["avg_session_duration"]))
_SLOPE_SQL = """SELECT customer_id, REGR_SLOPE(y, x) AS login_trend_4w FROM (
    SELECT customer_id, UNNEST([1, 2, 3, 4]) AS x, UNNEST([w4, w3, w2, w1]) AS y FROM coh_engagement) GROUP BY customer_id"""
query("trend_slope", Check(_SLOPE_SQL, "customer_id", "login_trend_4w", extra=_COHORT))(_cohort_engagement(["login_trend_4w"]))


def _cohort_tickets(t):
    return t.tickets.withColumn("created_date", F.to_date("created_at"))


@query(
    "support_cohort",
    Check("SELECT * FROM coh_support", "customer_id tickets_30d", "avg_sentiment_30d min_sentiment_30d escalation_rate_30d",
          extra=_COHORT),
)
def support_cohort(spark, d):
    t = account_tables(spark, d)
    rows = cohort_features.cohort_at_prediction(t.customers, A_DATE)
    return cohort_features.support(rows, _cohort_tickets(t), A_DATE).drop("prediction_date")


@query(
    "activation_cohort",
    Check("SELECT * FROM coh_activation", "customer_id days_to_first_login first_week_logins", "onboarding_completion_pct",
          extra=_COHORT),
)
def activation_cohort(spark, d):
    t = account_tables(spark, d)
    rows = cohort_features.cohort_at_prediction(t.customers, A_DATE)
    return cohort_features.activation(rows, t.engagement).drop("prediction_date")


@query(
    "contract_cohort",
    Check("SELECT * FROM coh_contract", "customer_id days_to_renewal contract_type_encoded tenure_days",
          "contract_value_remaining estimated_ltv", extra=_COHORT),
)
def contract_cohort(spark, d):
    rows = cohort_features.cohort_at_prediction(account_tables(spark, d).customers, A_DATE)
    return cohort_features.contract(rows).drop("prediction_date")


@query(
    "label_cohort",
    Check(f"SELECT customer_id, (churn_label AND churn_date - {P_A} BETWEEN 1 AND 30) IS TRUE AS churned_in_window FROM coh_rows",
          "customer_id", "", "churned_in_window", extra=_COHORT),
)
def label_cohort(spark, d):
    rows = cohort_features.cohort_at_prediction(account_tables(spark, d).customers, A_DATE)
    return rows.select("customer_id", cohort_features.label().alias("churned_in_window"))


@query(
    "label_by_cohort",
    Check(
        f"SELECT customer_id, stage AS cohort, (churn_label AND churn_date - {P_A} BETWEEN 1 AND "
        "CASE stage WHEN 'mature' THEN 90 ELSE 30 END) IS TRUE AS churned_in_window FROM coh_rows",
        "customer_id", "", "cohort churned_in_window", extra=_COHORT),
)
def label_by_cohort(spark, d):
    rows = cohort_features.cohort_at_prediction(account_tables(spark, d).customers, A_DATE)
    return rows.select("customer_id", "cohort", cohort_features.label_by_cohort().alias("churned_in_window"))


@query(
    "sample_weights",
    Check("SELECT customer_id, CASE WHEN ltv_tier = 'enterprise' THEN 10 WHEN ltv_tier = 'mid_market' THEN 3 ELSE 1 END AS sample_weight FROM a_customers",
          "customer_id", "sample_weight"),
)
def sample_weights(spark, d):
    return account_tables(spark, d).customers.select("customer_id", C.sample_weight("ltv_tier").alias("sample_weight"))


@query(
    "features_cohort",
    Check(
        f"""
        SELECT r.customer_id, {P_A} AS prediction_date, stage AS cohort, r.ltv_tier, e.* EXCLUDE (customer_id, w1, w2, w3, w4, f1, f2),
            {_velocity_sql('e.w1', 'e.w2')} AS login_velocity_wow, {_velocity_sql('e.f1', 'e.f2')} AS feature_velocity_wow,
            l.login_trend_4w, s.* EXCLUDE (customer_id), a.* EXCLUDE (customer_id), k.* EXCLUDE (customer_id),
            (churn_label AND churn_date - {P_A} BETWEEN 1 AND 30) IS TRUE AS churned_in_window, r.sample_weight
        FROM coh_rows r JOIN coh_engagement e ON e.customer_id = r.customer_id JOIN coh_support s ON s.customer_id = r.customer_id
        JOIN coh_contract k ON k.customer_id = r.customer_id JOIN coh_slope l ON l.customer_id = r.customer_id
        LEFT JOIN coh_activation a ON a.customer_id = r.customer_id""",
        f"customer_id {_CW_INTS} days_since_last_login days_since_last_feature_use tickets_30d days_to_first_login first_week_logins "
        "days_to_renewal contract_type_encoded tenure_days",
        f"{_CW_REALS} feature_adoption_pct avg_session_duration login_velocity_wow feature_velocity_wow login_trend_4w avg_sentiment_30d "
        "min_sentiment_30d escalation_rate_30d onboarding_completion_pct contract_value_remaining estimated_ltv sample_weight",
        "prediction_date cohort ltv_tier churned_in_window",
        extra=(*_COHORT, ("coh_slope", _SLOPE_SQL)),
    ),
)
def features_cohort(spark, d):
    t = account_tables(spark, d)
    return cohort_features.features_cohort(stored(t.customers), stored(t.engagement), _cohort_tickets(t), A_DATE)


@query(
    "window_agg",
    Check(
        "SELECT customer_id, STDDEV_SAMP(login_count) AS login_count_std_14d "
        f"FROM b_engagement WHERE {P_B} - activity_date BETWEEN 1 AND 14 GROUP BY customer_id",
        "customer_id", "login_count_std_14d",
    ),
)
def window_agg(spark, d):
    daily = activity_tables(spark, d).engagement
    return snapshots.window_agg(daily, "customer_id", "activity_date", "login_count", B_DATE, 14, "std")


# -- declared features ----------------------------------------------------------


@query(
    "feat_declared_engagement",
    Check(
        f"""SELECT customer_id, f14 AS features_used_14d, m14 AS session_minutes_14d, {_velocity_sql('m1', 'm2')} AS session_velocity_wow,
            CASE WHEN f3 + f4 > 0 THEN (f1 + f2 - f3 - f4) / CAST(f1 + f2 + f3 + f4 + 1 AS DOUBLE) ELSE 0 END AS feature_trend_4w,
            ({_velocity_sql('w1', 'w2')}) - ({_velocity_sql('w2', 'w3')}) AS login_acceleration, active / CAST(30 AS DOUBLE) AS dau_mau_ratio
        FROM b_weeks""",
        "customer_id features_used_14d",
        "session_minutes_14d session_velocity_wow feature_trend_4w login_acceleration dau_mau_ratio",
        extra=(("b_weeks", _B_WEEKS),),
    ),
)
def feat_declared_engagement(spark, d):
    return declared.engagement(activity_tables(spark, d).engagement, B_DATE).drop("prediction_date")


@query(
    "feat_declared_support",
    Check(
        f"""SELECT customer_id, COUNT(*) FILTER (WHERE age <= 7) AS tickets_7d, COUNT(*) FILTER (WHERE age <= 90) AS tickets_90d,
            COALESCE(AVG(CASE WHEN sentiment_score < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE age <= 30), 0) AS negative_ticket_pct,
            COALESCE(AVG(resolution_days) FILTER (WHERE age <= 30), 0) AS avg_resolution_days_30d
        FROM (SELECT *, {P_B} - created_date AS age FROM b_silver_tickets WHERE created_date < {P_B}) GROUP BY customer_id""",
        "customer_id tickets_7d tickets_90d", "negative_ticket_pct avg_resolution_days_30d",
    ),
)
def feat_declared_support(spark, d):
    return declared.support(activity_tables(spark, d).silver_tickets, B_DATE).drop("prediction_date")


def _payload_key():
    return F.get_json_object("event_properties", "$.k").cast("int")


@query(
    "feat_declared_activation",
    Check(
        f"""
        SELECT b.customer_id, days_to_first_feature_use, first_week_features_used, first_week_session_minutes,
            COALESCE(steps, 0) AS setup_steps_completed
        FROM (SELECT c.customer_id, MIN(activity_date - signup_date) FILTER (WHERE features_used > 0) AS days_to_first_feature_use,
                COALESCE(SUM(features_used) FILTER (WHERE activity_date - signup_date <= 7), 0) AS first_week_features_used,
                COALESCE(SUM(session_duration_minutes) FILTER (WHERE activity_date - signup_date <= 7), 0) AS first_week_session_minutes
              FROM b_life c LEFT JOIN b_engagement e ON e.customer_id = c.customer_id AND activity_date < {P_B}
              WHERE signup_date <= {P_B} GROUP BY c.customer_id) b
        LEFT JOIN (SELECT customer_id, COUNT(DISTINCT json_extract_string(props, '$.k')) AS steps
              FROM events JOIN b_life ON user_id = customer_id
              WHERE event_type IN ('click', 'purchase') AND CAST(ts AS DATE) < {P_B}
                AND CAST(ts AS DATE) - signup_date BETWEEN 0 AND 13 GROUP BY customer_id) s ON s.customer_id = b.customer_id""",
        "customer_id days_to_first_feature_use first_week_features_used setup_steps_completed", "first_week_session_minutes",
    ),
)
def feat_declared_activation(spark, d):
    days = activity.user_days(spark, d)
    events = activity.bronze_events(spark, d)
    return declared.activation(activity.lifetimes(days), days, events, B_DATE, _payload_key(), ("click", "purchase"))


@query(
    "feat_declared_billing",
    Check(
        f"""
        SELECT user_id AS customer_id,
            COUNT(*) FILTER (WHERE event_type = 'purchase' AND k % 10 = 0 AND {P_B} - CAST(ts AS DATE) <= 90) AS payment_failures_90d,
            COUNT(*) FILTER (WHERE event_type = 'purchase' AND k % 10 = 1 AND {P_B} - CAST(ts AS DATE) <= 90) AS late_payments_90d,
            COUNT(*) FILTER (WHERE event_type = 'signup' AND k % 2 = 0) AS previous_renewals,
            COUNT(*) FILTER (WHERE event_type = 'signup' AND k % 2 = 1) AS expansion_events
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        WHERE CAST(ts AS DATE) < {P_B} GROUP BY user_id""",
        "customer_id payment_failures_90d late_payments_90d previous_renewals expansion_events",
    ),
)
def feat_declared_billing(spark, d):
    k = _payload_key()
    paid, contract = F.col("event_type") == "purchase", F.col("event_type") == "signup"
    return declared.billing(
        activity.bronze_events(spark, d),
        B_DATE,
        failed=paid & (k % 10 == 0),
        late=paid & (k % 10 == 1),
        renewal=contract & (k % 2 == 0),
        expansion=contract & (k % 2 == 1),
    )
