"""Registered queries: contributions, interventions, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import explain, interventions, quality
from tenuria.operators.intervention_rules import rule_rows
from tenuria.plans.check_ctes import gold
from tenuria.plans.inputs import A_DATE, account_tables, activity_gold
from tenuria.plans.registry import Check, query
from tenuria.session import stored

# Fixed coefficients of the linear model the explanations are checked with.
COEFFICIENTS = {
    "logins_7d": -0.08,
    "logins_14d": -0.03,
    "logins_30d": -0.01,
    "days_since_last_login": 0.005,
    "feature_adoption_pct": -0.9,
    "features_used_7d": -0.02,
    "login_velocity_wow": -0.6,
    "login_trend_4w": -0.5,
    "tickets_30d": 0.04,
    "avg_sentiment_30d": -0.7,
    "escalation_rate_30d": 1.1,
    "days_to_renewal": -0.004,
    "contract_value_remaining": 0.00001,
    "onboarding_completion_pct": -0.3,
    "days_to_first_login": 0.1,
    "first_week_logins": -0.05,
    "tenure_days": 0.001,
}
KEEP = ["customer_id", "cohort", "ltv_tier", "score"]

_ROWS = (
    ("g_rows", gold("a_", "a_p", point_in_time=True, active_only=True)),
    ("g_score", "SELECT *, CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score FROM g_rows"),
    ("g_mean", "SELECT " + ", ".join(f"AVG(COALESCE(CAST({f} AS DOUBLE), 0)) AS m_{f}" for f in COEFFICIENTS) + " FROM g_score"),
    ("contrib", " UNION ALL ".join(
        f"SELECT customer_id, cohort, ltv_tier, score, '{f}' AS feature, COALESCE(CAST({f} AS DOUBLE), 0) AS feature_value, "
        f"ROUND({c}::DOUBLE * (COALESCE(CAST({f} AS DOUBLE), 0) - m_{f}), 6) + 0.0 AS contribution FROM g_score, g_mean"
        for f, c in COEFFICIENTS.items())),
    ("g_base", "SELECT ROUND(" + " + ".join(f"{c}::DOUBLE * m_{f}" for f, c in COEFFICIENTS.items()) + ", 6) AS base_value FROM g_mean"),
    ("sized", "SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ABS(contribution) DESC, feature) AS pos FROM contrib"),
    ("importance", "SELECT *, ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS rank FROM ("
                   "SELECT feature, AVG(ABS(contribution)) AS importance, COUNT(*) AS n_samples FROM contrib GROUP BY feature)"),
    ("coh_importance", "SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY importance DESC, feature) AS rank FROM ("
                       "SELECT cohort, feature, AVG(ABS(contribution)) AS importance, COUNT(*) AS n_samples FROM contrib GROUP BY cohort, feature)"),
    ("rules", "SELECT * FROM (VALUES " + ", ".join(
        f"('{r['feature']}', {r['seq']}, '{r['op']}', {r['threshold']}, '{r['action']}', '{r['priority']}', {r['rank']}, '{r['category']}')"
        for r in rule_rows()) + ") v(feature, seq, op, threshold, action, priority, urgency, category)"),
    ("matches", """
        SELECT * FROM (SELECT s.*, seq, action, priority, urgency, category,
                ROW_NUMBER() OVER (PARTITION BY customer_id, s.feature ORDER BY seq) AS nth
            FROM sized s JOIN rules r ON r.feature = s.feature
            WHERE contribution > 0 AND ((op = '<' AND feature_value < threshold) OR (op = '>' AND feature_value > threshold) OR op = 'any'))
        WHERE nth = 1"""),
    ("plan", """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY urgency, contribution DESC, feature) AS rank FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id, action ORDER BY urgency, contribution DESC, feature) AS again
            FROM matches WHERE pos <= 15) WHERE again = 1"""),
    ("planned", """
        SELECT *, score AS churn_probability, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.5 THEN 'medium' WHEN score < 0.7 THEN 'high' ELSE 'critical' END AS risk_level,
            COUNT(*) OVER (PARTITION BY customer_id) AS total_interventions FROM plan WHERE rank <= 5"""),
)


def _rows(spark, d):
    rows = account_tables(spark, d).gold(A_DATE, point_in_time=True, active_only=True)
    return rows.withColumn("score", ((F.col("customer_id") * 7919) % 1000).cast("double") / 1000.0)


def _explained(spark, d):
    # Read twice: for the means and for the rows.
    return explain.linear_contributions(stored(_rows(spark, d)), COEFFICIENTS, KEEP, decimals=6)


def _long(spark, d):
    return explain.exploded(_explained(spark, d), KEEP)


@query(
    "contributions_linear",
    Check("SELECT customer_id, feature, feature_value, contribution FROM contrib", "customer_id", "feature_value contribution", "feature", _ROWS),
)
def contributions_linear(spark, d):
    return _long(spark, d).select("customer_id", "feature", "feature_value", "contribution")


@query(
    "explain_sample",
    Check("SELECT customer_id, score FROM g_score ORDER BY MD5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT 1000",
          "customer_id", "score", extra=_ROWS),
)
def explain_sample(spark, d):
    return explain.sample(_rows(spark, d), 1000).select("customer_id", "score")


@query("global_importance", Check("SELECT * FROM importance", "n_samples rank", "importance", "feature", _ROWS))
def global_importance(spark, d):
    return explain.global_importance(_long(spark, d))


@query("top_drivers", Check("SELECT feature, rank FROM importance WHERE rank <= 10", "rank", "", "feature", _ROWS))
def top_drivers(spark, d):
    return explain.top_drivers(explain.global_importance(_long(spark, d)), 10).select("feature", "rank")


@query(
    "local_explanation",
    Check(
        "SELECT customer_id, score AS churn_probability, base_value, pos AS rank, feature, feature_value, contribution, "
        "CASE WHEN contribution > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM sized, g_base WHERE pos <= 5",
        "customer_id rank", "churn_probability base_value feature_value contribution", "feature direction", _ROWS),
)
def local_explanation(spark, d):
    return explain.local_explanation(_explained(spark, d), ["customer_id", "score", "base_value"]).withColumnRenamed(
        "score", "churn_probability"
    )


@query("cohort_drivers", Check("SELECT * FROM coh_importance WHERE rank <= 10", "n_samples rank", "importance", "cohort feature", _ROWS))
def cohort_drivers(spark, d):
    return explain.top_drivers(explain.global_importance(_long(spark, d), ["cohort"]), 10)


@query(
    "waterfall_rows",
    Check(
        """
        SELECT customer_id, 0 AS step, 'Base Value' AS name, base_value AS value, base_value AS running_total FROM (SELECT DISTINCT customer_id FROM contrib), g_base
        UNION ALL SELECT customer_id, pos, feature, contribution, base_value + SUM(contribution) OVER (PARTITION BY customer_id ORDER BY pos)
            FROM (SELECT * FROM sized WHERE pos <= 5), g_base
        UNION ALL SELECT customer_id, 6, 'Final Prediction', SUM(contribution) FILTER (WHERE pos > 5), ANY_VALUE(base_value) + SUM(contribution)
            FROM sized, g_base GROUP BY customer_id""",
        "customer_id step", "value running_total", "name", _ROWS),
)
def waterfall_rows(spark, d):
    return explain.waterfall(_explained(spark, d), ["customer_id"])


@query(
    "beeswarm_rows",
    Check(
        "SELECT customer_id, c.feature, rank, contribution, (feature_value - lo) / (hi - lo + 1e-8::DOUBLE) AS feature_value_norm FROM contrib c "
        "JOIN (SELECT feature, MIN(feature_value) AS lo, MAX(feature_value) AS hi FROM contrib GROUP BY feature) r ON r.feature = c.feature "
        "JOIN importance i ON i.feature = c.feature WHERE rank <= 10",
        "customer_id rank", "contribution feature_value_norm", "feature", _ROWS),
)
def beeswarm_rows(spark, d):
    long = explain.exploded(stored(_explained(spark, d)), KEEP)
    return explain.beeswarm(long, explain.global_importance(long), 10).select(
        "customer_id", "feature", "rank", "contribution", "feature_value_norm"
    )


@query(
    "intervention_match",
    Check("SELECT * FROM matches", "customer_id", "feature_value contribution", "feature action priority category", _ROWS),
)
def intervention_match(spark, d):
    return interventions.match_rules(_explained(spark, d), ["customer_id"]).drop("business_context")


@query(
    "intervention_plan",
    Check("SELECT * FROM planned", "customer_id rank total_interventions", "churn_probability feature_value contribution",
          "risk_level feature action priority category", _ROWS),
)
def intervention_plan(spark, d):
    return interventions.plan_rows(interventions.plans(_explained(spark, d), ["customer_id"]), ["customer_id"])


@query(
    "intervention_categories",
    Check("SELECT customer_id, category, STRING_AGG(action, '; ' ORDER BY rank) AS actions FROM planned GROUP BY customer_id, category",
          "customer_id", "", "category actions", _ROWS),
)
def intervention_categories(spark, d):
    planned = interventions.plans(_explained(spark, d), ["customer_id"])
    return interventions.category_rows(planned, ["customer_id"]).select(
        "customer_id", "category", F.array_join("actions", "; ").alias("actions")
    )


@query(
    "risk_level",
    Check("SELECT customer_id, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM a_scored",
          "customer_id", "", "risk_level"),
)
def risk_level(spark, d):
    from tenuria.plans.inputs import scored

    return scored(spark, d).select("customer_id", C.risk_level("score").alias("risk_level"))


@query(
    "cohort_interventions",
    Check("SELECT cohort, i.feature, action, priority, category FROM coh_importance i JOIN rules r ON r.feature = i.feature WHERE rank <= 10",
          "", "", "cohort feature action priority category", _ROWS),
)
def cohort_interventions(spark, d):
    drivers = explain.top_drivers(explain.global_importance(_long(spark, d), ["cohort"]), 10)
    return interventions.cohort_interventions(drivers).select("cohort", "feature", "action", "priority", "category")


@query(
    "priority_matrix",
    Check("SELECT category, priority, COUNT(*) AS n FROM planned GROUP BY category, priority", "n", "", "category priority", _ROWS),
)
def priority_matrix(spark, d):
    planned = interventions.plan_rows(interventions.plans(_explained(spark, d), ["customer_id"]), ["customer_id"])
    return interventions.priority_matrix(planned)


@query(
    "top_risk_customers",
    Check(
        """SELECT g.customer_id, g.cohort, g.ltv_tier, g.score AS churn_probability,
            CASE WHEN g.score < 0.3 THEN 'low' WHEN g.score < 0.5 THEN 'medium' WHEN g.score < 0.7 THEN 'high' ELSE 'critical' END AS risk_level,
            COALESCE(STRING_AGG(action, '; ' ORDER BY rank), '') AS actions, COUNT(action) AS total_interventions
        FROM (SELECT * FROM g_score ORDER BY score DESC, customer_id LIMIT 10) g LEFT JOIN planned p ON p.customer_id = g.customer_id
        GROUP BY g.customer_id, g.cohort, g.ltv_tier, g.score""",
        "customer_id total_interventions", "churn_probability", "cohort ltv_tier risk_level actions", _ROWS),
)
def top_risk_customers(spark, d):
    planned = interventions.top_risk(_explained(spark, d), ["customer_id", "cohort", "ltv_tier"], 10)
    actions = F.array_join(F.transform("recommended_interventions", lambda a: a["action"]), "; ")
    return planned.select(
        "customer_id", "cohort", "ltv_tier", "churn_probability", "risk_level", actions.alias("actions"), "total_interventions"
    )


# -- data quality -------------------------------------------------------------------


def _dq_sql(table, source, required, negative, domains, key):
    parts = [(f"{c}_required", f"COUNT(*) FILTER (WHERE {c} IS NULL)") for c in required]
    parts += [(f"{c}_not_negative", f"COUNT(*) FILTER (WHERE {c} < 0)") for c in negative]
    parts += [
        (f"{c}_known", f"COUNT(*) FILTER (WHERE {c} NOT IN ({', '.join(repr(v) for v in vs)}))") for c, vs in domains.items()
    ]
    parts.append(("unique_" + "_".join(key), f"COUNT(*) - COUNT(DISTINCT ({', '.join(key)}))"))
    return Check(
        " UNION ALL ".join(f"SELECT '{table}' AS name, '{n}' AS rule, {e} AS violations FROM {source}" for n, e in parts),
        "violations", "", "name rule",
    )


_COHORTS = ("new_user", "established", "mature")


@query("dq_bronze", _dq_sql("bronze.customers", "a_customers",
                            ["customer_id", "signup_date", "monthly_charges", "contract_type", "churn_label"], ["monthly_charges"],
                            {"contract_type": ("Month-to-month", "One year", "Two year")}, ["customer_id"]))
def dq_bronze(spark, d):
    return quality.bronze(account_tables(spark, d).customers)


@query("dq_silver", _dq_sql("silver.customers", "a_silver_customers", ["customer_id", "cohort", "ltv_tier", "tenure_days", "estimated_ltv"],
                            ["tenure_days", "estimated_ltv"], {"cohort": _COHORTS, "ltv_tier": ("smb", "mid_market", "enterprise")}, ["customer_id"]))
def dq_silver(spark, d):
    return quality.silver(account_tables(spark, d).silver_customers)


@query("dq_gold", _dq_sql("gold.customer_360", "b_gold", ["customer_id", "prediction_date", "logins_30d", "churned_in_window"],
                          ["logins_30d"], {"cohort": _COHORTS}, ["customer_id", "prediction_date"]))
def dq_gold(spark, d):
    return quality.gold(activity_gold(spark, d))


@query(
    "dq_tickets",
    Check("SELECT 'returned_lines' AS name, 'unique_l_orderkey_l_linenumber' AS rule, COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS violations "
          "FROM lineitem WHERE l_returnflag = 'R' UNION ALL "
          "SELECT 'returned_lines', 'l_quantity_not_negative', COUNT(*) FILTER (WHERE l_quantity < 0) FROM lineitem WHERE l_returnflag = 'R'",
          "violations", "", "name rule"),
)
def dq_tickets(spark, d):
    from tenuria.sources import accounts

    rows = accounts.returned_lines(spark, d)
    return quality.check(rows, "returned_lines", quality.not_negative("l_quantity"), ["l_orderkey", "l_linenumber"])
