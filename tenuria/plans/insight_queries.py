"""Registered queries: exploration, monitoring, playbooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import declared, metrics, monitoring, playbooks, profiling
from tenuria.plans.inputs import A_SNAPSHOTS, account_gold, account_tables, activity_gold, activity_tables, scored
from tenuria.plans.model_queries import metric_ctes
from tenuria.plans.registry import Check, query
from tenuria.session import stored
from tenuria.sources import activity

P_B = "DATE '2024-01-29'"


def _customers(spark, d):
    return account_tables(spark, d).silver_customers


# -- exploration --------------------------------------------------------------------

_PROFILED = ("churn_date", "internet_type", "contract_type", "monthly_charges", "tenure_days")


@query(
    "profile_missing",
    Check(
        "SELECT n AS n_rows, 5 AS n_columns, 100.0::DOUBLE * total / (n * 5) AS overall_missing_pct, column_name, n_missing, 100.0::DOUBLE * n_missing / n AS missing_pct FROM ("
        "SELECT COUNT(*) AS n, COUNT(*) * 5 - COUNT(churn_date) - COUNT(internet_type) - COUNT(contract_type) - COUNT(monthly_charges) - COUNT(tenure_days) AS total, "
        "UNNEST(['churn_date', 'internet_type']) AS column_name, UNNEST([COUNT(*) - COUNT(churn_date), COUNT(*) - COUNT(internet_type)]) AS n_missing FROM a_silver_customers)",
        "n_rows n_columns n_missing", "overall_missing_pct missing_pct", "column_name"),
)
def profile_missing(spark, d):
    return profiling.missing(_customers(spark, d).select(*_PROFILED))


@query(
    "profile_duplicates",
    Check("SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(DISTINCT (l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)) AS n_duplicates FROM lineitem",
          "n_rows n_duplicates"),
)
def profile_duplicates(spark, d):
    from tenuria.sources import star

    return profiling.duplicates(
        star.read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    )


def _box_sql(rows, by, columns):
    keys = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS metric, COUNT(x) AS n, AVG(x) AS mean, STDDEV_SAMP(x) AS std, MIN(x) AS min, QUANTILE_CONT(x, 0.25) AS q1, "
        f"MEDIAN(x) AS median, QUANTILE_CONT(x, 0.75) AS q3, MAX(x) AS max FROM (SELECT *, CAST({c} AS DOUBLE) AS x FROM {rows}) GROUP BY {keys}metric"
        for c in columns
    )


_BOX = "n", "mean std min q1 median q3 max"


@query("profile_distributions", Check(_box_sql("a_silver_customers", "", ["monthly_charges", "tenure_days", "estimated_ltv"]), *_BOX, "metric"))
def profile_distributions(spark, d):
    return profiling.distributions(_customers(spark, d), ["monthly_charges", "tenure_days", "estimated_ltv"])


@query(
    "profile_histogram",
    Check("SELECT CASE WHEN x < 0 THEN 0 WHEN x >= 10000 THEN 21 ELSE FLOOR(x / 500) + 1 END AS bin, COUNT(*) AS n "
          "FROM (SELECT CAST(monthly_charges AS DOUBLE) AS x FROM a_silver_customers) GROUP BY 1", "bin n"),
)
def profile_histogram(spark, d):
    return profiling.histogram(_customers(spark, d), "monthly_charges", 0, 10000, 20)


_RATE = "AVG(churn_label::INT) AS churn_rate"


@query(
    "segment_summary",
    Check(f"SELECT cohort, ltv_tier, COUNT(*) AS n_customers, {_RATE}, AVG(CAST(estimated_ltv AS DOUBLE)) AS avg_ltv FROM a_silver_customers GROUP BY 1, 2",
          "n_customers", "churn_rate avg_ltv", "cohort ltv_tier"),
)
def segment_summary(spark, d):
    return profiling.segment_summary(_customers(spark, d))


@query(
    "segment_pivot",
    Check("SELECT cohort, COUNT(*) FILTER (WHERE ltv_tier = 'smb') AS smb, COUNT(*) FILTER (WHERE ltv_tier = 'mid_market') AS mid_market, "
          "COUNT(*) FILTER (WHERE ltv_tier = 'enterprise') AS enterprise FROM a_silver_customers GROUP BY cohort",
          "smb mid_market enterprise", "", "cohort"),
)
def segment_pivot(spark, d):
    return profiling.segment_pivot(_customers(spark, d), "cohort", "ltv_tier", ["smb", "mid_market", "enterprise"])


_DIMS = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {value} AS value, COUNT(*) AS n_customers, {_RATE} FROM a_silver_customers GROUP BY 1, 2"
    for dim, value in (("cohort", "cohort"), ("contract_type", "contract_type"), ("ltv_tier", "ltv_tier"), ("overall", "'all'"))
)


@query("churn_by_dim", Check(_DIMS, "n_customers", "churn_rate", "dimension value"))
def churn_by_dim(spark, d):
    return profiling.churn_by_dimension(_customers(spark, d)).select("dimension", "value", "n_customers", "churn_rate")


@query(
    "churn_3d",
    Check(f"SELECT cohort, ltv_tier, contract_type, COUNT(*) AS total, COUNT(*) FILTER (WHERE churn_label) AS churned, {_RATE} FROM a_silver_customers GROUP BY ALL",
          "total churned", "churn_rate", "cohort ltv_tier contract_type"),
)
def churn_3d(spark, d):
    return profiling.churn_3d(_customers(spark, d))


@query(
    "churn_deviation",
    Check("SELECT cohort || ' / ' || ltv_tier AS segment, COUNT(*) AS n_customers, AVG(churn_label::INT) AS churn_rate, "
          "AVG(churn_label::INT) - (SELECT AVG(churn_label::INT) FROM a_silver_customers) AS deviation FROM a_silver_customers GROUP BY cohort, ltv_tier",
          "n_customers", "churn_rate deviation", "segment"),
)
def churn_deviation(spark, d):
    return profiling.churn_deviation(_customers(spark, d))


_HEAT = (
    ("months", "SELECT strftime(signup_date, '%Y-%m') AS signup_month, churn_label, "
               "CASE WHEN ABS(x - FLOOR(x) - 0.5) < 1e-9 THEN 2 * ROUND(x / 2) ELSE ROUND(x) END AS lived "
               "FROM (SELECT *, (churn_date - signup_date) / CAST(30 AS DOUBLE) AS x FROM a_silver_customers)"),
    ("heat", "SELECT g.signup_month, m AS months_since_signup, cohort_size, COALESCE(c, 0) AS churned_count, COALESCE(c, 0) / CAST(cohort_size AS DOUBLE) AS churn_rate "
             "FROM (SELECT signup_month, COUNT(*) AS cohort_size FROM months GROUP BY 1) g CROSS JOIN range(0, 13) r(m) "
             "LEFT JOIN (SELECT signup_month, lived, COUNT(*) AS c FROM months WHERE churn_label GROUP BY 1, 2) k ON k.signup_month = g.signup_month AND k.lived = m"),
)


def _heat(spark, d):
    return profiling.cohort_heatmap(_customers(spark, d))


@query("cohort_heatmap", Check("SELECT * FROM heat", "months_since_signup cohort_size churned_count", "churn_rate", "signup_month", _HEAT))
def cohort_heatmap(spark, d):
    return _heat(spark, d)


@query(
    "cohort_heatmap_matrix",
    Check("SELECT signup_month, " + ", ".join(f"MAX(churn_rate) FILTER (WHERE months_since_signup = {m}) AS month_{m}" for m in range(13))
          + " FROM heat GROUP BY signup_month", "", " ".join(f"month_{m}" for m in range(13)), "signup_month", _HEAT),
)
def cohort_heatmap_matrix(spark, d):
    return profiling.heatmap_matrix(_heat(spark, d))


@query("cohort_trend", Check("SELECT months_since_signup, AVG(churn_rate) AS avg_churn_rate, SUM(churned_count) AS total_churned FROM heat GROUP BY 1",
                             "months_since_signup total_churned", "avg_churn_rate", "", _HEAT))
def cohort_trend(spark, d):
    return profiling.cohort_trend(_heat(spark, d))


_BY_STATUS = (("by_status", """
    SELECT e.customer_id, CASE WHEN churn_label THEN 'Churned' ELSE 'Retained' END AS churn_status, AVG(login_count) AS avg_logins,
        AVG(features_used) AS avg_features, AVG(session_duration_minutes) AS avg_session, COUNT(*) AS active_days
    FROM a_engagement e JOIN a_silver_customers c ON c.customer_id = e.customer_id GROUP BY 1, 2"""),)


def _by_status(spark, d):
    t = account_tables(spark, d)
    return profiling.engagement_by_status(t.engagement, t.silver_customers)


@query("engagement_by_status", Check("SELECT * FROM by_status", "customer_id active_days", "avg_logins avg_features avg_session", "churn_status", _BY_STATUS))
def engagement_by_status(spark, d):
    return _by_status(spark, d)


@query("engagement_box", Check(_box_sql("by_status", "churn_status", ["avg_logins", "avg_features", "avg_session"]), *_BOX, "churn_status metric", _BY_STATUS))
def engagement_box(spark, d):
    return profiling.engagement_box(stored(_by_status(spark, d)))


_CORR = ["tenure_days", "monthly_charges", "estimated_ltv", "churn_label"]


@query(
    "corr_matrix",
    Check(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CORR(CAST({a}{'::INT' if a == 'churn_label' else ''} AS DOUBLE), CAST({b}{'::INT' if b == 'churn_label' else ''} AS DOUBLE)) AS corr FROM a_silver_customers"
        for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), "", "corr", "a b"),
)
def corr_matrix(spark, d):
    return profiling.corr_matrix(_customers(spark, d).withColumn("churn_label", F.col("churn_label").cast("int")), _CORR)


_LABELLED = ["logins_30d", "logins_180d", "features_used_180d", "avg_session_duration", "days_since_last_login", "tenure_days",
             "days_to_first_login", "contract_value_remaining"]


@query(
    "corr_with_label",
    Check("SELECT *, ABS(corr) AS abs_corr FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN MIN({c}) < MAX({c}) AND MIN(churned_in_window::INT) FILTER (WHERE {c} IS NOT NULL) < MAX(churned_in_window::INT) FILTER (WHERE {c} IS NOT NULL) "
        f"THEN CORR(CAST({c} AS DOUBLE), churned_in_window::INT) END AS corr FROM a_gold" for c in _LABELLED) + ")", "", "corr abs_corr", "feature"),
)
def corr_with_label(spark, d):
    rows = account_gold(spark, d).withColumn("y", F.col("churned_in_window").cast("int"))
    return profiling.corr_with_label(rows, _LABELLED, "y")


@query(
    "kpi_summary",
    Check(
        f"""SELECT COUNT(*) AS total_customers, {_RATE}, AVG(CAST(monthly_charges AS DOUBLE)) AS avg_monthly_charges, AVG(CAST(estimated_ltv AS DOUBLE)) AS avg_ltv,
            strftime(MIN(signup_date), '%Y-%m') AS first_month, strftime(MAX(signup_date), '%Y-%m') AS last_month,
            (SELECT cohort FROM a_silver_customers GROUP BY 1 ORDER BY AVG(churn_label::INT) DESC, 1 LIMIT 1) AS worst_cohort,
            (SELECT contract_type FROM a_silver_customers GROUP BY 1 ORDER BY AVG(churn_label::INT) DESC, 1 LIMIT 1) AS worst_contract FROM a_silver_customers""",
        "total_customers", "churn_rate avg_monthly_charges avg_ltv", "first_month last_month worst_cohort worst_contract"),
)
def kpi_summary(spark, d):
    return profiling.kpi_summary(_customers(spark, d))


# -- monitoring ---------------------------------------------------------------------


@query(
    "mon_quality_daily",
    Check(
        """SELECT *, CASE WHEN feature_freshness_hours > 24 THEN 'CRITICAL' WHEN feature_freshness_hours > 18 THEN 'WARNING' ELSE 'OK' END AS freshness_status,
            CASE WHEN missing_rate_pct > 5 THEN 'CRITICAL' WHEN missing_rate_pct > 2 THEN 'WARNING' ELSE 'OK' END AS missing_status
        FROM (SELECT CAST(created_at AS DATE) AS day, (EPOCH_US(CAST(CAST(created_at AS DATE) + 1 AS TIMESTAMP)) - MAX(EPOCH_US(created_at))) / 3600000000.0::DOUBLE AS feature_freshness_hours,
                100.0::DOUBLE * (3 * COUNT(*) - COUNT(sentiment_score) - COUNT(escalated) - COUNT(resolved_at)) / (3 * COUNT(*)) AS missing_rate_pct
              FROM b_tickets GROUP BY 1)""",
        "", "feature_freshness_hours missing_rate_pct", "day freshness_status missing_status"),
)
def mon_quality_daily(spark, d):
    daily = monitoring.quality_daily(activity_tables(spark, d).tickets, "created_at", ["sentiment_score", "escalated", "resolved_at"])
    return daily.withColumns(
        {
            "freshness_status": monitoring.status("feature_freshness_hours", "feature_freshness_hours"),
            "missing_status": monitoring.status("missing_rate_pct", "missing_rate_pct"),
        }
    )


BASE_UNTIL = "1997-06-30"
_BASE = "prediction_date <= DATE '1997-06-30'"


def _all(spark, d):
    return scored(spark, d, A_SNAPSHOTS)


def _baseline():
    return F.col("prediction_date") <= C.day(BASE_UNTIL)


_PSI = (
    ("psi_long", "SELECT prediction_date, 'score' AS metric, score AS value FROM a_scored_all UNION ALL "
                 "SELECT prediction_date, 'estimated_ltv', CAST(estimated_ltv AS DOUBLE) FROM a_scored_all"),
    ("psi_pos", f"SELECT metric, value, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY metric) AS n FROM psi_long WHERE {_BASE}"),
    ("psi_edges", """
        SELECT metric, q, ANY_VALUE(value) FILTER (WHERE i = FLOOR(h)) + (ANY_VALUE(value) FILTER (WHERE i = CEIL(h)) - ANY_VALUE(value) FILTER (WHERE i = FLOOR(h))) * (ANY_VALUE(h) - FLOOR(ANY_VALUE(h))) AS edge
        FROM (SELECT *, (n - 1) * (q / 10.0::DOUBLE) AS h FROM psi_pos, range(1, 10) r(q)) GROUP BY metric, q"""),
    ("psi_bins", f"SELECT l.metric, prediction_date, {_BASE} AS base, (SELECT COUNT(*) FROM psi_edges e WHERE e.metric = l.metric AND l.value > e.edge) AS bin FROM psi_long l"),
    ("psi_grid", "SELECT metric, prediction_date, bin FROM (SELECT DISTINCT metric, prediction_date FROM psi_bins) CROSS JOIN range(0, 10) r(bin)"),
    ("psi_out", """
        SELECT g.metric, g.prediction_date, SUM((a - e) * LN(a / e)) AS psi FROM psi_grid g
        JOIN (SELECT g.metric, g.prediction_date, g.bin, GREATEST(COALESCE(c, 0) / CAST(t AS DOUBLE), 1e-6::DOUBLE) AS a FROM psi_grid g
              JOIN (SELECT metric, prediction_date, COUNT(*) AS t FROM psi_bins GROUP BY 1, 2) x ON x.metric = g.metric AND x.prediction_date = g.prediction_date
              LEFT JOIN (SELECT metric, prediction_date, bin, COUNT(*) AS c FROM psi_bins GROUP BY 1, 2, 3) y ON y.metric = g.metric AND y.prediction_date = g.prediction_date AND y.bin = g.bin) cur
          ON cur.metric = g.metric AND cur.prediction_date = g.prediction_date AND cur.bin = g.bin
        JOIN (SELECT m.metric, b.bin, GREATEST(COUNT(*) FILTER (WHERE m.bin = b.bin) / CAST(COUNT(*) AS DOUBLE), 1e-6::DOUBLE) AS e
              FROM psi_bins m CROSS JOIN range(0, 10) b(bin) WHERE m.base GROUP BY 1, 2) ref ON ref.metric = g.metric AND ref.bin = g.bin
        GROUP BY 1, 2"""),
)


def _psi(rows, columns=("score", "estimated_ltv")):
    return monitoring.psi(profiling.long_form(rows, columns, ["prediction_date"]), _baseline())


@query("mon_psi", Check("SELECT * FROM psi_out", "", "psi", "metric prediction_date", _PSI))
def mon_psi(spark, d):
    return _psi(stored(_all(spark, d)))


@query(
    "mon_ks",
    Check(
        f"""SELECT cohort, MAX(ABS(f0 - f1)) AS ks, MAX(ABS(f0 - f1)) > 0.1 AS drifted FROM (
            SELECT cohort, score, COALESCE(SUM(base) OVER w / NULLIF(CAST(SUM(base) OVER p AS DOUBLE), 0), 0) AS f0,
                COALESCE(SUM(1 - base) OVER w / NULLIF(CAST(SUM(1 - base) OVER p AS DOUBLE), 0), 0) AS f1
            FROM (SELECT cohort, score, ({_BASE})::INT AS base FROM a_scored_all)
            WINDOW w AS (PARTITION BY cohort ORDER BY score), p AS (PARTITION BY cohort)) GROUP BY cohort""",
        "", "ks", "cohort drifted"),
)
def mon_ks(spark, d):
    return monitoring.ks(_all(spark, d), _baseline(), by=["cohort"])


@query(
    "mon_prediction_drift",
    Check("SELECT *, prediction_mean - (SELECT prediction_mean FROM per_day WHERE prediction_date = DATE '1997-01-01') AS drift FROM per_day",
          "n", "prediction_mean drift", "prediction_date",
          (("per_day", "SELECT prediction_date, CAST(SUM(CAST(score AS DECIMAL(18,9))) AS DOUBLE) / COUNT(*) AS prediction_mean, COUNT(*) AS n "
                       "FROM a_scored_all GROUP BY prediction_date"),)),
)
def mon_prediction_drift(spark, d):
    return monitoring.prediction_drift(_all(spark, d))


_DAILY_METRICS = metric_ctes("a_scored_all", "prediction_date", "md")
_DAILY_COLUMNS = "n_samples", "churn_rate auc_pr precision_at_10pct"


@query("mon_model_daily", Check("SELECT *, auc_pr < 0.5 AS below_floor FROM md_out", *_DAILY_COLUMNS, "prediction_date below_floor", _DAILY_METRICS))
def mon_model_daily(spark, d):
    return monitoring.model_daily(_all(spark, d))


@query(
    "mon_cohort_daily",
    Check("SELECT *, auc_pr < 0.4 AS below_floor FROM mc_out", *_DAILY_COLUMNS, "prediction_date cohort below_floor",
          metric_ctes("a_scored_all", "cohort, prediction_date", "mc")),
)
def mon_cohort_daily(spark, d):
    return monitoring.model_daily(_all(spark, d), ["cohort", "prediction_date"], 0.4)


_BUSINESS = (("business", """
    SELECT *, LEAST(COALESCE(a / NULLIF(CAST(f AS DOUBLE), 0), 0), 1) AS intervention_rate, LEAST(COALESCE(s / NULLIF(CAST(a AS DOUBLE), 0), 0), 1) AS save_rate,
        f AS high_risk_flagged, a AS interventions_attempted, s AS interventions_successful
    FROM (SELECT prediction_date, COUNT(*) FILTER (WHERE score >= 0.5) AS f, COUNT(*) FILTER (WHERE score >= 0.5 AND customer_id % 5 > 0) AS a,
            COUNT(*) FILTER (WHERE score >= 0.5 AND customer_id % 5 > 0 AND customer_id % 3 = 0) AS s,
            COALESCE(SUM(estimated_ltv) FILTER (WHERE score >= 0.5), 0) AS revenue_at_risk,
            COALESCE(SUM(estimated_ltv) FILTER (WHERE score >= 0.5 AND customer_id % 5 > 0 AND customer_id % 3 = 0), 0) AS revenue_saved
          FROM a_scored_all GROUP BY prediction_date)"""),)


def _business(rows):
    flagged = F.col("score") >= 0.5
    attempted = flagged & (F.col("customer_id") % 5 > 0)
    return monitoring.business_daily(
        rows.withColumns(
            {"flagged": flagged, "attempted": attempted, "successful": attempted & (F.col("customer_id") % 3 == 0)}
        )
    )


@query(
    "mon_business_daily",
    Check("SELECT * FROM business", "high_risk_flagged interventions_attempted interventions_successful",
          "revenue_at_risk revenue_saved intervention_rate save_rate", "prediction_date", _BUSINESS),
)
def mon_business_daily(spark, d):
    return _business(_all(spark, d))


# The daily monitoring frame: drift of the score, missing rate, model and business metrics per snapshot.
_FRAME = (*_PSI, *_DAILY_METRICS, *_BUSINESS, ("frame", """
    SELECT m.prediction_date, psi, auc_pr, brier, save_rate, intervention_rate, missing_rate_pct,
        ROW_NUMBER() OVER (ORDER BY m.prediction_date) AS first_n, ROW_NUMBER() OVER (ORDER BY m.prediction_date DESC) AS last_n
    FROM md_out m JOIN psi_out p ON p.prediction_date = m.prediction_date AND metric = 'score'
    JOIN business b ON b.prediction_date = m.prediction_date
    JOIN (SELECT prediction_date, 50.0::DOUBLE * (2 * COUNT(*) - COUNT(churn_date) - COUNT(contract_type)) / COUNT(*) AS missing_rate_pct FROM a_scored_all GROUP BY 1) q
      ON q.prediction_date = m.prediction_date"""))


def _frame(spark, d):
    rows = stored(_all(spark, d))
    null = lambda c: F.count_if(F.col(c).isNull())
    missing = rows.groupBy("prediction_date").agg(
        ((null("churn_date") + null("contract_type")) * 50.0 / F.count("*")).alias("missing_rate_pct")
    )
    parts = [
        _psi(rows, ("score",)).drop("metric"),
        metrics.evaluate(rows, ["prediction_date"]).select("prediction_date", "auc_pr", "brier"),
        _business(rows).select("prediction_date", "save_rate", "intervention_rate"),
        missing,
    ]
    return reduce(lambda a, b: a.join(b, "prediction_date"), parts)


@query(
    "mon_alerts",
    Check(
        """SELECT severity, alert FROM (SELECT MAX(psi) FILTER (WHERE last_n <= 7) AS p, MAX(missing_rate_pct) FILTER (WHERE last_n <= 7) AS m, MAX(auc_pr) FILTER (WHERE last_n = 1) AS a FROM frame),
            (VALUES (1, 'CRITICAL', 'Feature drift detected (PSI > 0.2)'), (2, 'WARNING', 'Missing rate spike detected (>3%)'),
                (3, 'CRITICAL', 'Model performance below threshold (AUC-PR < 0.45)'), (4, 'WARNING', 'Model performance degrading (AUC-PR < 0.5)')) v(k, severity, alert)
        WHERE (k = 1 AND p > 0.2) OR (k = 2 AND m > 3) OR (k = 3 AND a < 0.45) OR (k = 4 AND a >= 0.45 AND a < 0.5)""",
        "", "", "severity alert", _FRAME),
)
def mon_alerts(spark, d):
    return monitoring.alerts(_frame(spark, d))


@query(
    "mon_retrain",
    Check(
        """SELECT *, CASE WHEN BOOL_OR(decision = 'TRIGGERED') OVER () THEN 'RETRAIN' WHEN BOOL_OR(decision = 'WARNING') OVER () THEN 'MONITOR' ELSE 'NONE' END AS recommendation FROM (
            SELECT 'performance_drop' AS check_name, d AS value, CASE WHEN d > 0.1 THEN 'TRIGGERED' WHEN d > 0.07 THEN 'WARNING' ELSE 'OK' END AS decision FROM facts
            UNION ALL SELECT 'drift_psi', p, CASE WHEN p > 0.2 THEN 'TRIGGERED' WHEN p > 0.1 THEN 'WARNING' ELSE 'OK' END FROM facts
            UNION ALL SELECT 'business_roi', s, CASE WHEN s < 0.3 THEN 'TRIGGERED' WHEN s < 0.36 THEN 'WARNING' ELSE 'OK' END FROM facts
            UNION ALL SELECT 'calibration', c, CASE WHEN c > 0.2 THEN 'TRIGGERED' WHEN c > 0.14 THEN 'WARNING' ELSE 'OK' END FROM facts)""",
        "", "value", "check_name decision recommendation",
        (*_FRAME, ("facts", """
            SELECT (AVG(auc_pr) FILTER (WHERE first_n <= 7) - AVG(auc_pr) FILTER (WHERE last_n <= 7)) / AVG(auc_pr) FILTER (WHERE first_n <= 7) AS d,
                MAX(psi) FILTER (WHERE last_n <= 7) AS p, AVG(save_rate) FILTER (WHERE last_n <= 7) AS s,
                (AVG(brier) FILTER (WHERE last_n <= 7) - AVG(brier) FILTER (WHERE first_n <= 7)) / AVG(brier) FILTER (WHERE first_n <= 7) AS c FROM frame"""))),
)
def mon_retrain(spark, d):
    return monitoring.retrain(_frame(spark, d))


@query(
    "mon_threshold_counts",
    Check(
        "SELECT UNNEST(['psi', 'auc_pr', 'save_rate']) AS metric, UNNEST([0.02, 0.5, 0.34]) AS threshold, UNNEST([x, y, z]) AS days_triggered, "
        "UNNEST([100.0::DOUBLE * x / n, 100.0::DOUBLE * y / n, 100.0::DOUBLE * z / n]) AS pct_of_period FROM ("
        "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE psi > 0.02) AS x, COUNT(*) FILTER (WHERE auc_pr < 0.5) AS y, COUNT(*) FILTER (WHERE save_rate < 0.34) AS z FROM frame)",
        "days_triggered", "threshold pct_of_period", "metric", _FRAME),
)
def mon_threshold_counts(spark, d):
    return monitoring.threshold_counts(
        _frame(spark, d), {"psi": ("above", 0.02), "auc_pr": ("below", 0.5), "save_rate": ("below", 0.34)}
    )


@query(
    "mon_threshold_table",
    Check(
        """SELECT metric, value, warning, critical, CASE WHEN (up AND value > critical) OR (NOT up AND value < critical) THEN 'CRITICAL'
                WHEN (up AND value > warning) OR (NOT up AND value < warning) THEN 'WARNING' ELSE 'OK' END AS status
        FROM (SELECT UNNEST(['missing_rate_pct', 'psi', 'auc_pr', 'intervention_rate', 'save_rate']) AS metric, UNNEST([missing_rate_pct, psi, auc_pr, intervention_rate, save_rate]) AS value FROM frame WHERE last_n = 1)
        JOIN (VALUES ('missing_rate_pct', 2.0, 5.0, TRUE), ('psi', 0.1, 0.2, TRUE), ('auc_pr', 0.5, 0.45, FALSE), ('intervention_rate', 0.7, 0.6, FALSE), ('save_rate', 0.35, 0.25, FALSE)) v(m, warning, critical, up) ON m = metric""",
        "", "value warning critical", "metric status", _FRAME),
)
def mon_threshold_table(spark, d):
    return monitoring.threshold_table(_frame(spark, d))


# -- playbooks ----------------------------------------------------------------------


def _failures(spark, d) -> DataFrame:
    k = F.get_json_object("event_properties", "$.k").cast("int")
    paid = F.col("event_type") == "purchase"
    return declared.billing(
        activity.bronze_events(spark, d), "2024-01-29", paid & (k % 10 == 0), paid & (k % 10 == 1), F.lit(False), F.lit(False)
    ).select("customer_id", "payment_failures_90d")


@query(
    "churn_taxonomy",
    Check(
        f"""SELECT g.customer_id, CASE WHEN COALESCE(f, 0) > 2 THEN 'involuntary' WHEN logins_30d < 30 AND days_to_renewal <= 90 THEN 'silent'
                WHEN logins_30d < 30 THEN 'engagement_decay' ELSE 'contractual_voluntary' END AS churn_type
        FROM b_gold g LEFT JOIN (SELECT user_id, COUNT(*) AS f FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) < {P_B}
            AND {P_B} - CAST(ts AS DATE) <= 90 AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 GROUP BY 1) p ON p.user_id = g.customer_id""",
        "customer_id", "", "churn_type"),
)
def churn_taxonomy(spark, d):
    gold = activity_gold(spark, d).join(_failures(spark, d), "customer_id", "left")
    failures = F.coalesce("payment_failures_90d", F.lit(0)) - 2  # up to two failures are retried
    return playbooks.churn_taxonomy(gold, failures, low_logins=30).select("customer_id", "churn_type")


@query(
    "lifecycle_stage",
    Check("SELECT customer_id, CASE WHEN tenure_days < 15 THEN 'activate' WHEN tenure_days < 90 THEN 'engage' WHEN tenure_days < 180 THEN 'retain' ELSE 'expand' END AS stage FROM a_silver_customers",
          "customer_id", "", "stage"),
)
def lifecycle_stage(spark, d):
    return _customers(spark, d).select("customer_id", playbooks.lifecycle_stage("tenure_days").alias("stage"))


@query(
    "churn_cost",
    Check("SELECT customer_id, 0.2::DOUBLE * CAST(estimated_ltv AS DOUBLE) AS expansion_loss, 0.1::DOUBLE * CAST(estimated_ltv AS DOUBLE) AS replacement_cost, "
          "contract_value_remaining + 0.3::DOUBLE * CAST(estimated_ltv AS DOUBLE) AS churn_cost FROM b_gold", "customer_id", "expansion_loss replacement_cost churn_cost"),
)
def churn_cost(spark, d):
    return playbooks.churn_cost(activity_gold(spark, d)).select("customer_id", "expansion_loss", "replacement_cost", "churn_cost")


def _save_score():
    return ((F.col("customer_id") * 104729) % 1000).cast("double") / 1000.0


@query(
    "uplift_quadrant",
    Check(
        """SELECT customer_id, CASE WHEN score >= 0.5 AND s >= 0.5 THEN 'persuadable' WHEN s >= 0.5 THEN 'sure_thing' WHEN score >= 0.5 THEN 'lost_cause' ELSE 'sleeping_dog' END AS quadrant,
            score * s * CAST(estimated_ltv AS DOUBLE) AS priority, RANK() OVER (ORDER BY score * s * CAST(estimated_ltv AS DOUBLE) DESC) AS rank
        FROM (SELECT *, CAST((customer_id * 104729) % 1000 AS DOUBLE) / 1000.0 AS s FROM a_scored)""",
        "customer_id rank", "priority", "quadrant"),
)
def uplift_quadrant(spark, d):
    rows = scored(spark, d).withColumn("save_score", _save_score())
    return playbooks.uplift_quadrant(rows).select("customer_id", "quadrant", "priority", "rank")


@query(
    "top_n_capacity",
    Check("SELECT customer_id, score * CAST(estimated_ltv AS DOUBLE) AS expected_loss FROM a_scored ORDER BY 2 DESC, customer_id LIMIT 50", "customer_id", "expected_loss"),
)
def top_n_capacity(spark, d):
    return playbooks.top_n_capacity(scored(spark, d), 50).select("customer_id", "expected_loss")


@query(
    "activation_sla",
    Check(
        """SELECT customer_id, ltv_tier, 3 AS sla_day, 'Check-in' AS action FROM b_gold WHERE cohort = 'new_user' AND tenure_days >= 3 AND COALESCE(days_to_first_login, 99) > 3
        UNION ALL SELECT customer_id, ltv_tier, 7, 'Onboarding assist' FROM b_gold WHERE cohort = 'new_user' AND tenure_days >= 7 AND COALESCE(onboarding_completion_pct, 0) < 0.5
        UNION ALL SELECT customer_id, ltv_tier, 14, CASE ltv_tier WHEN 'enterprise' THEN 'CSM outreach' ELSE 'Guided tour' END FROM b_gold
            WHERE cohort = 'new_user' AND tenure_days >= 14 AND COALESCE(onboarding_completion_pct, 0) < 0.5""",
        "customer_id sla_day", "", "ltv_tier action"),
)
def activation_sla(spark, d):
    return playbooks.activation_sla(activity_gold(spark, d))


def velocity_check(days: str) -> Check:
    """Dense customer-week grid over the daily rows of the CTE `days`."""
    return Check(
        f"""
        SELECT w.customer_id, week_start, logins, p1 AS logins_prev, p2 AS logins_prev2, ltv_tier, CASE ltv_tier WHEN 'enterprise' THEN 'CSM call' ELSE 'Re-engagement campaign' END AS action
        FROM (SELECT *, LAG(logins, 1, 0) OVER o AS p1, LAG(logins, 2, 0) OVER o AS p2 FROM (
                SELECT u.customer_id, DATE '2024-01-01' + CAST(7 * k AS INTEGER) AS week_start,
                    COALESCE((SELECT SUM(login_count) FROM {days} e WHERE e.customer_id = u.customer_id AND e.activity_date - DATE '2024-01-01' BETWEEN 7 * k AND 7 * k + 6), 0) AS logins
                FROM b_life u CROSS JOIN range(0, 4) r(k)) WINDOW o AS (PARTITION BY customer_id ORDER BY week_start)) w
        JOIN b_silver_customers c ON c.customer_id = w.customer_id
        WHERE logins < p1 * 0.8::DOUBLE AND p1 < p2 * 0.8::DOUBLE""",
        "customer_id logins logins_prev logins_prev2", "", "week_start ltv_tier action",
    )


@query("velocity_alert", velocity_check("b_engagement"))
def velocity_alert(spark, d):
    t = activity_tables(spark, d)
    return playbooks.velocity_alert(t.engagement, t.silver_customers, "2024-01-01", "2024-01-29")


@query(
    "renewal_review",
    Check(
        """SELECT customer_id, days_to_renewal, level AS risk_level, CASE level WHEN 'critical' THEN 'Executive renewal meeting' WHEN 'high' THEN 'Executive renewal meeting'
                WHEN 'medium' THEN 'Value review call' ELSE 'Standard renewal notice' END AS action
        FROM (SELECT *, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level
              FROM (SELECT *, CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score FROM b_gold)) WHERE days_to_renewal <= 90""",
        "customer_id days_to_renewal", "", "risk_level action"),
)
def renewal_review(spark, d):
    gold = activity_gold(spark, d).withColumn("score", ((F.col("customer_id") * 7919) % 1000).cast("double") / 1000.0)
    return playbooks.renewal_review(gold).select("customer_id", "days_to_renewal", "risk_level", "action")


_ARMS = (("arms", """
    SELECT *, CASE WHEN rn <= FLOOR(n / 2) THEN 'treatment' ELSE 'control' END AS arm FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort, ltv_tier ORDER BY MD5(CAST(customer_id AS VARCHAR))) AS rn, COUNT(*) OVER (PARTITION BY cohort, ltv_tier) AS n FROM a_scored)"""),)


@query("ab_assign", Check("SELECT customer_id, cohort, ltv_tier, arm FROM arms", "customer_id", "", "cohort ltv_tier arm", _ARMS))
def ab_assign(spark, d):
    return playbooks.ab_assign(scored(spark, d), ["cohort", "ltv_tier"]).select("customer_id", "cohort", "ltv_tier", "arm")


@query(
    "ab_readout",
    Check(
        """SELECT nt AS n_treatment, nc AS n_control, rt AS rate_treatment, rc AS rate_control, rt - rc AS difference,
            COALESCE((rt - rc) / NULLIF(SQRT(p * (1 - p) * (1.0::DOUBLE / nt + 1.0::DOUBLE / nc)), 0), 0) AS z
        FROM (SELECT COUNT(*) FILTER (WHERE arm = 'treatment') AS nt, COUNT(*) FILTER (WHERE arm = 'control') AS nc, AVG(label) FILTER (WHERE arm = 'treatment') AS rt,
            AVG(label) FILTER (WHERE arm = 'control') AS rc, AVG(label) AS p FROM arms)""",
        "n_treatment n_control", "rate_treatment rate_control difference z", "", _ARMS),
)
def ab_readout(spark, d):
    return playbooks.ab_readout(playbooks.ab_assign(scored(spark, d), ["cohort", "ltv_tier"]))
