"""Common table expressions of the check SQL (DuckDB dialect), in dependency order.

Prefix a_: accounts from customer / orders / lineitem. Prefix b_: users from events.
They state the input mapping a second time, row by row, independently of the Spark plans.
"""

from __future__ import annotations


def _attributes(key: str) -> str:
    flag = f"CASE WHEN {key} % 5 = 0 THEN NULL ELSE {key} % 2 = 0 END"
    addon = lambda i: f"CASE WHEN (c_nationkey >> {i}) % 2 = 1 THEN 'Yes' ELSE 'No' END"
    return f"""
    CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'Month-to-month'
         WHEN c_mktsegment IN ('AUTOMOBILE','FURNITURE') THEN 'One year'
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Two year' END AS contract_type,
    CAST(ABS(c_acctbal) AS DECIMAL(10,2)) AS monthly_charges,
    CASE WHEN {key} % 2 = 0 THEN 'Credit card' ELSE 'Bank transfer' END AS payment_method,
    CASE WHEN {key} % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    {flag} AS senior_citizen, {flag} AS partner, {flag} AS dependents, {flag} AS phone_service,
    CASE WHEN {key} % 3 = 0 THEN 'Yes' ELSE 'No' END AS multiple_lines,
    CASE {key} % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' WHEN 2 THEN 'Fiber optic' END AS internet_service,
    {addon(0)} AS online_security, {addon(1)} AS online_backup, {addon(2)} AS device_protection,
    {addon(3)} AS tech_support, {addon(4)} AS streaming_tv,
    CASE WHEN {key} % 3 = 0 THEN 'Yes' ELSE 'No' END AS streaming_movies,
    {flag} AS paperless_billing"""


def _bronze(base: str, end: str) -> str:
    return f"""
    SELECT *, CASE WHEN tenure_days <= 30 THEN 'new_user' WHEN tenure_days <= 180 THEN 'established'
                   ELSE 'mature' END AS cohort,
        CASE WHEN monthly_charges < 800 THEN 'smb' WHEN monthly_charges < 5000 THEN 'mid_market'
             ELSE 'enterprise' END AS ltv_tier,
        CASE WHEN monthly_charges < 800 THEN 1.0 WHEN monthly_charges < 5000 THEN 3.0 ELSE 10.0 END AS sample_weight,
        ROUND(CAST(monthly_charges AS DOUBLE) * GREATEST(12.0::DOUBLE, CAST(tenure_days AS DOUBLE) / 30.0
              + CASE contract_type WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 1 END) * 1.2::DOUBLE, 2) AS estimated_ltv,
        churn_date IS NOT NULL AS churn_label
    FROM (SELECT *, DATE_DIFF('day', signup_date, COALESCE(churn_date, DATE '{end}')) AS tenure_days FROM {base})"""


def _silver(bronze: str, as_of: str) -> str:
    addons = "online_security online_backup device_protection tech_support streaming_tv streaming_movies".split()
    counted = " + ".join(f"CASE WHEN {a} = 'Yes' THEN 1 ELSE 0 END" for a in addons)
    return f"""
    SELECT customer_id, signup_date, lived AS tenure_days,
        CASE WHEN lived <= 30 THEN 'new_user' WHEN lived <= 180 THEN 'established' ELSE 'mature' END AS cohort,
        CASE WHEN monthly_charges < 800 THEN 'smb' WHEN monthly_charges < 5000 THEN 'mid_market' ELSE 'enterprise' END AS ltv_tier,
        contract_type,
        CASE contract_type WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 1 END AS contract_months,
        monthly_charges, CAST(monthly_charges * 14.4 AS DECIMAL(12,2)) AS estimated_ltv,
        COALESCE(phone_service, FALSE) AS has_phone,
        internet_service IS NOT NULL AND internet_service <> 'No' AS has_internet,
        NULLIF(internet_service, 'No') AS internet_type,
        {counted} AS n_addon_services,
        COALESCE(paperless_billing, FALSE) AS paperless_billing, payment_method,
        COALESCE(senior_citizen, FALSE) AS is_senior,
        COALESCE(partner, FALSE) AS has_partner,
        COALESCE(dependents, FALSE) AS has_dependents,
        churn_label, churn_date
    FROM (SELECT *, COALESCE(churn_date, DATE '{as_of}') - signup_date AS lived FROM {bronze})"""


def _silver_tickets(bronze: str) -> str:
    return f"""
    SELECT ticket_id, customer_id, CAST(created_at AS DATE) AS created_date,
        CASE WHEN resolved_at IS NOT NULL THEN EPOCH(resolved_at - created_at) / 86400.0 END AS resolution_days,
        category, priority, COALESCE(CAST(sentiment_score AS DOUBLE), 0) AS sentiment_score,
        COALESCE(escalated, FALSE) AS was_escalated
    FROM {bronze}"""


def gold(prefix: str, snapshots: str, windows=(7, 14, 30), period=7, horizon=30, point_in_time=False, active_only=False) -> str:
    """The 360 for every P of the CTE `snapshots` (column p)."""
    s, m, l = windows
    tenure = "DATE_DIFF('day', c.signup_date, p)" if point_in_time else "c.tenure_days"
    cohort = (
        f"CASE WHEN {tenure} <= 30 THEN 'new_user' WHEN {tenure} <= 180 THEN 'established' ELSE 'mature' END"
        if point_in_time else "c.cohort"
    )
    active = "AND (c.churn_date IS NULL OR c.churn_date > p)" if active_only else ""
    week = lambda i, v: (
        f"COALESCE(SUM({v}) FILTER (WHERE age > {(i - 1) * period} AND age <= {i * period}), 0)"
    )
    win = lambda n, v: f"COALESCE(SUM({v}) FILTER (WHERE age <= {n}), 0)"
    return f"""
    SELECT k.customer_id, k.prediction_date, k.cohort, k.ltv_tier,
        av.days_to_first_login, av.onboarding_completion_pct, av.first_week_logins,
        COALESCE(e.logins_{s}d, 0) AS logins_{s}d, COALESCE(e.logins_{m}d, 0) AS logins_{m}d, COALESCE(e.logins_{l}d, 0) AS logins_{l}d,
        COALESCE(e.features_used_{s}d, 0) AS features_used_{s}d, COALESCE(e.features_used_{l}d, 0) AS features_used_{l}d,
        COALESCE(e.feature_adoption_pct, 0) AS feature_adoption_pct,
        COALESCE(e.session_minutes_{s}d, 0) AS session_minutes_{s}d, COALESCE(e.session_minutes_{l}d, 0) AS session_minutes_{l}d,
        COALESCE(e.avg_session_duration, 0) AS avg_session_duration,
        COALESCE(e.days_since_last_login, 999) AS days_since_last_login,
        COALESCE(e.days_since_last_feature_use, 999) AS days_since_last_feature_use,
        CASE WHEN e.w2 > 0 THEN (e.w1 - e.w2) / CAST(e.w2 AS DOUBLE) WHEN e.w1 > 0 THEN 1.0 ELSE 0.0 END AS login_velocity_wow,
        CASE WHEN e.u2 > 0 THEN (e.u1 - e.u2) / CAST(e.u2 AS DOUBLE) WHEN e.u1 > 0 THEN 1.0 ELSE 0.0 END AS feature_velocity_wow,
        CASE WHEN e.w3 + e.w4 > 0 THEN (e.w1 + e.w2 - e.w3 - e.w4) / CAST(e.w1 + e.w2 + e.w3 + e.w4 + 1 AS DOUBLE) ELSE 0.0 END AS login_trend_4w,
        COALESCE(t.tickets_{l}d, 0) AS tickets_{l}d, COALESCE(t.avg_sentiment_{l}d, 0) AS avg_sentiment_{l}d,
        COALESCE(t.escalation_rate_{l}d, 0) AS escalation_rate_{l}d,
        k.contract_type, k.days_to_renewal,
        CAST(k.monthly_charges AS DOUBLE) * COALESCE(k.days_to_renewal, k.contract_months * 30) / 30.0 AS contract_value_remaining,
        k.tenure_days, k.estimated_ltv, k.sample_weight,
        COALESCE(k.churn_date > k.prediction_date AND k.churn_date <= k.prediction_date + {horizon}, FALSE) AS churned_in_window,
        k.churn_date
    FROM (
        SELECT c.customer_id, p AS prediction_date, c.signup_date, {tenure} AS tenure_days, {cohort} AS cohort, c.ltv_tier,
            c.contract_type, c.contract_months, c.monthly_charges, c.estimated_ltv, c.churn_date,
            CASE c.contract_type WHEN 'Month-to-month' THEN 30 - ({tenure} % 30) WHEN 'One year' THEN 365 - ({tenure} % 365)
                 WHEN 'Two year' THEN 730 - ({tenure} % 730) END AS days_to_renewal,
            CASE c.ltv_tier WHEN 'smb' THEN 1.0 WHEN 'mid_market' THEN 3.0 WHEN 'enterprise' THEN 10.0 ELSE 1.0 END AS sample_weight
        FROM {prefix}silver_customers c JOIN {snapshots} ON c.signup_date <= p {active}
    ) k
    LEFT JOIN (
        SELECT customer_id, p, {win(s, 'login_count')} AS logins_{s}d, {win(m, 'login_count')} AS logins_{m}d, {win(l, 'login_count')} AS logins_{l}d,
            {win(s, 'features_used')} AS features_used_{s}d, {win(l, 'features_used')} AS features_used_{l}d,
            {win(s, 'session_duration_minutes')} AS session_minutes_{s}d, {win(l, 'session_duration_minutes')} AS session_minutes_{l}d,
            MAX(unique_features) / CAST(15 AS DOUBLE) AS feature_adoption_pct,
            AVG(session_duration_minutes / CAST(login_count AS DOUBLE)) FILTER (WHERE login_count > 0) AS avg_session_duration,
            MIN(age) FILTER (WHERE login_count > 0) AS days_since_last_login,
            MIN(age) FILTER (WHERE features_used > 0) AS days_since_last_feature_use,
            {week(1, 'login_count')} AS w1, {week(2, 'login_count')} AS w2, {week(3, 'login_count')} AS w3, {week(4, 'login_count')} AS w4,
            {week(1, 'features_used')} AS u1, {week(2, 'features_used')} AS u2
        FROM (SELECT *, DATE_DIFF('day', activity_date, p) AS age FROM {prefix}engagement JOIN {snapshots} ON activity_date < p)
        GROUP BY customer_id, p
    ) e ON e.customer_id = k.customer_id AND e.p = k.prediction_date
    LEFT JOIN (
        SELECT customer_id, p, COUNT(*) FILTER (WHERE age <= {l}) AS tickets_{l}d,
            AVG(sentiment_score) FILTER (WHERE age <= {l}) AS avg_sentiment_{l}d,
            COUNT(*) FILTER (WHERE age <= {l} AND was_escalated) / CAST(COUNT(*) AS DOUBLE) AS escalation_rate_{l}d
        FROM (SELECT *, DATE_DIFF('day', created_date, p) AS age FROM {prefix}silver_tickets JOIN {snapshots} ON created_date < p)
        GROUP BY customer_id, p
    ) t ON t.customer_id = k.customer_id AND t.p = k.prediction_date
    LEFT JOIN (
        SELECT c.customer_id, p,
            MIN(CASE WHEN login_count > 0 THEN DATE_DIFF('day', c.signup_date, activity_date) END) AS days_to_first_login,
            COALESCE(SUM(CASE WHEN activity_date <= c.signup_date + 7 THEN unique_features ELSE 0 END), 0) / CAST(15 AS DOUBLE) AS onboarding_completion_pct,
            SUM(CASE WHEN activity_date <= c.signup_date + 7 THEN login_count ELSE 0 END) AS first_week_logins
        FROM {prefix}silver_customers c JOIN {snapshots} ON c.signup_date <= p {active}
        LEFT JOIN {prefix}engagement e ON e.customer_id = c.customer_id
        WHERE {cohort} = 'new_user' AND (activity_date IS NULL OR activity_date < p)
        GROUP BY c.customer_id, p
    ) av ON av.customer_id = k.customer_id AND av.p = k.prediction_date"""


CTES: dict[str, str] = {
    "a_flags": """
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderpriority,
        LAG(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
    FROM orders""",
    "a_orders": """
    SELECT o_orderkey, o_custkey, d, o_orderpriority,
        CAST(o_custkey * 100 + SUM(CASE WHEN prev IS NULL OR d - prev > 365 THEN 1 ELSE 0 END)
            OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS customer_id
    FROM a_flags""",
    "a_life": f"""
    SELECT customer_id, MIN(d) AS signup_date,
        CASE WHEN MAX(d) + 365 < DATE '2001-08-01' THEN MAX(d) + 1 END AS churn_date,
        {_attributes('c_custkey')}
    FROM a_orders JOIN customer ON c_custkey = o_custkey
    GROUP BY customer_id, c_custkey, c_mktsegment, c_acctbal, c_nationkey""",
    "a_customers": _bronze("a_life", "2001-08-01"),
    "a_lines": """
    SELECT o.customer_id, o.d, l_partkey, l_quantity FROM lineitem JOIN a_orders o ON l_orderkey = o_orderkey""",
    "a_engagement": """
    SELECT x.customer_id, x.d AS activity_date, x.n AS login_count, COALESCE(y.used, 0) AS features_used,
        COALESCE(y.parts, 0) AS unique_features, COALESCE(y.qty, 0) AS session_duration_minutes
    FROM (SELECT customer_id, d, COUNT(DISTINCT o_orderkey) AS n FROM a_orders GROUP BY 1, 2) x
    LEFT JOIN (SELECT customer_id, d, COUNT(*) AS used, COUNT(DISTINCT l_partkey) AS parts, SUM(l_quantity) AS qty
               FROM a_lines GROUP BY 1, 2) y ON x.customer_id = y.customer_id AND x.d = y.d""",
    "a_returns": """
    SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1""",
    "a_tickets": """
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS ticket_id, o.customer_id,
        l_shipdate AS created_at,
        CASE WHEN l_linestatus <> 'O' THEN l_shipdate + TO_HOURS(CAST(l_quantity AS BIGINT)) END AS resolved_at,
        CASE l_linenumber % 5 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical' WHEN 2 THEN 'account'
             WHEN 3 THEN 'feature_request' ELSE 'general' END AS category,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
        CAST(GREATEST(-1.0, LEAST(1.0, 0.5 - 10 * l_discount)) AS DECIMAL(3,2)) AS sentiment_score,
        l_tax > 0.06 AS escalated
    FROM a_returns JOIN a_orders o ON l_orderkey = o_orderkey""",
    "a_silver_customers": _silver("a_customers", "2001-08-01"),
    "a_silver_tickets": _silver_tickets("a_tickets"),
    "b_life": """
    SELECT user_id AS customer_id,
        COALESCE(MIN(CAST(ts AS DATE)) FILTER (WHERE event_type = 'signup'), MIN(CAST(ts AS DATE))) AS signup_date,
        CASE WHEN MAX(CAST(ts AS DATE)) < DATE '2024-01-29' THEN MAX(CAST(ts AS DATE)) + 1 END AS churn_date
    FROM events GROUP BY user_id""",
    "b_attributed": f"""
    SELECT customer_id, signup_date, churn_date, {_attributes('c_custkey')}
    FROM b_life JOIN customer ON c_custkey = customer_id""",
    "b_customers": _bronze("b_attributed", "2024-01-30"),
    "b_days": """
    SELECT user_id AS customer_id, CAST(ts AS DATE) AS activity_date,
        COUNT(*) FILTER (WHERE event_type = 'view') AS login_count,
        COUNT(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS features_used,
        COUNT(DISTINCT CASE WHEN event_type IN ('click', 'purchase')
            THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END) AS unique_features,
        CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS session_duration_minutes
    FROM events GROUP BY 1, 2""",
    "b_engagement": """
    SELECT d.* FROM b_days d JOIN b_life l ON d.customer_id = l.customer_id WHERE activity_date >= signup_date""",
    "b_tickets": """
    SELECT event_id AS ticket_id, user_id AS customer_id, ts AS created_at,
        CASE WHEN event_id % 10 <> 0 THEN ts + TO_SECONDS(CAST(ROUND(value * 3600) AS BIGINT)) END AS resolved_at,
        CASE event_id % 5 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical' WHEN 2 THEN 'account'
             WHEN 3 THEN 'feature_request' ELSE 'general' END AS category,
        CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
        CASE WHEN event_id % 7 <> 0 THEN CAST(GREATEST(-1.0, LEAST(1.0, (50 - value) / 50)) AS DECIMAL(5,4)) END AS sentiment_score,
        CASE WHEN event_id % 11 <> 0 THEN value > 100 END AS escalated
    FROM events WHERE event_type = 'error'""",
    "b_silver_customers": _silver("b_customers", "2024-01-30"),
    "b_silver_tickets": _silver_tickets("b_tickets"),
    "b_p": "SELECT DATE '2024-01-29' AS p",
    "b_gold": gold("b_", "b_p"),
    "a_p": "SELECT DATE '1998-06-01' AS p",
    "a_gold": gold("a_", "a_p", (30, 90, 180), 30, 90, point_in_time=True, active_only=True),
    # every 30 days from 1997-01-01 to 2000-01-01: the model snapshots
    "a_ps": "SELECT DATE '1997-01-01' + CAST(i AS INTEGER) AS p FROM range(0, 1096, 30) t(i)",
    "a_train": gold("a_", "a_ps", (30, 90, 180), 30, 90, point_in_time=True, active_only=True),
    # labelled rows with a deterministic score, one snapshot and all snapshots
    "a_scored": """
    SELECT customer_id, prediction_date, cohort, ltv_tier, contract_type, estimated_ltv, churn_date,
        CASE WHEN churned_in_window THEN 1 ELSE 0 END AS label,
        CAST((customer_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score
    FROM (SELECT c.customer_id, p AS prediction_date, c.ltv_tier, c.contract_type, c.estimated_ltv, c.churn_date,
            CASE WHEN p - signup_date <= 30 THEN 'new_user' WHEN p - signup_date <= 180 THEN 'established' ELSE 'mature' END AS cohort,
            COALESCE(churn_date > p AND churn_date <= p + 90, FALSE) AS churned_in_window
          FROM a_silver_customers c JOIN a_p ON signup_date <= p AND (churn_date IS NULL OR churn_date > p))""",
    "a_scored_all": """
    SELECT customer_id, prediction_date, cohort, ltv_tier, contract_type, estimated_ltv, churn_date,
        CASE WHEN churned_in_window THEN 1 ELSE 0 END AS label,
        CAST((customer_id * 7919 + DATE_DIFF('day', DATE '1997-01-01', prediction_date) * 31) % 1000 AS DOUBLE) / 1000.0 AS score
    FROM (SELECT c.customer_id, p AS prediction_date, c.ltv_tier, c.contract_type, c.estimated_ltv, c.churn_date,
            CASE WHEN p - signup_date <= 30 THEN 'new_user' WHEN p - signup_date <= 180 THEN 'established' ELSE 'mature' END AS cohort,
            COALESCE(churn_date > p AND churn_date <= p + 90, FALSE) AS churned_in_window
          FROM a_silver_customers c JOIN a_ps ON signup_date <= p AND (churn_date IS NULL OR churn_date > p))""",
}
