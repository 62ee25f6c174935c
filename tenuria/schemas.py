"""Fixed table schemas of the bronze, silver and gold layers.

Types are the table-boundary types; operators compute in double and long.
Written as DDL strings because that is what `StructType.fromDDL`, `spark.read.schema`
and `saveAsTable` all take.
"""

from __future__ import annotations

from pyspark.sql import types as T

BRONZE_CUSTOMERS = """
    customer_id STRING NOT NULL, signup_date DATE NOT NULL, tenure_days INT,
    cohort STRING, ltv_tier STRING, contract_type STRING,
    monthly_charges DECIMAL(10,2), estimated_ltv DECIMAL(12,2), sample_weight DECIMAL(8,4),
    payment_method STRING, gender STRING,
    senior_citizen BOOLEAN, partner BOOLEAN, dependents BOOLEAN, phone_service BOOLEAN,
    multiple_lines STRING, internet_service STRING,
    online_security STRING, online_backup STRING, device_protection STRING,
    tech_support STRING, streaming_tv STRING, streaming_movies STRING,
    paperless_billing BOOLEAN, churn_label BOOLEAN, churn_date DATE"""

BRONZE_EVENTS = """
    event_id STRING NOT NULL, customer_id STRING NOT NULL, event_type STRING NOT NULL,
    event_timestamp TIMESTAMP NOT NULL, event_properties STRING"""

BRONZE_TICKETS = """
    ticket_id STRING NOT NULL, customer_id STRING NOT NULL, created_at TIMESTAMP NOT NULL,
    resolved_at TIMESTAMP, category STRING, priority STRING,
    sentiment_score DECIMAL(3,2), escalated BOOLEAN"""

SILVER_CUSTOMERS = """
    customer_id STRING NOT NULL, signup_date DATE NOT NULL, tenure_days INT,
    cohort STRING, ltv_tier STRING, contract_type STRING, contract_months INT,
    monthly_charges DECIMAL(10,2), estimated_ltv DECIMAL(12,2),
    has_phone BOOLEAN, has_internet BOOLEAN, internet_type STRING, n_addon_services INT,
    paperless_billing BOOLEAN, payment_method STRING,
    is_senior BOOLEAN, has_partner BOOLEAN, has_dependents BOOLEAN,
    churn_label BOOLEAN, churn_date DATE"""

SILVER_ENGAGEMENT = """
    customer_id STRING NOT NULL, activity_date DATE NOT NULL, login_count INT,
    session_duration_minutes DECIMAL(10,2), features_used INT, unique_features INT,
    support_tickets_opened INT, support_tickets_resolved INT"""

SILVER_TICKETS = """
    ticket_id STRING NOT NULL, customer_id STRING NOT NULL, created_date DATE NOT NULL,
    resolution_days DECIMAL(5,2), category STRING, priority STRING,
    sentiment_score DECIMAL(3,2), was_escalated BOOLEAN"""

GOLD_CUSTOMER_360 = """
    customer_id STRING NOT NULL, prediction_date DATE NOT NULL, cohort STRING, ltv_tier STRING,
    days_to_first_login INT, onboarding_completion_pct DECIMAL(5,2), first_week_logins INT,
    logins_7d INT, logins_14d INT, logins_30d INT,
    features_used_7d INT, features_used_30d INT, feature_adoption_pct DECIMAL(5,2),
    session_minutes_7d DECIMAL(10,2), session_minutes_30d DECIMAL(10,2),
    avg_session_duration DECIMAL(10,2),
    days_since_last_login INT, days_since_last_feature_use INT,
    login_velocity_wow DECIMAL(8,4), feature_velocity_wow DECIMAL(8,4), login_trend_4w DECIMAL(8,4),
    tickets_30d INT, avg_sentiment_30d DECIMAL(5,2), escalation_rate_30d DECIMAL(5,2),
    contract_type STRING, days_to_renewal INT, contract_value_remaining DECIMAL(12,2),
    tenure_days INT, estimated_ltv DECIMAL(12,2), sample_weight DECIMAL(8,4),
    churned_in_window BOOLEAN, churn_date DATE"""

# database.table -> (DDL, partition columns)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bronze.customers": (BRONZE_CUSTOMERS, ()),
    "bronze.events": (BRONZE_EVENTS, ()),
    "bronze.support_tickets": (BRONZE_TICKETS, ()),
    "silver.customers": (SILVER_CUSTOMERS, ()),
    "silver.daily_engagement": (SILVER_ENGAGEMENT, ()),
    "silver.support_tickets": (SILVER_TICKETS, ()),
    "gold.customer_360": (GOLD_CUSTOMER_360, ("prediction_date",)),
}


def struct(ddl: str) -> T.StructType:
    """Parse one of the DDL strings above."""
    return T.StructType.fromDDL(" ".join(ddl.split()))
