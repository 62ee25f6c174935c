"""Registered queries: sources, table maintenance, silver projections."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tenuria import schemas
from tenuria.functions import columns as C
from tenuria.operators import silver
from tenuria.plans.inputs import A_SNAPSHOTS, account_gold, account_tables, activity_tables
from tenuria.plans.registry import Check, query
from tenuria.session import shared_dir, stored
from tenuria.sources import accounts, activity, layers, star

ADD_ON = " ".join(silver.ADDON_COLUMNS)


@query(
    "scan_parquet",
    Check(
        "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'view' AND value > 10",
        "event_id user_id", "value", "event_type day",
    ),
)
def scan_parquet(spark, d):
    return (
        star.read(spark, d, "events")
        .where("event_type = 'view' AND value > 10")
        .select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "value")
    )


@query(
    "bronze_customers",
    Check(
        "SELECT CAST(customer_id AS VARCHAR) AS id, * EXCLUDE (customer_id) FROM a_customers",
        "tenure_days", "monthly_charges estimated_ltv sample_weight",
        "id signup_date cohort ltv_tier contract_type payment_method gender senior_citizen partner dependents "
        f"phone_service multiple_lines internet_service {ADD_ON} paperless_billing churn_label churn_date",
    ),
)
def bronze_customers(spark, d):
    rows = account_tables(spark, d).customers
    return silver.align_columns(rows, schemas.struct(schemas.BRONZE_CUSTOMERS)).withColumnRenamed("customer_id", "id")


@query(
    "bronze_events",
    Check(
        "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id, event_type, "
        "EPOCH_US(ts) AS event_us, props AS event_properties FROM events",
        "event_us", "", "event_id customer_id event_type event_properties",
    ),
)
def bronze_events(spark, d):
    rows = silver.align_columns(activity.bronze_events(spark, d), schemas.struct(schemas.BRONZE_EVENTS))
    return rows.withColumn("event_timestamp", F.unix_micros("event_timestamp")).withColumnRenamed(
        "event_timestamp", "event_us"
    )


@query(
    "bronze_tickets",
    Check(
        "SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, CAST(customer_id AS VARCHAR) AS customer_id, "
        "EPOCH(created_at) AS created_s, EPOCH(resolved_at) AS resolved_s, category, priority, sentiment_score, escalated FROM a_tickets",
        "created_s resolved_s", "sentiment_score", "ticket_id customer_id category priority escalated",
    ),
)
def bronze_tickets(spark, d):
    rows = silver.align_columns(account_tables(spark, d).tickets, schemas.struct(schemas.BRONZE_TICKETS))
    return rows.select(
        "ticket_id",
        "customer_id",
        F.unix_seconds("created_at").alias("created_s"),
        F.unix_seconds("resolved_at").alias("resolved_s"),
        "category",
        "priority",
        "sentiment_score",
        "escalated",
    )


@query(
    "dedup_first",
    Check("SELECT * FROM a_returns",
          "l_orderkey l_linenumber l_partkey l_suppkey", "l_quantity l_extendedprice l_discount l_tax", "l_linestatus"),
)
def dedup_first(spark, d):
    return accounts.deduplicated_lines(accounts.returned_lines(spark, d)).drop("l_shipdate")


@query(
    "dedup_report",
    Check(
        "SELECT COUNT(*) AS rows_before, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS rows_after, "
        "COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS rows_removed FROM lineitem WHERE l_returnflag = 'R'",
        "rows_before rows_after rows_removed",
    ),
)
def dedup_report(spark, d):
    return silver.dedup_report(accounts.returned_lines(spark, d), ["l_orderkey", "l_linenumber"])


@query(
    "align_columns",
    Check(
        "SELECT customer_id, COALESCE(senior_citizen, FALSE) AS senior_citizen, COALESCE(partner, FALSE) AS partner, "
        "COALESCE(phone_service, FALSE) AS phone_service, CAST(NULL AS VARCHAR) AS referral_code FROM a_customers",
        "customer_id", "", "senior_citizen partner phone_service referral_code",
    ),
)
def align_columns(spark, d):
    schema = schemas.struct(
        "customer_id BIGINT, senior_citizen BOOLEAN, partner BOOLEAN, phone_service BOOLEAN, referral_code STRING"
    )
    return silver.align_columns(
        account_tables(spark, d).customers, schema, ("senior_citizen", "partner", "phone_service")
    )


@query(
    "total_charges",
    Check(
        "SELECT customer_id, CAST(monthly_charges AS DOUBLE) * tenure_days / 30 AS total_charges FROM a_customers",
        "customer_id", "total_charges",
    ),
)
def total_charges(spark, d):
    return account_tables(spark, d).customers.select(
        "customer_id", C.total_charges("monthly_charges", "tenure_days").alias("total_charges")
    )


@query(
    "read_customer_360",
    Check(
        "SELECT customer_id, prediction_date, logins_30d, contract_value_remaining, churned_in_window "
        "FROM a_gold WHERE prediction_date = DATE '1998-06-01' AND cohort = 'established'",
        "customer_id logins_30d", "contract_value_remaining", "prediction_date churned_in_window",
    ),
)
def read_customer_360(spark, d):
    from tenuria.plans.inputs import A_DATE, account_gold

    return layers.filter_customer_360(account_gold(spark, d), A_DATE, "established").select(
        "customer_id", "prediction_date", "logins_30d", "contract_value_remaining", "churned_in_window"
    )


@query(
    "param_sql",
    Check(
        "SELECT event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(12,2))) AS total FROM events "
        "WHERE ts >= TIMESTAMP '2024-01-15' AND value > 5 GROUP BY event_type",
        "n", "total", "event_type",
    ),
)
def param_sql(spark, d):
    return spark.sql(
        "SELECT event_type, count(*) AS n, sum(cast(value AS decimal(12,2))) AS total FROM {events} "
        "WHERE ts >= cast(:since AS timestamp_ntz) AND value > :floor GROUP BY event_type",
        args={"since": "2024-01-15", "floor": 5},
        events=star.read(spark, d, "events"),
    )


@query(
    "table_counts",
    Check(
        "SELECT 'bronze.customers' AS name, COUNT(*) AS n FROM a_customers UNION ALL "
        "SELECT 'bronze.support_tickets', COUNT(*) FROM a_tickets UNION ALL "
        "SELECT 'silver.daily_engagement', COUNT(*) FROM a_engagement",
        "n", "", "name",
    ),
)
def table_counts(spark, d):
    t = account_tables(spark, d)
    return layers.count_rows(
        {"bronze.customers": t.customers, "bronze.support_tickets": t.tickets, "silver.daily_engagement": t.engagement}
    )


@query(
    "json_payload",
    Check(
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
        "event_id k",
    ),
)
def json_payload(spark, d):
    events = activity.bronze_events(spark, d)
    payload = F.from_json("event_properties", "k BIGINT")
    return events.select("event_id", payload["k"].alias("k"))


# -- round trips ----------------------------------------------------------------

_SEED = {
    "customer_id": "customerID", "gender": "gender", "senior_citizen": "SeniorCitizen", "partner": "Partner", "internet_service": "InternetService",
    "streaming_tv": "StreamingTV", "contract_type": "Contract", "monthly_charges": "MonthlyCharges", "churn_label": "Churn",
}


@query(
    "scan_csv_normalize",
    Check("SELECT " + ", ".join("CAST(customer_id AS VARCHAR) AS customer_id" if c == "customer_id" else c for c in _SEED) + " FROM a_customers",
          "", "monthly_charges", " ".join(c for c in _SEED if c != "monthly_charges")),
)
def scan_csv_normalize(spark, d):
    """Customers written with the seed's headers and words, read back with the engine's names and types."""
    rows, path = account_tables(spark, d).customers, f"{shared_dir(spark)}/seed-{uuid4().hex}"
    words = lambda c: F.when(F.col(c), "1" if c == "senior_citizen" else "Yes").when(~F.col(c), "0" if c == "senior_citizen" else "No")
    flags = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "boolean"}
    layers.write(rows.select(*[(words(c) if c in flags else F.col(c)).alias(n) for c, n in _SEED.items()]), path, "csv")
    return layers.read_csv_seed(spark, path, "drop")


_LAYERED = {"bronze.customers": "a_customers", "bronze.support_tickets": "a_tickets", "silver.customers": "a_silver_customers",
            "silver.daily_engagement": "a_engagement", "silver.support_tickets": "a_tickets"}


@query(
    "create_layers",
    Check(" UNION ALL ".join([*[f"SELECT '{t}' AS name, COUNT(*) AS n FROM {c}" for t, c in _LAYERED.items()],
                              *[f"SELECT '{t}' AS name, 0 AS n" for t in schemas.TABLES if t not in _LAYERED]]), "n", "", "name"),
)
def create_layers(spark, d):
    """All layers created twice and loaded twice: a full refresh leaves one copy of the rows."""
    t, prefix = account_tables(spark, d), f"run{uuid4().hex[:12]}_"
    # Each table is derived from the raw ones once; silver tables and both loads read what was written.
    days = stored(accounts.account_days(spark, d))
    customers, tickets, engagement = (stored(table(spark, d, days)) for table in (accounts.customers, accounts.tickets, accounts.engagement))
    source = {"bronze.customers": customers, "bronze.support_tickets": tickets, "silver.customers": silver.silver_customers(customers, t.source.END),
              "silver.daily_engagement": engagement, "silver.support_tickets": silver.silver_tickets(tickets)}
    try:
        for _ in range(2):
            layers.create_layers(spark, prefix)
            for name, rows in source.items():
                layers.load(rows, prefix + name)
        return stored(layers.table_counts(spark, prefix))
    finally:
        layers.drop_layers(spark, prefix)


_REPLACED = (A_SNAPSHOTS[18], A_SNAPSHOTS[24])


@query(
    "snapshot_replace",
    Check("SELECT customer_id, prediction_date, cohort, logins_30d, churned_in_window FROM a_train "
          f"WHERE prediction_date IN ({', '.join(f'DATE {str(p)!r}' for p in _REPLACED)})", "customer_id logins_30d", "", "prediction_date cohort churned_in_window"),
)
def snapshot_replace(spark, d):
    """Two snapshots with wrong values, then both replaced, then one once more: right rows, each once."""
    path = f"{shared_dir(spark)}/snapshots-{uuid4().hex}"
    right = stored(account_gold(spark, d, _REPLACED).select("customer_id", "prediction_date", "cohort", "logins_30d", "churned_in_window"))
    layers.replace_snapshots_at(right.withColumn("logins_30d", F.col("logins_30d") + 1), path)
    for rows in (right, right.where(F.col("prediction_date") == C.day(_REPLACED[1]))):
        layers.replace_snapshots_at(rows, path)
    return spark.read.schema(right.schema).parquet(path)


@query(
    "sink_parquet_csv_json",
    Check("SELECT format, contract_type, COUNT(*) AS n, SUM(CAST(monthly_charges AS DECIMAL(12,2))) AS charges, MIN(signup_date) AS first_day "
          "FROM a_customers, (VALUES ('parquet'), ('csv'), ('json')) f(format) GROUP BY ALL", "n", "charges", "format contract_type first_day"),
)
def sink_parquet_csv_json(spark, d):
    """Customers written twice in each format, partitioned by contract, and read back with their types."""
    rows = account_tables(spark, d).customers.select("customer_id", "signup_date", F.col("monthly_charges").cast("decimal(12,2)").alias("monthly_charges"), "contract_type")
    rows, out = stored(rows), None
    for fmt in ("parquet", "csv", "json"):
        path = f"{shared_dir(spark)}/sink-{fmt}-{uuid4().hex}"
        for _ in range(2):
            layers.write(rows, path, fmt, ["contract_type"])
        back = spark.read.schema(rows.schema).option("header", True).format(fmt).load(path).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("format", "contract_type").agg(F.count("*").alias("n"), F.sum("monthly_charges").alias("charges"), F.min("signup_date").alias("first_day"))


# -- scalar functions ---------------------------------------------------------

# key -> (column builder, kind of output, column of the check CTE)
_SCALAR = {
    "tenure_days": (lambda: C.tenure_days("signup_date", "churn_date", accounts.END), "ints", "tenure_days"),
    "cohort": (lambda: C.cohort_of(C.tenure_days("signup_date", "churn_date", accounts.END)), "other", "cohort"),
    "ltv_tier": (lambda: C.ltv_tier("monthly_charges"), "other", "ltv_tier"),
    "contract_months": (lambda: C.contract_months("contract_type"), "ints", "contract_months"),
    "ltv_flat": (lambda: C.ltv_flat("monthly_charges"), "reals", "estimated_ltv"),
}


def _register_scalar(key):
    column, kind, expected = _SCALAR[key]
    kinds = {"ints": "customer_id", "reals": "", "other": ""}
    kinds[kind] = (kinds[kind] + f" {key}").strip()

    @query(key, Check(f"SELECT customer_id, {expected} AS {key} FROM a_silver_customers", **kinds))
    def scalar(spark, d):
        return account_tables(spark, d).customers.select("customer_id", column().alias(key))


for _key in _SCALAR:
    _register_scalar(_key)


@query(
    "ltv_tenure",
    Check("SELECT customer_id, estimated_ltv AS ltv_tenure FROM a_customers", "customer_id", "ltv_tenure"),
)
def ltv_tenure(spark, d):
    return account_tables(spark, d).customers.select(
        "customer_id", F.round(C.ltv_tenure("monthly_charges", "contract_type", "tenure_days"), 2).alias("ltv_tenure")
    )


@query(
    "service_flags",
    Check("SELECT customer_id, has_phone, has_internet, internet_type FROM a_silver_customers",
          "customer_id", "", "has_phone has_internet internet_type"),
)
def service_flags(spark, d):
    return account_tables(spark, d).customers.select(
        "customer_id",
        F.coalesce("phone_service", F.lit(False)).alias("has_phone"),
        C.has_internet("internet_service").alias("has_internet"),
        C.internet_type("internet_service").alias("internet_type"),
    )


@query(
    "n_addon_services",
    Check("SELECT customer_id, n_addon_services FROM a_silver_customers", "customer_id n_addon_services"),
)
def n_addon_services(spark, d):
    return account_tables(spark, d).customers.select(
        "customer_id", C.n_addons(silver.ADDON_COLUMNS).alias("n_addon_services")
    )


@query(
    "bool_defaults",
    Check("SELECT customer_id, paperless_billing, is_senior, has_partner, has_dependents FROM a_silver_customers",
          "customer_id", "", "paperless_billing is_senior has_partner has_dependents"),
)
def bool_defaults(spark, d):
    false = F.lit(False)
    return account_tables(spark, d).customers.select(
        "customer_id",
        F.coalesce("paperless_billing", false).alias("paperless_billing"),
        F.coalesce("senior_citizen", false).alias("is_senior"),
        F.coalesce("partner", false).alias("has_partner"),
        F.coalesce("dependents", false).alias("has_dependents"),
    )


@query(
    "silver_customers",
    Check(
        "SELECT * FROM a_silver_customers",
        "customer_id tenure_days contract_months n_addon_services", "monthly_charges estimated_ltv",
        "signup_date cohort ltv_tier contract_type has_phone has_internet internet_type paperless_billing "
        "payment_method is_senior has_partner has_dependents churn_label churn_date",
    ),
)
def silver_customers(spark, d):
    return account_tables(spark, d).silver_customers


@query(
    "silver_tickets",
    Check("SELECT * FROM b_silver_tickets", "ticket_id customer_id", "resolution_days sentiment_score",
          "created_date category priority was_escalated"),
)
def silver_tickets(spark, d):
    return activity_tables(spark, d).silver_tickets


@query(
    "silver_engagement",
    Check(
        "SELECT *, 0 AS support_tickets_opened, 0 AS support_tickets_resolved FROM a_engagement",
        "customer_id login_count features_used unique_features support_tickets_opened support_tickets_resolved",
        "session_duration_minutes", "activity_date",
    ),
)
def silver_engagement(spark, d):
    return silver.silver_engagement(account_tables(spark, d).engagement)


@query(
    "events_to_daily",
    Check(
        """
        SELECT COALESCE(e.customer_id, t.customer_id) AS customer_id, COALESCE(e.activity_date, t.day) AS activity_date,
            COALESCE(login_count, 0) AS login_count, COALESCE(features_used, 0) AS features_used,
            COALESCE(unique_features, 0) AS unique_features, COALESCE(session_duration_minutes, 0) AS session_duration_minutes,
            COALESCE(opened, 0) AS support_tickets_opened, COALESCE(resolved, 0) AS support_tickets_resolved
        FROM b_days e FULL JOIN (
            SELECT customer_id, day, SUM(o) AS opened, SUM(r) AS resolved FROM (
                SELECT customer_id, CAST(created_at AS DATE) AS day, 1 AS o, 0 AS r FROM b_tickets UNION ALL
                SELECT customer_id, CAST(resolved_at AS DATE), 0, 1 FROM b_tickets WHERE resolved_at IS NOT NULL)
            GROUP BY 1, 2) t ON e.customer_id = t.customer_id AND e.activity_date = t.day""",
        "customer_id login_count features_used unique_features support_tickets_opened support_tickets_resolved",
        "session_duration_minutes", "activity_date",
    ),
)
def events_to_daily(spark, d):
    days = activity.user_days(spark, d).drop("signups")
    return silver.with_ticket_days(days, activity_tables(spark, d).tickets)


@query(
    "derived_months",
    Check(
        "SELECT customer_id, strftime(signup_date, '%Y-%m') AS signup_month, strftime(churn_date, '%Y-%m') AS churn_month, "
        "CASE WHEN ABS(x - FLOOR(x) - 0.5) < 1e-9 THEN 2 * ROUND(x / 2) ELSE ROUND(x) END AS months_to_churn "
        "FROM (SELECT *, (churn_date - signup_date) / CAST(30 AS DOUBLE) AS x FROM a_silver_customers)",
        "customer_id months_to_churn", "", "signup_month churn_month",
    ),
)
def derived_months(spark, d):
    from tenuria.operators.profiling import derived_months

    return derived_months(account_tables(spark, d).silver_customers).select(
        "customer_id", "signup_month", "churn_month", "months_to_churn"
    )


@query(
    "encode_categoricals",
    Check(
        "SELECT customer_id, CASE cohort WHEN 'new_user' THEN 0 WHEN 'mature' THEN 2 ELSE 1 END AS cohort_encoded, "
        "CASE ltv_tier WHEN 'mid_market' THEN 1 WHEN 'enterprise' THEN 2 ELSE 0 END AS ltv_tier_encoded, "
        "CASE contract_type WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END AS contract_type_encoded FROM a_silver_customers",
        "customer_id cohort_encoded ltv_tier_encoded contract_type_encoded",
    ),
)
def encode_categoricals(spark, d):
    from tenuria.operators.training import encode_categoricals

    return encode_categoricals(account_tables(spark, d).silver_customers).select(
        "customer_id", "cohort_encoded", "ltv_tier_encoded", "contract_type_encoded"
    )
