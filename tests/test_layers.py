import datetime as dt
import re
from uuid import uuid4

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tenuria.plans.inputs import activity_tables
from tenuria.sources import layers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    names = layers.create_layers(spark)
    assert layers.create_layers(spark) == names and len(names) == 7
    return activity_tables(spark, SMALL)


def test_load_is_by_name_and_a_full_refresh(spark, tables):
    shuffled = tables.customers.select(*reversed(tables.customers.columns))
    n = shuffled.count()
    assert layers.load(shuffled, "bronze.customers") == n
    assert layers.load(shuffled, "bronze.customers") == n
    assert layers.load(tables.silver_customers, "silver.customers") == n
    got = {r["name"]: r["n"] for r in rows(layers.table_counts(spark))}
    assert got["bronze.customers"] == n and got["silver.customers"] == n and got["bronze.events"] == 0
    assert len(got) == 7


def test_snapshot_replace_is_idempotent_and_local(spark, tables):
    one, two = tables.gold("2024-01-20"), tables.gold("2024-01-25")
    layers.replace_snapshots(one)
    layers.replace_snapshots(two)
    layers.replace_snapshots(two)
    per_date = {str(r["prediction_date"]): r["count"] for r in rows(spark.table("gold.customer_360").groupBy("prediction_date").count())}
    assert per_date == {"2024-01-20": one.count(), "2024-01-25": two.count()}
    read = layers.read_customer_360(spark, "2024-01-25", "new_user")
    assert read.count() == two.where("cohort = 'new_user'").count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prediction_date", plan)


def test_csv_seed(spark, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("customerID,Partner,SeniorCitizen,StreamingTV,Contract,MonthlyCharges,Churn\n"
                    "A,Yes,1,No,One year,10.50,No\nB,maybe,0,Yes,Two year,,Yes\n")
    got = rows(layers.read_csv_seed(spark, str(path)), "customer_id")
    assert list(got[0]) == ["customer_id", "partner", "senior_citizen", "streaming_tv", "contract_type", "monthly_charges", "churn_label"]
    assert got[0]["partner"] is True and got[0]["senior_citizen"] is True and got[0]["churn_label"] is False
    assert got[1]["partner"] is None and got[1]["monthly_charges"] is None and got[1]["streaming_tv"] == "Yes"


def test_bad_csv_lines(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("customerID,Partner,Churn\nA,Yes,No\nB,No\nC,Yes,No,more\nD,No,Yes\n")
    read = lambda bad: layers.read_csv_seed(spark, str(path), bad)
    assert [r["customer_id"] for r in rows(read("keep"), "customer_id")] == list("ABCD")
    assert rows(read("drop"), "customer_id") == [{"customer_id": "A", "partner": True, "churn_label": False}, {"customer_id": "D", "partner": False, "churn_label": True}]
    assert sorted(r[layers.BAD] for r in rows(read("only"))) == ["B,No", "C,Yes,No,more"]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read("fail").collect()


def test_replacing_leaves_the_session_alone(spark, tmp_path):
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    make = lambda v, *days: spark.createDataFrame([(v, d) for d in days], "v INT, prediction_date STRING")
    for df in (make(1, "2024-01-01", "2024-01-02"), make(2, "2024-01-02"), make(2, "2024-01-02")):
        layers.replace_snapshots_at(df, str(tmp_path / "t"))
    assert spark.conf.get(name) == before
    assert [(str(r["prediction_date"]), r["v"]) for r in rows(spark.read.parquet(str(tmp_path / "t")), "prediction_date")] == [("2024-01-01", 1), ("2024-01-02", 2)]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_sinks_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id INT, name STRING, v DOUBLE")
    path = str(tmp_path / fmt)
    layers.write(df, path, fmt)
    layers.write(df, path, fmt)
    back = spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
    assert rows(back, "id") == rows(df, "id")
    with pytest.raises(ValueError):
        layers.write(df, path, "xml")


def test_bucketed_table_feeds_features_without_an_exchange(spark, tables):
    from tenuria.operators import features

    name = f"engagement_{uuid4().hex[:8]}"
    layers.bucketed(tables.engagement, name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = features.engagement(spark.table(name), "2024-01-29")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_date_filter_and_columns_reach_the_scan(spark, tmp_path):
    from tenuria.operators import features

    layers.write(activity_tables(spark, SMALL).engagement, str(tmp_path / "daily"))
    plan = features.engagement(spark.read.parquet(str(tmp_path / "daily")), "2024-01-29")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(activity_date,2024-01-29)" in plan


def test_prediction_dates_are_checked():
    from tenuria.operators.snapshots import as_dates, date_grid

    assert date_grid("2024-01-01", "2024-01-15", 7) == [dt.date(2024, 1, 1), dt.date(2024, 1, 8), dt.date(2024, 1, 15)]
    with pytest.raises(ValueError):
        as_dates([])


def test_events_load_keeps_the_payload(spark, tables):
    from tenuria.sources import activity

    events = activity.bronze_events(spark, SMALL)
    assert layers.load(events, "bronze.events") == events.count()
    assert spark.table("bronze.events").where(F.col("event_properties").isNull()).count() == 0


def test_layers_derive_each_table_from_the_raw_ones_once(spark, monkeypatch):
    """Two loads of five tables: days, customers, tickets and engagement are worked out once each, and a load shuffles nothing."""
    from tenuria.plans import silver_queries
    from tenuria.sources import accounts

    calls, plans = [], []
    for name in ("account_days", "customers", "tickets", "engagement"):
        made = getattr(accounts, name)
        monkeypatch.setattr(accounts, name, lambda *a, name=name, made=made: calls.append(name) or made(*a))
    load = layers.load
    monkeypatch.setattr(layers, "load", lambda df, table: plans.append(df._jdf.queryExecution().executedPlan().toString()) or load(df, table))
    counted = silver_queries.create_layers(spark, "/root/testdata/sf0.001")
    assert counted.count() == 7 and sorted(calls) == ["account_days", "customers", "engagement", "tickets"]
    assert len(plans) == 10 and not any("Exchange" in p for p in plans)
