import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from tenuria.operators import playbooks
from tenuria.plans import catalog
from tenuria.sources import activity
from tenuria.streaming import alerts, daily

SMALL = "/root/testdata/sf0.001"


def _split(spark, folder, parts=3):
    """The events in time order over several files."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(parts):
        first, last = F.lit(dt.date(2024, 1, 1 + 10 * i)), F.lit(dt.date(2024, 1, 11 + 10 * i))
        day = F.to_date("ts")
        events.where((day >= first) & (day < last)).coalesce(1).write.mode("append").parquet(folder)


def _days(stream, **options):
    key = F.get_json_object("event_properties", "$.k").cast("int")
    return daily.daily_engagement(stream, ("view",), ("click", "purchase"), key, F.col("minutes"), **options)


def test_stream_equals_batch_for_closed_days(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    _split(spark, source)
    query = (_days(daily.read_events(spark, source, 1)).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).option("path", sink).trigger(availableNow=True).start())
    query.awaitTermination()
    got = spark.read.parquet(sink)
    closed = got.agg(F.max("activity_date")).first()[0]
    assert closed >= dt.date(2024, 1, 27)
    batch = activity.user_days(spark, SMALL).drop("signups").where(F.col("activity_date") <= F.lit(closed))
    assert rows(got.select(*batch.columns), "customer_id", "activity_date") == rows(batch, "customer_id", "activity_date")


def test_stream_dedup_keeps_one_row_per_id(spark):
    assert catalog.queries()["stream_dedup"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_velocity_batches_equal_the_batch_operator_and_repeat_safely(spark, tmp_path):
    people = [(1, "enterprise"), (2, "smb"), (3, "smb"), (9, "smb")]
    customers = spark.createDataFrame(people, "customer_id BIGINT, ltv_tier STRING")
    start = dt.date(2024, 1, 1)
    per_week = {1: [10, 7, 4, 4], 2: [10, 9, 5, 0], 3: [10, 5, 0, 0]}
    all_days = [(c, start + dt.timedelta(days=7 * w), n) for c, ns in per_week.items() for w, n in enumerate(ns) if n]
    all_days += [(9, start + dt.timedelta(days=d), 1) for d in range(28)]
    schema = "customer_id BIGINT, activity_date DATE, login_count INT"
    run = alerts.velocity_batches(str(tmp_path / "daily"), str(tmp_path / "alerts"), customers, "2024-01-01")
    bounds = [0, 4, 13, 20, 28]
    for batch_id, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = [r for r in all_days if lo <= (r[1] - start).days < hi]
        run(spark.createDataFrame(part, schema), batch_id)
        run(spark.createDataFrame(part, schema), batch_id)
    # What a batch leaves: three weeks of sums at most, whatever was stored before, so the days of earlier batches may go.
    sums = spark.read.parquet(str(tmp_path / "alerts-sums" / "weeks"))
    assert [r["n"] for r in sums.groupBy("batch_id").agg(F.countDistinct("week_start").alias("n")).orderBy("batch_id").collect()] == [1, 2, 3, 2]
    want = playbooks.velocity_alert(spark.createDataFrame(all_days, schema), customers, "2024-01-01", "2024-01-29")
    cols = ["customer_id", "week_start", "logins", "action"]
    streamed = rows(alerts.latest_alerts(spark, str(tmp_path / "alerts")).select(*cols), "customer_id", "week_start")
    assert streamed == rows(want.select(*cols), "customer_id", "week_start")
    assert {(r["customer_id"], str(r["week_start"]), r["action"]) for r in streamed} == {
        (1, "2024-01-15", "CSM call"), (2, "2024-01-22", "Re-engagement campaign"),
        (3, "2024-01-15", "Re-engagement campaign"),
    }


def test_velocity_batches_carry_on_over_empty_batches(spark, tmp_path):
    schema = "customer_id BIGINT, activity_date DATE, login_count INT"
    customers = spark.createDataFrame([(1, "smb")], "customer_id BIGINT, ltv_tier STRING")
    days = [(1, dt.date(2024, 1, 1), 10), (1, dt.date(2024, 1, 8), 6), (1, dt.date(2024, 1, 15), 2), (1, dt.date(2024, 1, 22), 1)]
    run = alerts.velocity_batches(str(tmp_path / "d"), str(tmp_path / "a"), customers, "2024-01-01", state_path=str(tmp_path / "s"))
    for batch_id, part in enumerate([[], days[:1], [], days[1:2], days[2:], []]):
        run(spark.createDataFrame(part, schema), batch_id)
    got = alerts.latest_alerts(spark, str(tmp_path / "a")).select("customer_id", "week_start", "logins").collect()
    assert [(r[0], str(r[1]), r[2]) for r in got] == [(1, "2024-01-15", 2)]
