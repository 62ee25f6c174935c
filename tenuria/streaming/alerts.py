"""Velocity alerts recomputed as micro-batches of closed days arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators.playbooks import falling_weeks, weekly_logins

HISTORY_DAYS = 20  # a week open on the last day starts less than 6 days before it, and looks back two weeks


def velocity_batches(daily_path: str, alerts_path: str, customers: DataFrame, anchor, drop: float = 0.2,
                     state_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over closed daily rows (customer_id, activity_date, login_count).

    Each batch adds its days to the weekly sums that the batch before it left, evaluates the weeks that it completed
    (customers that fell silent included), and leaves the sums of the last three weeks and the last day under its own id. So
    a batch reads its own days and three sums per customer, however long the stream has run. Days, sums and alerts
    go under the batch's id, and a repeated batch overwrites its own. Batch ids are consecutive from 0, as the
    stream gives them; a missing predecessor is an error. Only two dates reach the driver.
    """
    state_path = state_path or f"{alerts_path.rstrip('/')}-sums"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{daily_path}/batch_id={batch_id}")
        days = spark.read.schema(batch.schema).parquet(f"{daily_path}/batch_id={batch_id}")
        weeks = weekly_logins(days, anchor)
        before = None
        if batch_id > 0:
            left = f"{state_path}/{{}}/batch_id={batch_id - 1}"
            before = spark.read.schema("last DATE").parquet(left.format("last")).first()["last"]
            earlier = spark.read.schema(weeks.schema).parquet(left.format("weeks"))
            weeks = earlier.unionByName(weeks).groupBy("customer_id", "week_start").agg(F.sum("logins").alias("logins"))
        newest = days.agg(F.max("activity_date")).first()[0]
        last = max((d for d in (before, newest) if d is not None), default=None)
        day = C.day(last) if last is not None else F.lit(None).cast("date")
        kept = weeks if last is None else weeks.where(F.col("week_start") > F.date_sub(day, HISTORY_DAYS))
        kept.write.mode("overwrite").parquet(f"{state_path}/weeks/batch_id={batch_id}")
        spark.range(1).select(day.alias("last")).write.mode("overwrite").parquet(f"{state_path}/last/batch_id={batch_id}")
        if last is None:
            return
        # Weeks that ended by the day after `before` were evaluated by an earlier batch.
        fresh = F.lit(True) if before is None else F.date_add("week_start", 7) > F.date_add(C.day(before), 1)
        found = falling_weeks(weeks, customers, F.date_add(day, 1), drop).where(fresh)
        found.write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    return run


def latest_alerts(spark, alerts_path: str) -> DataFrame:
    """Alerts across batches; every week is evaluated by one batch."""
    return spark.read.parquet(alerts_path).drop("batch_id")
