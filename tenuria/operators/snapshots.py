"""Point-in-time aggregation for one or many prediction dates in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C


def as_dates(dates) -> list[dt.date]:
    """One date, ISO string, or a sequence of them -> sorted distinct dates."""
    if isinstance(dates, (str, dt.date)):
        dates = [dates]
    out = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in dates})
    if not out:
        raise ValueError("a prediction date is needed")
    return out


def date_grid(start, end, step_days: int) -> list[dt.date]:
    """Prediction dates from start to end inclusive."""
    (start,), (end,) = as_dates(start), as_dates(end)
    return [start + dt.timedelta(days=i) for i in range(0, (end - start).days + 1, step_days)]


def dates_array(dates: Sequence[dt.date]) -> Column:
    return F.expr("array(" + ", ".join(f"DATE '{d}'" for d in dates) + ")")


class Grid:
    """Positions of prediction dates at one distance from each other, by arithmetic on days: (first, last) and a sequence between them."""

    def __init__(self, dates: Sequence[dt.date]):
        self.start, self.step, self.last = dates[0], (dates[1] - dates[0]).days, len(dates) - 1

    @classmethod
    def of(cls, dates: Sequence[dt.date]) -> Grid | None:
        return cls(dates) if len({(b - a).days for a, b in zip(dates, dates[1:], strict=False)}) == 1 else None

    def _at(self, day: Column) -> Column:
        return F.floor(F.datediff(day, C.day(self.start)) / F.lit(float(self.step))).cast("int")

    def after(self, day: Column) -> Column:
        """Position of the first date after the day."""
        return F.greatest(F.lit(0), self._at(day) + 1)

    def until(self, day: Column) -> Column:
        """Position of the last date on or before the day; -1 if there is none."""
        return F.greatest(F.lit(-1), F.least(F.lit(self.last), self._at(day)))

    def dates(self, first: Column, last: Column) -> Column:
        """The dates of the positions from first to last; none where last is before first."""
        day = lambda i: F.date_add(C.day(self.start), (i * self.step).cast("int"))
        return F.when(first <= last, F.sequence(day(first), day(last), F.expr(f"INTERVAL '{self.step}' DAY")))


def expand_base(customers: DataFrame, dates) -> DataFrame:
    """customers x prediction dates on or after signup."""
    dates = as_dates(dates)
    if len(dates) == 1:
        p = C.day(dates[0])
        return customers.where(F.col("signup_date") <= p).withColumn("prediction_date", p)
    grid = Grid.of(dates)
    if grid:
        known = grid.dates(grid.after(F.date_sub("signup_date", 1)), F.lit(grid.last))
    else:
        known = F.filter(dates_array(dates), lambda p: p >= F.col("signup_date"))
    return customers.where(F.col("signup_date") <= C.day(dates[-1])).withColumn(
        "prediction_date", F.explode(known)
    )


def snapshot_aggregate(
    rows: DataFrame,
    key: str,
    date_col: str,
    dates,
    span_days: int,
    window_sums: Mapping[str, object],
    lifetime_sums: Mapping[str, Column] | None = None,
    lifetime_maxes: Mapping[str, Column] | None = None,
    window_mins: Mapping[str, object] | None = None,
) -> DataFrame:
    """(key, prediction_date) aggregates over rows dated before each prediction date.

    `window_sums` maps a name to a function of the row's age in days (1 = the day before) giving
    the value to add (`window_mins`: to take the minimum of); it must be 0 or NULL beyond `span_days`. Lifetime aggregates cover all earlier rows.

    With several dates a row joins only the snapshots whose window it falls in, plus its first one;
    lifetime values are then carried forward by a running window over at most len(dates) rows per
    key. The work is rows x overlapping windows, not rows x dates: on an even grid the snapshots of a row are found by arithmetic.
    Rows are shuffled once by key, before they are placed, so that neither their copies nor the carried values are.
    """
    dates = as_dates(dates)
    sums, maxes, mins = dict(lifetime_sums or {}), dict(lifetime_maxes or {}), dict(window_mins or {})
    if len(dates) == 1:
        p = C.day(dates[0])
        age = F.datediff(p, F.col(date_col))
        return (
            rows.where(F.col(date_col) < p)
            .groupBy(key)
            .agg(
                *[F.sum(f(age)).alias(n) for n, f in window_sums.items()],
                *[F.min(f(age)).alias(n) for n, f in mins.items()],
                *[F.sum(c).alias(n) for n, c in sums.items()],
                *[F.max(c).alias(n) for n, c in maxes.items()],
            )
            .withColumn("prediction_date", p)
        )

    rows = rows.repartition(key)
    d = F.col(date_col)
    grid, reach = Grid.of(dates), F.date_add(d, span_days)
    if grid:
        first = grid.after(d)
        later = grid.dates(first, F.greatest(first, grid.until(reach)))
        placed = rows.where(d < C.day(dates[-1])).withColumn("_later", later).withColumn("_first", F.element_at("_later", 1))
        placed = placed.withColumn("prediction_date", F.explode("_later"))
    else:
        later = F.filter(dates_array(dates), lambda p: p > d)
        within = F.filter(F.col("_later"), lambda p: p <= reach)
        placed = rows.where(d < C.day(dates[-1])).withColumn("_later", later).withColumn("_first", F.element_at("_later", 1))
        placed = placed.withColumn("prediction_date", F.explode(F.when(F.col("_first") <= reach, within).otherwise(F.array("_first"))))
    age = F.datediff("prediction_date", d)
    opens = F.col("prediction_date") == F.col("_first")
    partial = placed.groupBy(key, "prediction_date").agg(
        *[F.sum(f(age)).alias(n) for n, f in window_sums.items()],
        *[F.min(f(age)).alias(n) for n, f in mins.items()],
        *[F.sum(F.when(opens, c)).alias(n) for n, c in sums.items()],
        *[F.max(F.when(opens, c)).alias(n) for n, c in maxes.items()],
    )
    w = Window.partitionBy(key).orderBy("prediction_date")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = partial.select(
        key,
        "prediction_date",
        F.lead("prediction_date").over(w).alias("_next"),
        *window_sums,
        *mins,
        *[F.sum(n).over(running).alias(n) for n in sums],
        *[F.max(n).over(running).alias(n) for n in maxes],
    )
    # A snapshot without a row of its own has nothing in its windows.
    if grid:
        stop = F.coalesce(grid.until(F.date_sub("_next", 1)), F.lit(grid.last))
        holds = grid.dates(grid.until(F.col("_own")), stop)
    else:
        holds = F.filter(
            dates_array(dates),
            lambda p: (p >= F.col("_own")) & (F.col("_next").isNull() | (p < F.col("_next"))),
        )
    filled = carried.withColumnRenamed("prediction_date", "_own").withColumn("prediction_date", F.explode(holds))
    own = F.col("prediction_date") == F.col("_own")
    return filled.select(
        key,
        *[F.when(own, F.col(n)).alias(n) for n in (*window_sums, *mins)],
        *sums,
        *maxes,
        "prediction_date",
    )


def window_agg(rows: DataFrame, key: str | None, date_col: str, value: str, prediction_date, days: int, how: str) -> DataFrame:
    """One point-in-time aggregate of `value` over [P - days, P): the generic form."""
    p = C.day(prediction_date)
    v = F.col(value)
    functions = {
        "sum": lambda: F.sum(v),
        "mean": lambda: F.avg(v),
        "count": lambda: F.count("*"),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "std": lambda: F.stddev_samp(v),
        "last": lambda: F.max_by(v, F.col(date_col)),
    }
    if how not in functions:
        raise ValueError(f"unknown aggregation {how!r}, expected one of {sorted(functions)}")
    inside = rows.where((F.col(date_col) < p) & (F.col(date_col) >= F.date_sub(p, days)))
    name = f"{value}_{how}_{days}d"
    return inside.groupBy(*([key] if key else [])).agg(functions[how]().alias(name))
