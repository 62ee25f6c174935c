"""Exact ranks and running totals without a one-task global window.

Rows are first reduced to one cell per distinct value, then cut into ordered slots. A window runs
inside each slot, and the slot totals (one row per slot) carry the offset. Slot order follows value
order, so the result is exact whatever the slots; their edges only decide the balance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.session import settle

N_SLOTS = 1024
TIE_DIGITS = 3  # hex digits of the tie hash used as a bucket: 4096 of them


@dataclass(frozen=True)
class EqualWidth:
    """Slots of equal width: no pass over the data. For values known to spread over [low, high]."""

    low: float
    high: float
    n: int = N_SLOTS

    def add(self, df: DataFrame, value: str) -> DataFrame:
        v = F.col(value).cast("double")
        step = (self.high - self.low) / self.n
        slot = F.floor((v - self.low) / step)
        return df.withColumn("_slot", F.greatest(F.lit(0), F.least(F.lit(self.n - 1), slot)).cast("int"))


@dataclass(frozen=True)
class Quantiles:
    """Slots with about equally many rows, edges taken from the data (one extra pass).

    At most `n` doubles reach the driver. They enter the plan as constants, so every use of the slots
    agrees, also after a lost executor.
    """

    edges: tuple[float, ...]

    @classmethod
    def of(cls, df: DataFrame, value: str, n: int = N_SLOTS) -> Quantiles:
        probs = [i / n for i in range(1, n)]
        v = F.col(value).cast("double")
        found = df.agg(F.percentile_approx(v, probs, 10 * n).alias("q")).first()["q"] or []
        return cls(tuple(sorted(set(found))))

    def add(self, df: DataFrame, value: str) -> DataFrame:
        splits = [float("-inf"), *self.edges, float("inf")]
        if len(splits) < 3:
            return df.withColumn("_slot", F.lit(0))
        named = df.withColumn("_value", F.col(value).cast("double"))
        bucketed = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket").transform(named)
        return bucketed.withColumn("_slot", F.col("_bucket").cast("int")).drop("_value", "_bucket")


Slots = EqualWidth | Quantiles


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `on` treating NULL keys as equal; the right keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    joined = left.join(renamed, cond, how) if on else left.join(renamed, F.lit(True), how)
    return joined.drop(*[f"_r_{c}" for c in on])


def running_totals(
    cells: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Sequence[str],
    slots: Slots | None = None,
    descending: bool = True,
) -> DataFrame:
    """Add cum_<m> (inclusive, in value order) and total_<m> per segment for each measure.

    `cells` has one row per (by, value). Without given slots the cells are settled first, since finding
    the slot edges is a pass of its own.
    """
    if slots is None:
        cells = settle(cells)
        slots = Quantiles.of(cells, value)
    placed = slots.add(cells, value)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*by, "_slot").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    per_slot = placed.groupBy(*by, "_slot").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy(order("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_slot.select(
        *by,
        "_slot",
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    local = placed.withColumns({f"_c_{m}": F.sum(m).over(inside) for m in measures})
    joined = match(local, offsets, [*by, "_slot"])
    return joined.select(
        *cells.columns,
        *[(F.col(f"_c_{m}") + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


Key = str | Sequence[str]


def check_segments(by: Sequence[str], key: Key) -> None:
    """One row per segment is broadcast, so what identifies a row, or its first part, cannot be a segment."""
    first = key if isinstance(key, str) else key[0]
    if first in by:
        raise ValueError(f"{first} identifies rows and cannot be a segment")


def first_k(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    key: Key,
    k: Column,
    slots: Slots | None = None,
    descending: bool = True,
) -> DataFrame:
    """The cut after the first k rows by (value, hash of key): one row per segment.

    `key` is the whole key of a row, such as (customer_id, prediction_date): rows that share it share a place.

    `k` may use total_n, the size of the segment. Columns: by, value, `_need` (rows to take among
    those with exactly that value), `_hash` (the last tie hash taken) and `_before` (rows ahead of the value).
    Only the rows of the crossing value are looked at, and among them only one hash bucket is sorted.
    """
    check_segments(by, key)
    cells = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(cells, by, value, ["n"], slots, descending).withColumn("_k", k.cast("long"))
    crossing = (
        ranked.where((F.col("cum_n") - F.col("n") < F.col("_k")) & (F.col("cum_n") >= F.col("_k")))
        .select(*by, value, (F.col("_k") - F.col("cum_n") + F.col("n")).alias("_need"),
                (F.col("cum_n") - F.col("n")).alias("_before"))
    )
    return match(crossing, tie_cut(rows, crossing, by, value, key), [*by, value])


def tie_cut(rows: DataFrame, crossing: DataFrame, by: Sequence[str], value: str, key: Key) -> DataFrame:
    """(by, value, _hash): the `_need`-th smallest tie hash among the rows of each crossing value.

    `crossing` has one row per segment. Segments are closed domains (cohort, tier, contract, date),
    which is what bounds the broadcast.
    """
    tied = match(rows.select(*by, value, C.tie_order(key).alias("_hash")), F.broadcast(crossing), [*by, value])
    tied = tied.withColumn("_bucket", F.substring("_hash", 1, TIE_DIGITS))
    group = [*by, value]
    counts = tied.groupBy(*group, "_bucket", "_need").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        counts.withColumn("_cum", F.sum("_n").over(w))
        .where((F.col("_cum") - F.col("_n") < F.col("_need")) & (F.col("_cum") >= F.col("_need")))
        .select(*group, "_bucket", (F.col("_need") - F.col("_cum") + F.col("_n")).alias("_rest"))
    )
    inside = match(tied.select(*group, "_bucket", "_hash"), F.broadcast(hit), [*group, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_hash"))
    return inside.withColumn("_rank", rank).where("_rank = _rest").select(*group, "_hash")


def taken(value: str, key: Key, descending: bool = True) -> Column:
    """Whether a row matched with its cut (`_cut_value`, `_cut_hash`) is among the first k."""
    v, cut = F.col(value), F.col("_cut_value")
    ahead = v > cut if descending else v < cut
    return ahead | ((v == cut) & (C.tie_order(key) <= F.col("_cut_hash")))


def mark_first_k(
    rows: DataFrame, by: Sequence[str], value: str, key: Key, k: Column, slots: Slots | None = None,
    descending: bool = True, name: str = "taken",
) -> DataFrame:
    """Add a boolean: row is among the first k of its segment by (value, hash of key)."""
    cut = first_k(rows, by, value, key, k, slots, descending).select(
        *by, F.col(value).alias("_cut_value"), F.col("_hash").alias("_cut_hash")
    )
    joined = match(rows, F.broadcast(cut), by, "left")
    marked = joined.withColumn(name, F.coalesce(taken(value, key, descending), F.lit(False)))
    return marked.drop("_cut_value", "_cut_hash")


def exact_quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], slots: Slots | None = None
) -> DataFrame:
    """(by, prob, quantile) with linear interpolation.

    The slots' totals (one row per segment and slot) tell which slots hold a wanted position; only the distinct
    values of those slots are ordered.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    if slots is None:
        cells = settle(cells)
        slots = Quantiles.of(cells, value)
    placed = slots.add(cells, value)
    before = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_slot").agg(F.sum("n").alias("_s")).select(
        *by, "_slot", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"), F.sum("_s").over(Window.partitionBy(*by)).alias("_total")
    )
    # Row position (0-based) of the quantile, and those at its floor and ceiling.
    points = F.array(*[F.lit(float(p)) for p in probs])
    low, high = F.floor("_h"), F.ceil("_h")

    def holds(first, size):
        return low.between(first, first + size - 1) | high.between(first, first + size - 1)

    at = totals.withColumn("prob", F.explode(points)).withColumn("_h", (F.col("_total") - 1) * F.col("prob"))
    wanted = at.where(holds(F.col("_o"), F.col("_s")))
    # One row per open slot, so a cell meets its slot once and goes only to the quantiles that fall on it.
    open_slots = wanted.groupBy(*by, "_slot").agg(F.first("_o").alias("_o"), F.collect_set(F.struct("prob", "_h")).alias("_at"))
    inside = Window.partitionBy(*by, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_o") + F.col("_c") - F.col("n")
    opened = match(placed, open_slots, [*by, "_slot"]).withColumn("_c", F.sum("n").over(inside))
    cut = opened.withColumn("_at", F.explode("_at")).select(
        *by, F.col(value).cast("double").alias("_v"), "n", first.alias("_first"), "_at.prob", "_at._h"
    ).where(holds(F.col("_first"), F.col("n")))

    def end(position):
        return F.max(F.when(position.between(F.col("_first"), F.col("_first") + F.col("n") - 1), F.col("_v")))

    ends = cut.groupBy(*by, "prob", "_h").agg(end(low).alias("_low"), end(high).alias("_high"))
    frac = F.col("_h") - F.floor("_h")
    return ends.select(*by, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * frac).alias("quantile"))
