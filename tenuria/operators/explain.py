"""Per-feature contributions to a score, and what they say per customer, cohort and overall.

A customer's contributions travel as one array, so everything per customer (top drivers,
waterfall, plans) is array work on its own row, with no shuffle. `exploded` gives the long form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators.ranking import match

ELEMENT = "struct<feature:string,feature_value:double,contribution:double>"


def _value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], keep: Sequence[str], decimals: int | None = None) -> DataFrame:
    """coefficient * (value - mean) per feature, exact for a linear model.

    The means are one broadcast row. Adds base_value (mean margin without intercept) and contributions.
    """
    means = df.agg(F.struct(*[F.avg(_value(f)).alias(f) for f in coefficients]).alias("_mean"))
    rows = match(df.select(*keep, *[f for f in coefficients if f not in keep]), F.broadcast(means), [])

    def element(f: str, c: float) -> Column:
        part = F.lit(float(c)) * (_value(f) - F.col("_mean")[f])
        return F.struct(
            F.lit(f).alias("feature"),
            _value(f).alias("feature_value"),
            (F.round(part, decimals) if decimals is not None else part).alias("contribution"),
        )

    base = F.lit(0.0)
    for f, c in coefficients.items():
        base = base + F.lit(float(c)) * F.col("_mean")[f]
    return rows.select(
        *keep,
        (F.round(base, decimals) if decimals is not None else base).alias("base_value"),
        F.array(*[element(f, c) for f, c in coefficients.items()]).alias("contributions"),
    )


def exploded(explained: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form: (keep, feature, feature_value, contribution)."""
    return explained.select(*keep, F.inline("contributions"))


def elements(df: DataFrame, array: str, keep: Sequence[str], name: str) -> DataFrame:
    """(keep, _i, name): the elements of a computed array with their places from 0.

    An outer generator, with the rows of empty arrays filtered out behind it. For an inner one Spark infers a filter on the array's
    size and moves it down to the scan or join, where all steps that make the array are put into one expression: each lambda
    variable of a step then costs the steps before it again, for every element.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("_i", name)).where(F.col("_i").isNotNull())


def sample(rows: DataFrame, n: int, key: str = "customer_id", seed: int = 42) -> DataFrame:
    """At most n rows, the same ones on every run and partitioning."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.orderBy(order, key).limit(n)


def by_size(contributions="contributions") -> Column:
    """Elements by falling absolute contribution, feature name breaking ties."""
    keyed = F.transform(
        contributions,
        lambda c: F.struct((-F.abs(c["contribution"])).alias("k"), c["feature"].alias("f"), c.alias("c")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def top(n: int) -> Column:
    return F.slice(by_size(), 1, n)


def direction(contribution) -> Column:
    return F.when(C.col(contribution) > 0, "increases risk").otherwise("decreases risk")


def global_importance(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature with its rank, overall or per segment."""
    agg = long.groupBy(*by, "feature").agg(
        F.avg(F.abs("contribution")).alias("importance"), F.count("*").alias("n_samples")
    )
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return agg.withColumn("rank", F.row_number().over(order))


def top_drivers(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.where(F.col("rank") <= n)


def local_explanation(explained: DataFrame, keep: Sequence[str], n: int = 5) -> DataFrame:
    """The n largest contributions of every customer with rank and direction."""
    return elements(explained.select(*keep, top(n).alias("_top")), "_top", keep, "c").select(
        *keep,
        (F.col("_i") + 1).alias("rank"),
        "c.feature",
        "c.feature_value",
        "c.contribution",
        direction("c.contribution").alias("direction"),
    )


def waterfall(explained: DataFrame, keep: Sequence[str], n: int = 5) -> DataFrame:
    """Base value, top contributors with the running total, and the residual to the margin (one unit throughout)."""
    zero = F.lit(0.0)
    add = lambda acc, c: acc + c["contribution"]
    rows = explained.select(*keep, "base_value", top(n).alias("_top"), F.aggregate("contributions", zero, add).alias("_all"))
    base = F.col("base_value")

    def step(i, name, value, total):
        return F.struct(i.cast("int").alias("step"), name.alias("name"), value.alias("value"), total.alias("running_total"))

    steps = F.transform(
        "_top",
        lambda c, i: step(
            i + 1, c["feature"], c["contribution"], base + F.aggregate(F.slice("_top", F.lit(1), i + 1), zero, add)
        ),
    )
    shown = F.aggregate("_top", zero, add)
    last = step(F.size("_top") + 1, F.lit("Final Prediction"), F.col("_all") - shown, base + F.col("_all"))
    first = step(F.lit(0), F.lit("Base Value"), base, base)
    found = rows.select(*keep, F.concat(F.array(first), steps, F.array(last)).alias("_steps"))
    return elements(found, "_steps", keep, "s").select(*keep, "s.*")


def beeswarm(long: DataFrame, importance: DataFrame, n: int = 10) -> DataFrame:
    """Contributions of the top n features with the feature value scaled to [0, 1].

    The per-feature ranges are one row per feature of the model, which bounds the broadcast.
    """
    ranges = long.groupBy("feature").agg(F.min("feature_value").alias("_lo"), F.max("feature_value").alias("_hi"))
    shown = ranges.join(top_drivers(importance, n).select("feature", "rank"), "feature")
    scaled = (F.col("feature_value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    return long.join(F.broadcast(shown), "feature").withColumn("feature_value_norm", scaled).drop("_lo", "_hi")
