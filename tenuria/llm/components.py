"""Connected components by smallest label with pointer jumping, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria.session import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, label (smallest vertex of the component) for all vertices of the edges.

    A round takes the smallest label among a vertex's neighbours and then the label of that label, so chains shrink
    geometrically. Each round is written to the shared folder; only the number of changed labels comes to the driver.
    """
    both = stored(edges.select(F.col(a).alias("vertex"), F.col(b).alias("near")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = stored(both.groupBy("vertex").agg(F.least("vertex", F.min("near")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("vertex").alias("near"), "label"), "near").groupBy("vertex").agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "vertex").select("vertex", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        after = stored(lower.join(jump, "label").select("vertex", "old", F.least("label", "further").alias("label")))
        labels = after.select("vertex", "label")
        if after.where("old <> label").isEmpty():
            return labels
