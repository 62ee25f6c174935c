"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for; adaptive execution and its skew joins are on by default.
RUNTIME_CONF = {
    # Split a hot join key even when that costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Parts that lie by customer join on (customer, date) as they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
TUNED = "tenuria.tuned"


def tune(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF once to a session; what was set at its start or is set afterwards stays."""
    if spark.conf.get(TUNED, None) is None:
        explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
        for key, value in RUNTIME_CONF.items():
            if key not in explicit:
                spark.conf.set(key, value)
        spark.conf.set(TUNED, "true")
    return spark


def local_session(name: str = "tenuria", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small test data: keep all cores busy instead of folding everything into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        # Recording the Python call site of every column costs more than analysing a wide plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where none is set, a local session gets a
    temporary one of its own; a cluster has to name it, as its machines do not share such folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and is_local(spark):
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors the package's code, once per application, as --py-files would: tasks import it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId not in _SHIPPED and package.is_dir():
        path = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints of frames and RDDs go to the shared folder."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that an iterative job reads many times.

    Uses a reliable checkpoint, so a lost executor costs a re-read, not a recomputation.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a frame that several branches of a plan read to the shared folder, and read it back.

    Parquet, so each branch still prunes columns and pushes its filters down; nothing upstream is computed
    twice, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
