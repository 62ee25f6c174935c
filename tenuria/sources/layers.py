"""Bronze / silver / gold tables: creation, full refresh, snapshot replacement, files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenuria import schemas
from tenuria.functions import columns as C
from tenuria.operators.silver import align_columns

LAYERS = ("bronze", "silver", "gold")

# Raw CSV seed: CamelCase headers become snake_case, except these two.
CSV_NAMES = {"Contract": "contract_type", "Churn": "churn_label"}
CSV_BOOLEANS = ("senior_citizen", "partner", "dependents", "phone_service", "paperless_billing", "churn_label")


def create_layers(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the three databases and seven tables if absent; returns the table names. A prefix names layers of their own."""
    for layer in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}")
    for name, (ddl, partitions) in schemas.TABLES.items():
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({ddl}) USING parquet{by}")
    return [prefix + name for name in schemas.TABLES]


def drop_layers(spark: SparkSession, prefix: str) -> None:
    """Drop the layers of a prefix with their tables and files."""
    if not prefix:
        raise ValueError("only layers with a prefix are dropped")
    for layer in LAYERS:
        spark.sql(f"DROP DATABASE IF EXISTS {prefix}{layer} CASCADE")


def load(df: DataFrame, table: str) -> int:
    """Full refresh of `table` by column name; returns the stored row count."""
    spark = df.sparkSession
    schema = spark.table(table).schema
    align_columns(df, schema).write.mode("overwrite").insertInto(table, overwrite=True)
    return spark.table(table).count()


def replace_snapshots(df: DataFrame, table: str = "gold.customer_360") -> None:
    """Replace exactly the prediction dates present in `df`; a rerun changes nothing.

    Written to the table's own files with the writer's option (an insert by name knows only the session's setting), then new dates are
    made known to the catalog.
    """
    spark = df.sparkSession
    aligned = align_columns(df, spark.table(table).schema)
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    replace_snapshots_at(aligned, place)
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def filter_customer_360(gold: DataFrame, prediction_date=None, cohort: str | None = None) -> DataFrame:
    """Optional filters; the date one prunes partitions of the stored table."""
    if prediction_date is not None:
        gold = gold.where(F.col("prediction_date") == C.day(prediction_date))
    if cohort is not None:
        gold = gold.where(F.col("cohort") == cohort)
    return gold


def read_customer_360(spark: SparkSession, prediction_date=None, cohort: str | None = None) -> DataFrame:
    return filter_customer_360(spark.table("gold.customer_360"), prediction_date, cohort)


def count_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n) for every table in one job."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def table_counts(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(name, n) of all tables in the three layers."""
    names = [f"{l}.{t.name}" for l in LAYERS for t in spark.catalog.listTables(prefix + l) if not t.isTemporary]
    return count_rows({n: spark.table(prefix + n) for n in names})


def bucketed(df: DataFrame, table: str, buckets: int, key: str = "customer_id") -> None:
    """Store a silver table bucketed by customer, so feature jobs need no exchange on it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def replace_snapshots_at(df: DataFrame, path: str, partition: str = "prediction_date") -> None:
    """The same for files: replaces the partitions present in `df` under `path` and leaves the others."""
    df.write.partitionBy(partition).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


# -- files ---------------------------------------------------------------------


BAD = "_bad_record"


def read_csv_seed(spark: SparkSession, path: str, bad: str = "keep") -> DataFrame:
    """Raw CSV seed with renamed columns; yes/no text becomes boolean, unknown text NULL.

    Columns are found by header name; everything is read as text, so no inference pass. Lines with too few or too many fields: "keep"
    fills what is there, "drop" leaves them out, "fail" raises, "only" returns nothing but them, as one column of raw lines.
    """
    if bad not in ("keep", "drop", "fail", "only"):
        raise ValueError(f"unknown treatment of bad records {bad!r}")
    columns = spark.read.option("header", True).csv(path).schema
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if bad == "fail" else "PERMISSIVE")
    # Without column pruning a line is checked against all fields, whatever a query reads of it.
    reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", BAD)
    raw = reader.schema(columns if bad == "fail" else T.StructType([*columns, T.StructField(BAD, T.StringType())])).csv(path)
    # Spark refuses to read that column alone, so the filters look at another one as well.
    also = F.coalesce(F.col(f"`{columns.names[0]}`") != F.lit("\0"), F.lit(True))
    if bad == "only":
        return raw.where(F.col(BAD).isNotNull() & also).select(BAD)
    if bad == "drop":
        raw = raw.where(F.col(BAD).isNull() & also)
    out = []
    for name in columns.names:
        new = CSV_NAMES.get(name) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()
        c = F.col(f"`{name}`")
        if new in CSV_BOOLEANS:
            c = F.coalesce(C.yes_no(c), C.mapped(c, {"1": True, "0": False}))
        elif new in ("monthly_charges", "total_charges"):
            c = c.try_cast("decimal(10,2)")
        out.append(c.alias(new))
    return raw.select(*out)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a result as parquet, csv (with header) or json."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
