"""The input tables the registered queries run on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.functions import columns as C
from tenuria.operators import features, silver
from tenuria.operators.snapshots import as_dates, date_grid, expand_base
from tenuria.session import stored
from tenuria.sources import accounts, activity

A_DATE = "1998-06-01"
A_WINDOWS, A_PERIOD, A_HORIZON = (30, 90, 180), 30, 90
A_SNAPSHOTS = date_grid("1997-01-01", "2000-01-01", 30)
B_DATE = activity.PREDICTION_DATE


@dataclass(frozen=True)
class Tables:
    """Bronze-shaped inputs of one adapter with their silver and gold forms."""

    source: object
    spark: SparkSession
    directory: str

    @property
    def customers(self) -> DataFrame:
        return self.source.customers(self.spark, self.directory)

    @property
    def engagement(self) -> DataFrame:
        return self.source.engagement(self.spark, self.directory)

    @property
    def tickets(self) -> DataFrame:
        return self.source.tickets(self.spark, self.directory)

    @property
    def silver_customers(self) -> DataFrame:
        return silver.silver_customers(self.customers, self.source.END)

    @property
    def silver_tickets(self) -> DataFrame:
        return silver.silver_tickets(self.tickets)

    def gold(self, dates, **options) -> DataFrame:
        """The 360 over stored silver tables: raw tables are read once per silver table, not once per feature group."""
        if self.source is activity:
            days = stored(activity.user_days(self.spark, self.directory))
            customers = activity.customers(self.spark, self.directory, days)
            daily = activity.engagement(self.spark, self.directory, days)
            tickets = self.tickets
        else:
            days = stored(accounts.account_days(self.spark, self.directory))
            customers, tickets = (table(self.spark, self.directory, days) for table in (accounts.customers, accounts.tickets))
            daily = stored(accounts.engagement(self.spark, self.directory, days))
        return features.customer_360(
            silver.silver_customers(customers, self.source.END), daily, silver.silver_tickets(tickets), dates, **options
        )


def account_tables(spark: SparkSession, directory: str) -> Tables:
    return Tables(accounts, spark, directory)


def activity_tables(spark: SparkSession, directory: str) -> Tables:
    return Tables(activity, spark, directory)


def account_gold(spark: SparkSession, directory: str, dates=A_DATE) -> DataFrame:
    """Model rows: leak-free tenure, customers active at P."""
    return account_tables(spark, directory).gold(
        dates, windows=A_WINDOWS, period=A_PERIOD, horizon=A_HORIZON, point_in_time=True, active_only=True
    )


def activity_gold(spark: SparkSession, directory: str) -> DataFrame:
    return activity_tables(spark, directory).gold(B_DATE)


def scored(spark: SparkSession, directory: str, dates=A_DATE) -> DataFrame:
    """Labelled account rows with a deterministic score that has ties."""
    many = len(as_dates(dates)) > 1
    rows = expand_base(account_tables(spark, directory).silver_customers, dates)
    rows = rows.where(F.col("churn_date").isNull() | (F.col("churn_date") > F.col("prediction_date")))
    seed = F.col("customer_id") * 7919
    if many:
        seed = seed + F.datediff("prediction_date", C.day("1997-01-01")) * 31
    return rows.select(
        "customer_id",
        "prediction_date",
        C.cohort_of(F.datediff("prediction_date", "signup_date")).alias("cohort"),
        "ltv_tier",
        "contract_type",
        "estimated_ltv",
        "churn_date",
        C.churned_within("churn_date", F.col("prediction_date"), A_HORIZON).cast("int").alias("label"),
        ((seed % 1000).cast("double") / 1000.0).alias("score"),
    )
