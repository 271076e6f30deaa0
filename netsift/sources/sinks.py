"""Sinks: versioned artifacts, daily JSON, fixed-column CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def round_trip_csv(df: DataFrame, path: str) -> DataFrame:
    """Writes CSV and returns what a reader with the same schema sees."""
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def write_daily_summary(summary: DataFrame, path: str) -> None:
    """One JSON folder per date; only the dates in the frame are replaced."""
    (
        summary.withColumn("date", F.col("day").cast("string"))
        .repartition("date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .json(path)
    )


def write_cycle(df: DataFrame, path: str, cycle_id: str) -> None:
    """One version of an artifact; earlier cycles stay."""
    (
        df.withColumn("cycle_id", F.lit(cycle_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cycle_id")
        .parquet(path)
    )


def latest_cycle(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; its partition is the only one read."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max(F.col("cycle_id").cast("string"))).first()[0]
    return versions.filter(F.col("cycle_id").cast("string") == newest)


def settle(df: DataFrame, path: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_draft(draft, path: str):
    """A curated draft as stored tables, so that readers do not rebuild it."""
    from netsift.operators.curation import Draft

    return Draft(*(settle(getattr(draft, n), f"{path}/{n}") for n in ("items", "targets", "hints", "groups", "benign")))


def settle_watchlist(watchlist, path: str):
    """The four tables of a watchlist version, stored: what a curation cycle hands to triage."""
    from netsift.operators.watchlist import Watchlist

    return Watchlist(*(settle(getattr(watchlist, n), f"{path}/{n}") for n in ("items", "targets", "hints", "groups")))
