"""Streaming ingest: the batch operators behind foreachBatch, over log-structured tables.

Every micro-batch writes its own ``batch_id`` partitions and overwrites them
when replayed, so a restarted batch leaves no duplicates. Keyed tables are
logs too: readers keep the last version per key. Recent activity reads the
stored flows of the trailing window, exactly as the batch form does, so hot
sources stay split into panes instead of sitting in one keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netsift.operators import activity, tables

HOUR_MS = 3_600_000


def read_flow_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of flow files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_json_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON payload lines, normalised like the batch reader does."""
    from netsift.sources.flows import normalize_json

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return normalize_json(lines.withColumnRenamed("value", "payload"))


def read_kafka(spark: SparkSession, **options: str) -> DataFrame:
    """The same payloads from Kafka; needs the connector on the cluster's class path."""
    from netsift.sources.flows import normalize_json

    lines = spark.readStream.format("kafka").options(**options).load()
    return normalize_json(lines.select(F.col("value").cast("string").alias("payload")))


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drains what is there, batch by batch, and stops."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def write_batch(df: DataFrame, batch_id: int, path: str, *partitions: str) -> None:
    """One micro-batch into its own partitions; a replay replaces them."""
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *partitions)
        .parquet(path)
    )


def current(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version per key of a log table."""
    return tables.keep_last(log, key, ["batch_id", *order]).drop("batch_id")


def _log(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame:
    """Stored flows up to a batch, with their batch_id and hour."""
    stored_schema = StructType(schema.fields).add("batch_id", "integer").add("hour", "long")
    return spark.read.schema(stored_schema).parquet(path).filter(F.col("batch_id") <= batch_id)


def _stored(spark: SparkSession, path: str, schema: StructType, since_ms: int, batch_id: int) -> DataFrame:
    """Timed flows inside the lookback; only their hour folders are read."""
    return _log(spark, path, schema, batch_id).filter((F.col("hour") >= since_ms // HOUR_MS) & (F.col("start_ms") >= since_ms))


def _last_versions(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose flow was not sent again in a later batch; of the log only ids and batches are read."""
    last = log.groupBy("flow_id").agg(F.max("batch_id").alias("last_batch"))
    kept = rows.join(last, "flow_id", "left").filter(F.coalesce(F.col("batch_id") == F.col("last_batch"), F.lit(True)))
    return kept.drop("last_batch", "batch_id", "hour")


def _once(batch: DataFrame, batch_id: int) -> DataFrame:
    """One row per flow id, the one with the latest time. Each row without id stays, under an id of its own."""
    named = batch.filter(F.col("flow_id").isNotNull())
    nameless = batch.filter(F.col("flow_id").isNull()).withColumn(
        "flow_id", F.format_string(f"no-id-{batch_id}-%d", F.monotonically_increasing_id()).cast(batch.schema["flow_id"].dataType)
    )
    return tables.keep_last(named, "flow_id", ["start_ms"]).select(*batch.columns).unionByName(nameless)


def activity_batches(
    flows_path: str,
    window_minutes: int,
    then: Callable[[DataFrame, int], None],
    *,
    lateness_minutes: int | None = None,
    late_path: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler: stores the flows, adds their recent activity, hands them on.

    A late flow still counts for flows that arrive after it, and never changes
    results written before. A flow without a time sees every stored row of its source. A flow that is sent again is
    handed on again and replaces its earlier version in all later counts. A flow without id is stored and handed on under
    a made one (batch and place), so it counts and gets its event like any other. Rows older than the newest stored time minus the
    allowed lateness are copied to ``late_path``.
    """
    window_ms = window_minutes * activity.MINUTE_MS

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(_once(batch, batch_id).withColumn("hour", F.floor(F.col("start_ms") / HOUR_MS)), batch_id, flows_path, "hour")
        mine = spark.read.schema(batch.schema).parquet(f"{flows_path}/batch_id={batch_id}").select(*batch.columns)
        span = mine.agg(F.min("start_ms").alias("lo"), F.count("start_ms").alias("timed"), F.count("*").alias("n")).first()
        if span["n"] == 0:
            return
        log = _log(spark, flows_path, batch.schema, batch_id)
        parts = []
        if span["timed"]:
            if lateness_minutes is not None and late_path is not None:
                newest = _stored(spark, flows_path, batch.schema, 0, batch_id - 1).agg(F.max("start_ms").alias("m")).first()["m"]
                if newest is not None:
                    cut = newest - lateness_minutes * activity.MINUTE_MS
                    write_batch(mine.filter(F.col("start_ms") < cut), batch_id, late_path)
            recent = _stored(spark, flows_path, batch.schema, span["lo"] - window_ms, batch_id)
            parts.append(activity.trailing_counts(_last_versions(recent, log), window_ms))
        if span["n"] > span["timed"]:
            sources = mine.filter(F.col("start_ms").isNull()).select("src_ip").distinct()
            parts.append(activity.untimed_counts(_last_versions(log.join(sources, "src_ip", "left_semi"), log)))
        counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        then(mine.join(counts, "flow_id"), batch_id)

    return handle


def daily_counts(stream: DataFrame, value: str = "route", lateness: str = "2 days") -> DataFrame:
    """Counts per local day and value; local midnight in Seoul is 15:00 UTC."""
    timed = stream.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", lateness)
    counted = timed.groupBy(F.window("at", "1 day", "1 day", "15 hours").alias("w"), F.col(value).alias("value")).count()
    return counted.select((F.unix_millis("w.start")).alias("day_ms"), "value", F.col("count").alias("n"))


def drop_resent(stream: DataFrame, key: str = "flow_id", lateness: str = "1 day") -> DataFrame:
    """Exact re-sends within the watermark are dropped (the first copy stays)."""
    timed = stream.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark([key]).drop("at")
