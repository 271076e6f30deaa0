"""Flow readers: CSV and JSON records to the common flow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from netsift import constants as K
from netsift.functions.scalars import blank_to_null, coerce_int, day_token

FLOW_SCHEMA = (
    "flow_id string, start_ms bigint, end_ms bigint, src_ip string, dst_ip string, src_port bigint, dst_port bigint, "
    "protocol string, features map<string,string>, raw_label string, raw_attack string"
)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV flows; give ``columns`` (the header) to skip the header inference pass."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return from_columns(reader.csv(path))


def from_columns(raw: DataFrame, position: Column | None = None) -> DataFrame:
    """Text columns by their CSV names -> flow columns; every other column becomes a feature.

    A missing flow id becomes ``flow-<position>``: a given input position, or
    a stable hash of the row when the source has none (files are read in parallel).
    """
    have = set(raw.columns)
    text = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    extras = [c for c in raw.columns if c not in K.CORE_COLUMNS]
    pairs = [part for c in extras for part in (F.lit(c), F.col(c).cast("string"))]
    features = F.create_map(*pairs) if pairs else F.create_map()
    where = F.hex(F.xxhash64(*[text(c) for c in raw.columns])) if position is None else position.cast("string")
    fill = lambda name: F.coalesce(text(name), F.lit(""))
    return raw.select(
        F.coalesce(blank_to_null(text("flow_id")), F.concat(F.lit("flow-"), where)).alias("flow_id"),
        coerce_int(text("FLOW_START_MILLISECONDS"), None).alias("start_ms"),
        coerce_int(text("FLOW_END_MILLISECONDS"), None).alias("end_ms"),
        fill("IPV4_SRC_ADDR").alias("src_ip"),
        fill("IPV4_DST_ADDR").alias("dst_ip"),
        coerce_int(text("L4_SRC_PORT")).alias("src_port"),
        coerce_int(text("L4_DST_PORT")).alias("dst_port"),
        fill("PROTOCOL").alias("protocol"),
        F.map_filter(features.cast("map<string,string>"), lambda _, v: v.isNotNull()).alias("features"),
        blank_to_null(text("Label")).alias("raw_label"),
        blank_to_null(text("Attack")).alias("raw_attack"),
    )


NAMES = {
    "start_ms": "FLOW_START_MILLISECONDS", "end_ms": "FLOW_END_MILLISECONDS", "src_ip": "IPV4_SRC_ADDR", "dst_ip": "IPV4_DST_ADDR",
    "src_port": "L4_SRC_PORT", "dst_port": "L4_DST_PORT", "protocol": "PROTOCOL", "raw_label": "Label", "raw_attack": "Attack",
}


def normalize_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON records in either naming scheme -> flow columns plus ``rejected`` (no id, or not an object).

    The short name wins whenever its key is present. Unknown keys join the
    features without replacing any that is there.
    """
    top = F.from_json(column, "map<string,string>")
    rows = payloads.withColumn("_m", F.coalesce(top, F.create_map().cast("map<string,string>")))
    m = F.col("_m")
    pick = lambda name: F.when(F.map_contains_key(m, name), F.try_element_at(m, F.lit(name))).otherwise(
        F.try_element_at(m, F.lit(NAMES[name]))
    )
    known = ["flow_id", "features", *NAMES, *NAMES.values()]
    given = F.coalesce(F.from_json(F.try_element_at(m, F.lit("features")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("_f", given)
    extra = F.map_filter(m, lambda k, _: ~k.isin(known) & ~F.map_contains_key(F.col("_f"), k))
    flow_id = F.coalesce(
        blank_to_null(F.try_element_at(m, F.lit("flow_id"))), blank_to_null(F.try_element_at(m, F.lit("id"))), F.lit("")
    )
    fill = lambda name: F.coalesce(pick(name), F.lit(""))
    return rows.select(
        *payloads.columns,
        flow_id.alias("flow_id"), coerce_int(pick("start_ms"), None).alias("start_ms"), coerce_int(pick("end_ms"), None).alias("end_ms"),
        fill("src_ip").alias("src_ip"), fill("dst_ip").alias("dst_ip"), coerce_int(pick("src_port")).alias("src_port"),
        coerce_int(pick("dst_port")).alias("dst_port"), fill("protocol").alias("protocol"),
        F.map_concat(F.col("_f"), extra).alias("features"), pick("raw_label").alias("raw_label"), pick("raw_attack").alias("raw_attack"),
        (flow_id == "").alias("rejected"),
    )


def to_json(flows: DataFrame) -> DataFrame:
    """Flow columns -> one JSON payload per row."""
    names = ["flow_id", "start_ms", "end_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "features", "raw_label", "raw_attack"]
    return flows.select("flow_id", F.to_json(F.struct(*[c for c in names if c in flows.columns])).alias("payload"))


def filter_day(flows: DataFrame, day: int, column: str = "flow_id") -> DataFrame:
    """Flows whose id carries the day token; an empty day is an error raised where it is read."""
    return flows.filter(F.lower(column).contains(day_token(day)))


def require_rows(flows: DataFrame, what: str) -> DataFrame:
    if flows.limit(1).count() == 0:
        raise ValueError(f"no flows for {what}")
    return flows


def split_local_days(flows: DataFrame, path: str) -> None:
    """One folder per local calendar day."""
    from netsift.functions.timefn import local_day

    flows.withColumn("day", local_day(F.col("start_ms"))).write.mode("overwrite").partitionBy("day").parquet(path)
