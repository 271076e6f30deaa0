"""Context sources: validation and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which lists a source may hold, and which count as its items.
CHECKED_LISTS = {
    "assets": ["assets", "trust_zones"],
    "policy": ["elevated_risk_rules", "asset_specific_policies", "policies"],
    "cve_feed": ["advisories", "cves"],
    "threat_feed": ["known_malicious_ips", "custom_threat_context", "suspicious_patterns"],
    "organization": ["organization"],
}
COUNTED_LISTS = {**CHECKED_LISTS, "assets": ["assets"]}


def source_status(rows: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """(name, status, item_count, error) from rows (source, list_key, pos, valid).

    disabled: switched off; missing: no rows; error: a row of a checked list is
    not a record (the first one is named); used: everything else.
    """
    spark = rows.sparkSession
    settings = spark.createDataFrame(list(enabled.items()), "name string, enabled boolean")
    counted = F.lit(False)
    checked = F.lit(False)
    order = F.lit(99)
    for source, lists in CHECKED_LISTS.items():
        checked = checked | ((F.col("source") == source) & F.col("list_key").isin(lists))
        for rank, key in enumerate(lists):
            order = F.when((F.col("source") == source) & (F.col("list_key") == key), rank).otherwise(order)
    for source, lists in COUNTED_LISTS.items():
        counted = counted | ((F.col("source") == source) & F.col("list_key").isin(lists))
    message = F.concat("list_key", F.lit("["), F.col("pos").cast("string"), F.lit("] must be a dictionary."))
    facts = rows.groupBy(F.col("source").alias("name")).agg(
        F.count_if(counted).alias("items"),
        F.min_by(message, F.when(checked & ~F.col("valid"), F.struct(order.alias("o"), F.col("pos").alias("p")))).alias("problem"),
        F.count("*").alias("n"),
    )
    joined = settings.join(facts, "name", "left")
    status = (
        F.when(~F.col("enabled"), "disabled").when(F.col("n").isNull(), "missing").when(F.col("problem").isNotNull(), "error").otherwise("used")
    )
    joined = joined.withColumn("status", status)
    used = F.col("status") == "used"
    return joined.select(
        "name", "status", F.when(used, F.col("items")).otherwise(0).alias("item_count"),
        F.when(F.col("status") == "error", F.col("problem")).otherwise("").alias("error"),
    )


def with_history(status: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Adds the event-history source: used with the number of verdicts, disabled without a store."""
    spark = status.sparkSession
    if verdicts is None:
        row = spark.createDataFrame([("tier1_db", "disabled", 0, "")], "name string, status string, item_count bigint, error string")
    else:
        row = verdicts.agg(F.count("*").alias("item_count")).select(
            F.lit("tier1_db").alias("name"), F.lit("used").alias("status"), "item_count", F.lit("").alias("error")
        )
    return status.unionByName(row)
