"""Keyed table maintenance: replace, delete-then-insert, append, schema growth, overlays, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key; partial aggregation first, so many copies of one key stay cheap."""
    record = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(record, F.struct(*order)).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replace-by-key: new rows win, the last one when a key comes twice."""
    tagged = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return keep_last(tagged, key, ["_gen", *order]).drop("_gen")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete by key, then insert."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two schema versions together; columns one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def overlay(base: DataFrame, additions: DataFrame, days: int) -> DataFrame:
    """One version of the table per day: the base plus additions in force from ``from_day`` on."""
    every = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day")
    later = F.explode(F.sequence(F.col("from_day"), F.lit(days))).alias("day")
    kept = additions.filter(F.col("from_day") <= days)
    return base.select(every, "*").unionByName(kept.select(later, *[c for c in base.columns]))


def apply_updates(versions: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns replaced from ``from_day`` on; the latest update in force wins."""
    joined = versions.join(updates.select(key, "from_day", *[F.col(c).alias(f"_u_{c}") for c in columns]), key, "left")
    active = F.col("from_day") <= F.col("day")
    record = F.struct(*[F.col(f"_u_{c}") for c in columns])
    base = [c for c in versions.columns]
    latest = joined.groupBy(*base).agg(F.max_by(F.when(active, record), F.when(active, F.col("from_day"))).alias("u"))
    return latest.select(*[F.coalesce(F.col(f"u._u_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base])


def clean_rows(rows: DataFrame, list_columns: list[str]) -> DataFrame:
    """Empty texts become null; list columns become arrays of trimmed parts."""
    from netsift.functions.scalars import blank_to_null, split_list

    fixed = {}
    for name, kind in rows.dtypes:
        if name in list_columns:
            fixed[name] = split_list(F.col(name))
        elif kind == "string":
            fixed[name] = blank_to_null(F.col(name))
    return rows.withColumns(fixed)


def target_list(source: Column, has_ip: Column) -> Column:
    """The list a new context row belongs to."""
    return (
        F.when(source == "assets", "assets")
        .when(source == "policy", "policies")
        .when(source == "cve_feed", "cves")
        .when(source == "threat_feed", F.when(has_ip, "known_malicious_ips").otherwise("suspicious_patterns"))
    )


def append_context(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Adds rows at the end of their (source, list); positions continue from each list's length."""
    placed = new.withColumn("list_key", target_list(F.col("source"), F.coalesce(F.col("ip") != "", F.lit(False))))
    sizes = rows.groupBy("source", "list_key").agg((F.max("pos") + 1).alias("_size"))
    order = Window.partitionBy("source", "list_key").orderBy("new_seq")  # the edits of one list
    numbered = placed.withColumn("_n", F.row_number().over(order) - 1).join(F.broadcast(sizes), ["source", "list_key"], "left")
    return rows.unionByName(numbered.withColumn("pos", F.coalesce("_size", F.lit(0)) + F.col("_n")).select(*rows.columns))


ALLOWED_LISTS = {
    "assets": ["assets"],
    "policy": ["policies", "elevated_risk_rules", "asset_specific_policies"],
    "cve_feed": ["cves", "advisories"],
    "threat_feed": ["known_malicious_ips", "suspicious_patterns", "custom_threat_context"],
}


def delete_context(rows: DataFrame, source: str, list_key: str, index: int) -> DataFrame:
    """Removes one position of a list; later positions move up. Out of range is an error."""
    if list_key not in ALLOWED_LISTS.get(source, []):
        raise ValueError(f"delete is not supported for {source} list {list_key!r}")
    here = (F.col("source") == source) & (F.col("list_key") == list_key)
    if index < 0 or rows.filter(here & (F.col("pos") == index)).limit(1).count() == 0:
        raise ValueError(f"delete index out of range for {list_key}")
    kept = rows.filter(~(here & (F.col("pos") == index)))
    return kept.withColumn("pos", F.when(here & (F.col("pos") > index), F.col("pos") - 1).otherwise(F.col("pos")))
