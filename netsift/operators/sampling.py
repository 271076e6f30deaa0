"""Quota sampling: the first k rows per key in source order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CELLS = 256


def quota_sample(rows: DataFrame, quotas: DataFrame, keys: list[str], order: str, cells: int = CELLS) -> DataFrame:
    """First ``quota`` rows per key; keys without a quota give none.

    Each key is dealt into ``cells`` parts by a hash. A part keeps its own first ``quota`` rows, so the
    second ranking sees at most cells x quota rows of a key, however many it has.
    """
    part = Window.partitionBy(*keys, "_cell").orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order)
    dealt = rows.join(quotas, keys).withColumn("_cell", F.pmod(F.xxhash64(order), F.lit(cells)))
    first = dealt.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= F.col("quota"))
    ranked = first.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= F.col("quota"))
    return ranked.drop("_rank", "_cell")


def quota_report(sample: DataFrame, quotas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key how many rows were found and how many are missing."""
    found = sample.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(order))).alias("ids"))
    joined = quotas.join(found, keys, "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        *keys, n.alias("n_found"), F.greatest(F.lit(0), F.col("quota") - n).alias("shortfall"),
        F.coalesce(F.col("ids").cast("array<string>"), F.array().cast("array<string>")).alias("ids"),
    )


def initial_benign_run(rows: DataFrame, order: str) -> DataFrame:
    """Marks rows before the first non-benign one; they are preferred sources of benign traffic."""
    first_attack = rows.filter(F.col("label") != "Benign").agg(F.min(order).alias("_first"))
    joined = rows.join(F.broadcast(first_attack), how="cross")  # one row
    early = F.coalesce(F.col(order) < F.col("_first"), F.lit(True)) & (F.col("label") == "Benign")
    return joined.withColumn(
        "source_stage", F.when(early, "initial_benign_run").otherwise("source_label_port_match")
    ).drop("_first")
