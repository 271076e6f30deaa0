"""Labelled documents: the split into learned and held-out rows, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents for which ``learn`` (over ``id``) holds.

    The sample is the rows with the smallest hash of the id, so it does not depend on order or partitions. Labels
    other than 0 and 1 and null ids are left out; repeated labels of an id are averaged. A hot id cannot exceed the
    bound: the joined rows are cut to it as well.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label].cast("double").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0) & learn)
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # at most ``rows`` ids and labels
    return joined.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(rows).select("text", "label")
