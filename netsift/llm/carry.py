"""Rows that pass through an Arrow step as one column, so names of other columns cannot clash with the step's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """``payload`` (all other columns, by position) and ``text``."""
    others = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    return docs.select(F.struct(F.lit(0).alias("row"), *others).alias("payload"), docs[text_col].cast("string").alias("text"))


def unpacked(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of ``docs`` again, in order and of their types, from ``payload`` and ``text``."""
    return [
        (F.col("text").cast(kind) if name == text_col else F.col(f"payload.c{k}")).alias(name)
        for k, (name, kind) in enumerate(docs.dtypes)
    ]
