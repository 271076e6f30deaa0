"""Frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators import matching, watchlist
from netsift.plans import fixtures, inputs

_RULES: dict[tuple[str, bool], list[matching.Rule]] = {}


def worked_rules(spark: SparkSession, feedback: bool = False) -> list[matching.Rule]:
    """The worked watchlist, linted and compiled once per application; with ``feedback`` also the items on stored verdicts."""
    key = (spark.sparkContext.applicationId, feedback)
    if key not in _RULES:
        document = fixtures.FEEDBACK_WATCHLIST if feedback else fixtures.WATCHLIST
        _RULES[key] = matching.collect_rules(watchlist.load_watchlist(watchlist.document_frame(spark, document)))
    return _RULES[key]


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return inputs.view(spark, sf, name)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "flows").withColumn("ml_prob", F.col("mock_prob"))


def joined(values: Column) -> Column:
    """Lists are compared as text."""
    return F.array_join(values, "|")


def r6(value: Column) -> Column:
    return F.round(value, 6)


def event_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Stored events: flows with their model result, route and verdict where present."""
    from netsift.operators import events

    return events.assemble(*(view(spark, sf, n) for n in ("flows_nulls", "ml_results", "routes", "verdicts")))
