"""One matcher for watchlists of any size.

A watchlist that fits the compiled form (64 items, 512 hints and targets, 62 bits per item) becomes column
expressions; any other goes through the join form. Both give the same ``match`` for every flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions.scalars import literal_map
from netsift.operators import matching, matching_tables
from netsift.operators.watchlist import Watchlist


def match_flows(flows: DataFrame, watchlist: Watchlist | list[matching.Rule], *, activity: bool = True) -> DataFrame:
    """Adds ``match``: the best watchlist item of each flow, or the empty match. Flow ids are unique."""
    if isinstance(watchlist, list):
        return matching.match_watchlist(flows, watchlist, activity=activity)
    try:
        return matching.match_watchlist(flows, matching.collect_rules(watchlist), activity=activity)
    except matching.WatchlistTooLarge:
        return joined_match(flows, watchlist, activity=activity)


def joined_match(flows: DataFrame, watchlist: Watchlist, *, activity: bool = True) -> DataFrame:
    """The join form, with the same column as the compiled one."""
    found = matching_tables.match_watchlist(flows, watchlist, activity=activity)
    m = F.col("best")
    rank = F.try_element_at(literal_map(K.STRENGTH_RANK), m["match_strength"])
    fired = (rank >= K.STRENGTH_RANK["review_candidate"]) & m["trigger_completeness"].isin("required_met", "strong")
    own = {"matched": F.lit(True), "scope_matched": F.lit(True), "trigger_matched": fired}
    names = [part.split(" ", 1)[0] for part in matching.MATCH_SCHEMA.split(", ")]
    full = F.struct(*[own.get(name, m[name]).alias(name) for name in names]).cast(matching.MATCH_STRUCT)
    joined = flows.join(found.withColumnRenamed("match", "best"), "flow_id", "left")
    return joined.withColumn("match", F.when(m.isNotNull(), full).otherwise(matching.no_match())).select(*flows.columns, "match")
