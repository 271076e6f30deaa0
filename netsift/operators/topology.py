"""Asset graph: zones, nodes, edges, groups, scores, curated map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import net
from netsift.functions import scalars as S
from netsift.operators import events


def zone_of(addresses: DataFrame, zones: DataFrame) -> DataFrame:
    """(ip, zone): longest matching range; ties keep the earlier zone row.

    The lookup runs on distinct addresses of both families, as one equality join per
    prefix length, so a large zone table never becomes a nested loop.
    """
    ranges = (
        zones.withColumn("b", net.cidr_bounds(F.col("cidr")))
        .filter(F.col("b").isNotNull())
        .select("zone_seq", "zone", F.col("b.lo").alias("lo"), F.col("b.prefix").alias("prefix"))
    )
    lengths = ranges.select(F.substring("lo", 1, 1).alias("family"), "prefix").distinct()  # at most 33 and 129 rows
    distinct = addresses.select("ip").distinct().withColumn("key", net.ip_key(F.col("ip")))
    keyed = (
        distinct.filter(F.col("key").isNotNull())
        .withColumn("family", F.substring("key", 1, 1))
        .join(F.broadcast(lengths), "family")
        .withColumn("lo", net.masked_key(F.col("key"), F.col("prefix")))
    )
    best = keyed.join(ranges, ["prefix", "lo"]).groupBy("ip").agg(
        F.max_by("zone", F.struct("prefix", (-F.col("zone_seq")).alias("first"))).alias("zone")
    )
    return distinct.select("ip").join(best, "ip", "left")


def asset_zone(assets: DataFrame, zones: DataFrame) -> DataFrame:
    """Assets with ``zone_found`` (own zone, else lookup, else '-') and ``group``."""
    looked = zone_of(assets.filter(F.coalesce(F.col("zone"), F.lit("")) == ""), zones).withColumnRenamed("zone", "looked_up")
    joined = assets.join(looked, "ip", "left")
    zone = F.coalesce(S.blank_to_null(F.col("zone")), S.blank_to_null(F.col("looked_up")))
    text = F.concat_ws(" ", F.coalesce(zone, F.lit("")), F.coalesce("role", F.lit("")), F.array_join(F.coalesce("services", F.array().cast("array<string>")), " "))
    return joined.withColumns({"zone_found": F.coalesce(zone, F.lit("-")), "group": S.classify_group(text)}).drop("looked_up")


def endpoint_nodes(edges_or_events: DataFrame, assets: DataFrame, zones: DataFrame) -> DataFrame:
    """Event endpoints that are no asset: node rows of their own."""
    ends = edges_or_events.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    ends = ends.filter(F.coalesce(F.trim("ip") != "", F.lit(False))).distinct().join(assets.select("ip"), "ip", "left_anti")
    zoned = zone_of(ends, zones)
    zone = F.coalesce(S.blank_to_null(F.col("zone")), net.fallback_zone(F.col("ip")))
    return zoned.select(
        F.concat(F.lit("endpoint:"), F.col("ip")).alias("id"), "ip", F.col("ip").alias("label"), F.lit("recent endpoint").alias("role"),
        zone.alias("zone"), S.classify_group(zone).alias("group"), F.lit("unknown").alias("criticality"), F.lit("recent_flow").alias("source"),
    )


def asset_nodes(assets: DataFrame, zones: DataFrame) -> DataFrame:
    named = asset_zone(assets.filter(F.coalesce(F.col("ip") != "", F.lit(False))), zones)
    role = S.blank_to_null(F.col("role"))
    return named.select(
        F.concat(F.lit("asset:"), F.col("ip")).alias("id"), "ip",
        F.coalesce(role, S.blank_to_null(F.col("asset_id")), F.col("ip")).alias("label"), F.coalesce(role, F.lit("-")).alias("role"),
        F.col("zone_found").alias("zone"), "group", F.coalesce(S.blank_to_null(F.col("criticality")), F.lit("unknown")).alias("criticality"),
        F.lit("asset_input").alias("source"),
    )


def topology_nodes(assets: DataFrame, zones: DataFrame, recent: DataFrame) -> DataFrame:
    return asset_nodes(assets, zones).unionByName(endpoint_nodes(recent, assets, zones))


def group_rank(group: Column) -> Column:
    return S.case_of(group, K.GROUP_ORDER, 99)


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(group_rank(F.col("group")), "label", "ip")


def topology_edges(recent: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges between endpoints, with the newest known values; events arrive as a bounded recent list."""
    known = assets.select("ip", F.lit(True).alias("is_asset")).distinct()
    name = lambda side: F.concat(F.when(F.col(f"{side}_asset"), "asset:").otherwise("endpoint:"), F.col(f"{side}_ip"))
    joined = recent
    for side in ("src", "dst"):
        joined = joined.join(
            known.select(F.col("ip").alias(f"{side}_ip"), F.col("is_asset").alias(f"{side}_asset")), f"{side}_ip", "left"
        ).withColumn(f"{side}_asset", F.coalesce(f"{side}_asset", F.lit(False)))
    recency = F.struct(F.coalesce("start_ms", F.lit(0)).alias("t"), F.col("created_at").alias("c"), "flow_id")
    newest = lambda column: F.max_by(column, F.when(F.col(column).isNotNull(), F.col("recency"))).alias(f"latest_{column}")
    alert = S.alert_event(F.col("verdict"), F.col("route"), F.col("severity"))
    rows = joined.filter((F.col("src_ip") != "") & (F.col("dst_ip") != "")).withColumns(
        {"src": name("src"), "dst": name("dst"), "recency": recency}
    )
    grouped = rows.groupBy("src", "dst", "src_ip", "dst_ip").agg(
        F.count("*").alias("count"),
        F.transform(F.sort_array(F.collect_list(F.struct("recency", "flow_id")), asc=False), lambda x: x["flow_id"]).alias("flow_ids"),
        newest("flow_id"), newest("route"), newest("verdict"), newest("severity"),
        F.count_if(alert).alias("alert_count"),
        F.count_if(S.watchlist_hit(F.col("watchlist_matched"))).alias("watchlist_hit_count"),
    )
    return grouped.withColumn("id", F.concat("src", F.lit("->"), "dst"))


def edge_counts(all_events: DataFrame) -> DataFrame:
    """The same edges over any number of events: counters only, partially aggregated."""
    alert = S.alert_event(F.col("verdict"), F.col("route"), F.col("severity"))
    return all_events.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("count"), F.count_if(alert).alias("alert_count"),
        F.count_if(S.watchlist_hit(F.col("watchlist_matched"))).alias("watchlist_hit_count"),
    )


def topology_groups(nodes: DataFrame) -> DataFrame:
    label = S.case_of(F.col("group"), K.GROUP_LABELS, "Other")
    grouped = nodes.groupBy("group").agg(
        F.count_if(F.col("source") == "asset_input").alias("asset_count"),
        F.count_if(F.col("source") != "asset_input").alias("recent_endpoint_count"),
        F.array_sort(F.collect_set(F.when(~F.col("zone").isin("", "-"), F.col("zone")))).alias("zones"),
        F.count("*").alias("total_count"),
    )
    return grouped.withColumn("label", label)


def topology_status(source_status: Column, asset_nodes_found: Column) -> Column:
    return (
        F.when(source_status.isNull(), "missing_assets")
        .when(source_status != "used", source_status)
        .when(asset_nodes_found == 0, "no_assets")
        .otherwise("ready")
    )


def node_scores(edges: DataFrame) -> DataFrame:
    """Sum over incident edges of count + 20 * alerts + 12 * hits, at both ends."""
    score = F.col("count") + F.col("alert_count") * 20 + F.col("watchlist_hit_count") * 12
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), score.alias("score"))
    return ends.groupBy("node").agg(F.sum("score").alias("score"))


def watchlist_focus(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(ip, priority, item_id): the most urgent item per target address, first one on ties."""
    rows = targets.filter(F.coalesce(F.trim("ip") != "", F.lit(False))).join(items.select("item_seq", "priority", "item_id"), "item_seq")
    order = F.struct("priority", "item_seq", "target_seq")
    return rows.groupBy("ip").agg(F.min_by(F.struct("priority", "item_id"), order).alias("f")).select("ip", "f.priority", "f.item_id")


def criticality_rank(criticality: Column) -> Column:
    return S.case_of(F.lower(F.coalesce(criticality, F.lit(""))), K.CRITICALITY_RANK, 4)


def asset_map(assets: DataFrame, zones: DataFrame, focus: DataFrame) -> DataFrame:
    """Curated asset nodes: group, watch class, stable ids."""
    named = asset_zone(assets, zones).join(focus, "ip", "left")
    role, status = S.blank_to_null(F.col("role")), F.lower(F.coalesce("status", F.lit("")))
    base = (
        F.when(F.col("priority") == "priority_1", "watchP1")
        .when(F.col("priority") == "priority_2", "watchP2")
        .when(F.col("priority") == "priority_3", "watchP3")
        .when(status == "retired", "retired")
        .when(F.lower("criticality").isin("critical", "high"), "critical")
        .otherwise("normal")
    )
    stable = F.coalesce(S.blank_to_null(F.col("asset_id")), role, F.col("ip"))
    return named.select(
        S.node_id(F.concat(F.lit("asset_"), stable, F.lit("_"), F.col("ip"))).alias("id"), "ip",
        F.coalesce(role, S.blank_to_null(F.col("asset_id")), F.col("ip")).alias("label"), "group", F.col("zone_found").alias("zone"),
        F.coalesce("criticality", F.lit("unknown")).alias("criticality"), F.coalesce("status", F.lit("active")).alias("status"),
        "priority", F.col("item_id").alias("watchlist_item_id"), base.alias("base_class"),
    )


def asset_order() -> list[Column]:
    return [criticality_rank(F.col("criticality")), F.col("label"), F.col("ip")]


def group_edges(groups: DataFrame) -> DataFrame:
    """Allowed group-to-group edges where both groups occur (11 fixed pairs at most)."""
    spark = groups.sparkSession
    pairs = spark.createDataFrame(K.GROUP_EDGES, "src string, dst string")
    have = groups.select("group").distinct()
    return pairs.join(have.withColumnRenamed("group", "src"), "src", "left_semi").join(
        have.withColumnRenamed("group", "dst"), "dst", "left_semi"
    )


def recent_list(all_events: DataFrame, limit: int = 100) -> DataFrame:
    return events.recent_events(all_events, limit)
