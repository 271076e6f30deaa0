"""Joins: event assembly, zones, topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions import scalars as S
from netsift.functions import timefn
from netsift.operators import activity, events, summary, topology
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.aggregates import DAILY_SQL, EVENTS_SQL, RECENT, STORE
from netsift.plans.catalog.common import event_frame, joined, r6, view
from netsift.plans.catalog.scalars import GROUP_CASE
from netsift.plans.catalog.sqltext import IPV4, between_cidr, ip_int


def _ansi_ev(body, *more, extra=None):
    return inputs.ansi(body, *STORE, *more, extra={**EVENTS_SQL, **(extra or {})})


@query("event_assembly", _ansi_ev("SELECT flow_id, coalesce(CAST(start_ms AS VARCHAR), 'none') AS start_ms, src_ip, dst_ip, dst_port, round(prob, 6) AS prob, category_hint, route, adjusted_by_watchlist, verdict, severity, watchlist_matched, fallback_source FROM ev"))
def event_assembly(spark, sf):
    return event_frame(spark, sf).select("flow_id", F.coalesce(F.col("start_ms").cast("string"), F.lit("none")).alias("start_ms"), "src_ip", "dst_ip", "dst_port", r6(F.col("prob")).alias("prob"), "category_hint", "route", "adjusted_by_watchlist", "verdict", "severity", "watchlist_matched", "fallback_source")


@query("event_detail", _ansi_ev(
    """SELECT ev.flow_id, coalesce(verdict, CASE WHEN route = 'tier1_llm' THEN 'processing' END) AS verdict, coalesce(model_name, 'none') AS model_name, coalesce(CAST(k.created_at AS VARCHAR), 'none') AS call_at FROM ev LEFT JOIN calls k ON k.flow_id = ev.flow_id""", "calls"))
def event_detail(spark, sf):
    """The detail rows of every event; one event is the same frame behind an id filter."""
    detail = events.detail_frame(*(view(spark, sf, n) for n in (*STORE, "calls")))
    return detail.select("flow_id", "verdict", F.coalesce("model_name", F.lit("none")).alias("model_name"), F.coalesce(F.col("call_at").cast("string"), F.lit("none")).alias("call_at"))


IDS = "SELECT flow_id FROM manifest WHERE cve_id IS NOT NULL"


@query("complete_events", inputs.ansi(f"SELECT f.flow_id, route, verdict FROM flows f JOIN routes r ON r.flow_id = f.flow_id JOIN verdicts v ON v.flow_id = f.flow_id WHERE f.flow_id IN ({IDS})", "flows", "routes", "verdicts", "manifest"))
def complete_events(spark, sf):
    ids = view(spark, sf, "manifest").filter(F.col("cve_id").isNotNull())
    return events.complete_events(*(view(spark, sf, n) for n in ("flows", "routes", "verdicts")), ids).select("flow_id", "route", "verdict")


@query("events_with_calls", inputs.ansi("SELECT count(*) AS row_count, (SELECT count(*) FROM verdicts) AS id_count, false AS ok FROM verdicts v LEFT JOIN calls c ON c.flow_id = v.flow_id", "verdicts", "calls"))
def events_with_calls(spark, sf):
    """The fan-out guard: second calls multiply events here, and the guard says so."""
    rows = view(spark, sf, "verdicts")
    return events.fan_out(events.events_with_calls(rows, view(spark, sf, "calls").select("flow_id", "call_id")), rows)


@query("daily_rows", inputs.ansi("SELECT flow_id, route, verdict FROM d WHERE (start_ms >= 1705244400000 AND start_ms < 1705330800000) OR (start_ms IS NULL AND created_at >= TIMESTAMP '2024-01-14 15:00:00' AND created_at < TIMESTAMP '2024-01-15 15:00:00')", *STORE, extra=DAILY_SQL))
def daily_rows(spark, sf):
    rows = summary.daily_rows(*(view(spark, sf, n) for n in ("flows_nulls", "routes", "verdicts")), day="2024-01-15")
    return rows.select("flow_id", "route", "verdict")


@query("daily_calls", inputs.ansi(
    """SELECT count(call_id) AS total, count(*) FILTER (WHERE NOT success) AS failed, round(avg(latency_ms), 6) AS avg_latency_ms, max(latency_ms) AS max_latency_ms, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens_used
    FROM flows_nulls f JOIN calls c ON c.flow_id = f.flow_id WHERE (start_ms >= 1705244400000 AND start_ms < 1705330800000) OR (start_ms IS NULL AND f.created_at >= TIMESTAMP '2024-01-14 15:00:00' AND f.created_at < TIMESTAMP '2024-01-15 15:00:00')""", "flows_nulls", "calls"))
def daily_calls(spark, sf):
    flows = view(spark, sf, "flows_nulls")
    day = flows.filter(timefn.in_local_day(F.col("start_ms"), F.col("created_at"), "2024-01-15")).select("flow_id")
    return summary.call_stats(view(spark, sf, "calls").join(day, "flow_id")).withColumn("avg_latency_ms", r6(F.col("avg_latency_ms")))


@query("prior_flow_join", inputs.ansi("SELECT a.flow_id, count(b.flow_id) AS prior_count, coalesce(CAST(max(b.start_ms) AS VARCHAR), 'none') AS last_prior_ms FROM flows a LEFT JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - 10800000 GROUP BY a.flow_id", "flows"))
def prior_flow_join(spark, sf):
    found = activity.prior_flows(view(spark, sf, "flows"), 180)
    return found.withColumn("last_prior_ms", F.coalesce(F.col("last_prior_ms").cast("string"), F.lit("none")))


@query("new_reviews", inputs.ansi("SELECT v.flow_id FROM verdicts v JOIN flows_nulls f ON f.flow_id = v.flow_id WHERE verdict = 'uncertain' AND created_at >= TIMESTAMP '2024-01-20 00:00:00'", "verdicts", "flows_nulls"))
def new_reviews(spark, sf):
    now = event_frame(spark, sf)
    before = now.filter(F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return events.new_reviews(now, before)


# --- zones and the asset graph -----------------------------------------------------

ZONES = {
    "zr": """SELECT zone_seq, zone, list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: CAST(x AS BIGINT)), lambda p, q: p * 256 + q) AS lo0, CAST(split_part(cidr, '/', 2) AS INT) AS prefix
      FROM zones WHERE cidr <> 'not-a-range'""",
    "zones_n": "SELECT zone_seq, zone, prefix, lo0 // CAST(pow(2, 32 - prefix) AS BIGINT) * CAST(pow(2, 32 - prefix) AS BIGINT) AS lo, CAST(pow(2, 32 - prefix) AS BIGINT) AS size FROM zr",
}


def zone_sql(source):
    return f"""SELECT ip, zone FROM (SELECT a.ip, z.zone, row_number() OVER (PARTITION BY a.ip ORDER BY z.prefix DESC, z.zone_seq) AS rn FROM (SELECT DISTINCT ip, {ip_int('ip')} AS n FROM {source}) a
      LEFT JOIN zones_n z ON a.n BETWEEN z.lo AND z.lo + z.size - 1) WHERE rn = 1"""


ENDS = {"ends": "SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows"}


@query("zone_lookup", inputs.ansi(zone_sql("ends"), "flows", "zones", extra={**ENDS, **ZONES}))
def zone_lookup(spark, sf):
    ends = events.union_of_ends(view(spark, sf, "flows")).withColumnRenamed("value", "ip")
    return topology.zone_of(ends, view(spark, sf, "zones")).select("ip", "zone")


def assets(spark, sf):
    none = F.array().cast("array<string>")
    return view(spark, sf, "assets").withColumn("services", F.coalesce(S.split_list(F.col("services_text")), none))


SVC = "coalesce(list_filter(list_transform(string_split(services_text, ','), lambda x: trim(x)), lambda x: x <> ''), [])"
ASSET_SQL = {
    **ZONES, "az": zone_sql("(SELECT ip FROM assets WHERE zone IS NULL)"),
    "an": f"""SELECT s.*, coalesce(s.zone, z.zone, '-') AS zone_found, {GROUP_CASE.replace('txt', 'tx')} AS grp FROM
      (SELECT a.*, coalesce(a.zone, (SELECT zone FROM az WHERE az.ip = a.ip), '') || ' ' || role || ' ' || array_to_string({SVC}, ' ') AS tx FROM assets a) s LEFT JOIN az z ON z.ip = s.ip""",
}


@query("asset_zone", inputs.ansi("SELECT ip, zone_found, grp FROM an", "assets", "zones", extra=ASSET_SQL))
def asset_zone(spark, sf):
    return topology.asset_zone(assets(spark, sf), view(spark, sf, "zones")).select("ip", "zone_found", F.col("group").alias("grp"))


PRIVATE = between_cidr("e.ip", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
NODE_SQL = {
    **ASSET_SQL, **ENDS, "rest": "SELECT ip FROM ends WHERE ip NOT IN (SELECT ip FROM assets)", "rz": zone_sql("rest"),
    "en": f"SELECT ip, zn AS zone, {GROUP_CASE.replace('txt', 'zn')} AS grp FROM (SELECT e.ip, coalesce(rz.zone, CASE WHEN NOT regexp_matches(e.ip, '{IPV4}') THEN 'unknown' WHEN {PRIVATE} THEN 'internal-unknown' ELSE 'external-unknown' END) AS zn FROM rest e LEFT JOIN rz ON rz.ip = e.ip)",
    "nodes": "SELECT 'asset:' || ip AS id, ip, role AS label, zone_found AS zone, grp, criticality, 'asset_input' AS source FROM an UNION ALL SELECT 'endpoint:' || ip, ip, ip, zone, grp, 'unknown', 'recent_flow' FROM en",
}


def nodes(spark, sf):
    return topology.topology_nodes(assets(spark, sf), view(spark, sf, "zones"), view(spark, sf, "flows"))


@query("endpoint_nodes", inputs.ansi("SELECT ip, zone, grp FROM en", "flows", "assets", "zones", extra=NODE_SQL))
def endpoint_nodes(spark, sf):
    found = topology.endpoint_nodes(view(spark, sf, "flows"), assets(spark, sf), view(spark, sf, "zones"))
    return found.select("ip", "zone", F.col("group").alias("grp"))


@query("topology_nodes", inputs.ansi("SELECT * FROM nodes", "flows", "assets", "zones", extra=NODE_SQL))
def topology_nodes(spark, sf):
    return topology.ordered_nodes(nodes(spark, sf)).select("id", "ip", "label", "zone", F.col("group").alias("grp"), "criticality", "source")


@query("topology_groups", inputs.ansi("SELECT grp, count(*) FILTER (WHERE source = 'asset_input') AS asset_count, count(*) FILTER (WHERE source <> 'asset_input') AS recent_endpoint_count, coalesce(string_agg(DISTINCT zone, '|' ORDER BY zone) FILTER (WHERE zone NOT IN ('', '-')), '') AS zones, count(*) AS total_count FROM nodes GROUP BY grp", "flows", "assets", "zones", extra=NODE_SQL))
def topology_groups(spark, sf):
    return topology.topology_groups(nodes(spark, sf)).select(F.col("group").alias("grp"), "asset_count", "recent_endpoint_count", joined(F.col("zones")).alias("zones"), "total_count")


EDGE_SQL = {
    "recent": f"SELECT *, row_number() OVER ({RECENT}) AS rk FROM ev {RECENT} LIMIT 100",
    "named": """SELECT r.*, CASE WHEN src_ip IN (SELECT ip FROM assets) THEN 'asset:' ELSE 'endpoint:' END || src_ip AS src, CASE WHEN dst_ip IN (SELECT ip FROM assets) THEN 'asset:' ELSE 'endpoint:' END || dst_ip AS dst,
      coalesce(verdict, CASE WHEN route = 'tier1_llm' THEN 'processing' END) AS vd, CASE WHEN verdict IS NULL AND route = 'tier1_llm' THEN 'pending' ELSE severity END AS sv FROM recent r""",
    "edges": """SELECT src, dst, count(*) AS count, string_agg(flow_id, '|' ORDER BY rk) AS flow_ids, arg_min(flow_id, rk) AS latest_flow_id, arg_min(route, rk) FILTER (WHERE route IS NOT NULL) AS latest_route,
      arg_min(vd, rk) FILTER (WHERE vd IS NOT NULL) AS latest_verdict, arg_min(sv, rk) FILTER (WHERE sv IS NOT NULL) AS latest_severity,
      count(*) FILTER (WHERE vd = 'alert' OR route = 'auto_alert' OR sv IN ('high', 'critical')) AS alert_count, count(*) FILTER (WHERE watchlist_matched <> '') AS watchlist_hit_count FROM named GROUP BY src, dst""",
}


def edges(spark, sf):
    return topology.topology_edges(topology.recent_list(event_frame(spark, sf)), assets(spark, sf))


@query("topology_edges", _ansi_ev("SELECT * FROM edges", "assets", extra=EDGE_SQL))
def topology_edges(spark, sf):
    return edges(spark, sf).select("src", "dst", "count", joined(F.col("flow_ids")).alias("flow_ids"), "latest_flow_id", "latest_route", "latest_verdict", "latest_severity", "alert_count", "watchlist_hit_count")


@query("node_scores", _ansi_ev("SELECT node, CAST(sum(count + 20 * alert_count + 12 * watchlist_hit_count) AS BIGINT) AS score FROM (SELECT src AS node, * FROM edges UNION ALL SELECT dst AS node, * FROM edges) GROUP BY node", "assets", extra=EDGE_SQL))
def node_scores(spark, sf):
    return topology.node_scores(edges(spark, sf))


@query("topology_status", inputs.ansi("SELECT CASE WHEN count(*) = 0 THEN 'no_assets' ELSE 'ready' END AS status, 'missing_assets' AS without_source, 'disabled' AS when_disabled FROM assets", "assets"))
def topology_status(spark, sf):
    found = topology.asset_nodes(assets(spark, sf), view(spark, sf, "zones")).agg(F.count("*").alias("n"))
    status = lambda s: topology.topology_status(F.lit(s).cast("string"), F.col("n"))
    return found.select(status("used").alias("status"), status(None).alias("without_source"), status("disabled").alias("when_disabled"))


# A watchlist over the assets: three priorities, some addresses named twice.
FOCUS = {
    "wi": "SELECT seq AS item_seq, concat('priority_', cast(1 + seq % 3 AS {S})) AS priority, concat('W-', asset_id) AS item_id FROM {A}",
    "wt": "SELECT seq AS item_seq, 0 AS target_seq, ip FROM {A} WHERE seq % 2 = 0 UNION ALL SELECT seq + 1 AS item_seq, 1 AS target_seq, ip FROM {A} WHERE seq % 4 = 0",
}
FOCUS_SQL = {k: v.replace("{S}", "VARCHAR").replace("{A}", "assets") for k, v in FOCUS.items()}
FOCUS_SQL["focus"] = "SELECT ip, priority, item_id FROM (SELECT ip, priority, item_id, row_number() OVER (PARTITION BY ip ORDER BY priority, i.item_seq, target_seq) AS rn FROM wt JOIN wi i USING (item_seq)) WHERE rn = 1"


def focus(spark, sf):
    view(spark, sf, "assets").createOrReplaceTempView("focus_assets")
    made = {k: spark.sql(v.replace("{S}", "STRING").replace("{A}", "focus_assets")) for k, v in FOCUS.items()}
    return topology.watchlist_focus(made["wi"], made["wt"])


@query("watchlist_focus", inputs.ansi("SELECT * FROM focus", "assets", extra=FOCUS_SQL))
def watchlist_focus(spark, sf):
    return focus(spark, sf)


MAP_SQL = {
    **ASSET_SQL, **FOCUS_SQL,
    "amap": """SELECT 'asset_' || lower(replace(replace(asset_id || '_' || an.ip, '#', '_'), '.', '_')) AS id, an.ip, role AS label, grp, zone_found AS zone, criticality, status, f.priority, f.item_id AS watchlist_item_id,
      CASE WHEN f.priority IS NOT NULL THEN 'watchP' || right(f.priority, 1) WHEN status = 'retired' THEN 'retired' WHEN criticality IN ('critical', 'high') THEN 'critical' ELSE 'normal' END AS base_class
      FROM an LEFT JOIN focus f ON f.ip = an.ip""",
}


def asset_map_frame(spark, sf):
    return topology.asset_map(assets(spark, sf), view(spark, sf, "zones"), focus(spark, sf))


@query("asset_map", inputs.ansi("SELECT * FROM amap", "assets", "zones", extra=MAP_SQL))
def asset_map(spark, sf):
    return asset_map_frame(spark, sf).withColumnRenamed("group", "grp")


@query("asset_order", inputs.ansi("SELECT ip, row_number() OVER (ORDER BY CASE criticality WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, label, ip) AS place FROM amap", "assets", "zones", extra=MAP_SQL))
def asset_order(spark, sf):
    from netsift.operators.ranks import range_rank

    rank, label, ip = topology.asset_order()
    keyed = asset_map_frame(spark, sf).select("ip", rank.alias("o1"), label.alias("o2"), ip.alias("o3"))
    return range_rank(keyed, ["o1", "o2", "o3"], "place").select("ip", "place")


@query("group_edges", inputs.ansi(
    "SELECT src, dst FROM (VALUES ('external', 'dmz'), ('dmz', 'internal-app'), ('workstation', 'internal-app'), ('admin', 'internal-app'), ('admin', 'infrastructure'), ('admin', 'backup'), ('infrastructure', 'internal-app'), ('internal-app', 'database'), ('internal-app', 'clinical'), ('internal-app', 'backup'), ('clinical', 'internal-app')) t(src, dst) WHERE src IN (SELECT grp FROM amap) AND dst IN (SELECT grp FROM amap)",
    "assets", "zones", extra=MAP_SQL))
def group_edges(spark, sf):
    return topology.group_edges(asset_map_frame(spark, sf).select("group")).select("src", "dst")
