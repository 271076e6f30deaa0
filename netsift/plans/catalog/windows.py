"""Trailing windows, rankings, top-k, pages, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import activity, events, routing, summary, verdicts
from netsift.plans import inputs, triage
from netsift.plans.catalog import query
from netsift.plans.catalog.aggregates import DAILY_SQL, EVENTS_SQL, HIT, RECENT, STATE_SQL, STORE, UTC_DAY, daily
from netsift.plans.catalog.common import event_frame, joined, r6, scored, view, worked_rules
from netsift.plans.catalog.sqltext import route_ctes
from netsift.session import run_folder
from netsift.sources import sinks

R = route_ctes()


def _ansi_ev(body, *more, extra=None):
    return inputs.ansi(body, *STORE, *more, extra={**EVENTS_SQL, **(extra or {})})


def activity_sql(minutes, source="flows"):
    return f"""SELECT a.flow_id, count(b.flow_id) AS flow_count, count(DISTINCT b.dst_ip) AS distinct_dst_count, count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip) AS same_dst_count,
      count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip AND b.dst_port = a.dst_port AND b.protocol = a.protocol) AS same_dst_port_count, count(b.flow_id) FILTER (WHERE b.hit) AS watchlist_hit_count
      FROM {source} a LEFT JOIN {source} b ON b.src_ip = a.src_ip AND b.flow_id <> a.flow_id AND (a.start_ms IS NULL OR (b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - {minutes * 60000})) GROUP BY a.flow_id"""


HITS = {"fh": f"SELECT f.*, coalesce({HIT}, false) AS hit, v.verdict FROM flows f LEFT JOIN verdicts v ON v.flow_id = f.flow_id"}
HITS_NULLS = {"fh": f"SELECT f.*, coalesce({HIT}, false) AS hit FROM flows_nulls f LEFT JOIN verdicts v ON v.flow_id = f.flow_id"}


def with_feedback(spark, sf, name="flows"):
    """Flows with the verdict feedback stored by earlier runs."""
    stored = view(spark, sf, "verdicts").select("flow_id", "verdict", F.coalesce(F.col("watchlist_matched") != "", F.lit(False)).alias("hit"))
    return view(spark, sf, name).join(stored, "flow_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("source_activity", inputs.ansi(activity_sql(1440, "fh"), "flows_nulls", "verdicts", extra=HITS_NULLS))
def source_activity(spark, sf):
    """One-day counters for every flow; flows without a time see all of their source."""
    return activity.source_counts(with_feedback(spark, sf, "flows_nulls"), 1440)


@query("source_activity_narrow_panes", inputs.ansi(activity_sql(4320, "fh"), "flows", "verdicts", extra=HITS))
def source_activity_narrow_panes(spark, sf):
    """Three-day counters with panes far narrower than the window, as hot sources get them."""
    return activity.trailing_counts(with_feedback(spark, sf), 4320 * 60000, pane_rows=20)


@query("activity_top_ports", inputs.ansi("SELECT flow_id, string_agg(CAST(dst_port AS VARCHAR), '|' ORDER BY n DESC, dst_port) AS ports FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY n DESC, dst_port) AS rn FROM (SELECT a.flow_id, b.dst_port, count(*) AS n FROM flows a JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - 259200000 GROUP BY ALL)) WHERE rn <= 5 GROUP BY flow_id", "flows"))
def activity_top_ports(spark, sf):
    ports = activity.top_ports(view(spark, sf, "flows"), 4320 * 60000)
    return ports.filter(F.size("top_dst_ports") > 0).select("flow_id", F.array_join(F.col("top_dst_ports").cast("array<string>"), "|").alias("ports"))


@query("recent_verdicts", inputs.ansi("SELECT flow_id, string_agg(verdict, '|' ORDER BY start_ms DESC, pid DESC) AS recent_verdicts, count(*) FILTER (WHERE verdict = 'alert') AS recent_alert_count FROM (SELECT a.flow_id, b.verdict, b.start_ms, b.flow_id AS pid, row_number() OVER (PARTITION BY a.flow_id ORDER BY b.start_ms DESC, b.flow_id DESC) AS rn FROM fh a JOIN fh b ON b.src_ip = a.src_ip AND b.verdict IS NOT NULL AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - 259200000) WHERE rn <= 5 GROUP BY flow_id", "flows", "verdicts", extra=HITS))
def recent_verdicts(spark, sf):
    found = activity.recent_verdicts(with_feedback(spark, sf), 4320 * 60000)
    return found.filter(F.size("recent_verdicts") > 0).select("flow_id", joined(F.col("recent_verdicts")).alias("recent_verdicts"), "recent_alert_count")


UNBOUNDED = """SELECT a.flow_id, count(b.flow_id) AS flow_count, count(DISTINCT b.dst_ip) AS distinct_dst_count, count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip) AS same_dst_count,
  count(b.flow_id) FILTER (WHERE b.dst_ip = a.dst_ip AND b.dst_port = a.dst_port AND b.protocol = a.protocol) AS same_dst_port_count FROM flows a LEFT JOIN flows b ON b.src_ip = a.src_ip AND b.arrival < a.arrival GROUP BY a.flow_id"""
UNBOUNDED_PORTS = """SELECT flow_id, string_agg(CAST(dst_port AS VARCHAR), '|' ORDER BY n DESC, seen) AS ports FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY n DESC, seen) AS rn FROM
  (SELECT a.flow_id, b.dst_port, count(*) AS n, min(b.arrival) AS seen FROM flows a JOIN flows b ON b.src_ip = a.src_ip AND b.arrival < a.arrival GROUP BY ALL)) WHERE rn <= 5 GROUP BY flow_id"""


@query("source_activity_unbounded", inputs.ansi(f"SELECT u.*, coalesce(p.ports, '') AS ports FROM ({UNBOUNDED}) u LEFT JOIN ({UNBOUNDED_PORTS}) p ON p.flow_id = u.flow_id", "flows"))
def source_activity_unbounded(spark, sf):
    found = activity.source_activity_unbounded(view(spark, sf, "flows"))
    return found.withColumn("ports", F.array_join(F.col("top_dst_ports").cast("array<string>"), "|")).drop("top_dst_ports")


def review_queue(spark, sf):
    """The routed reviews, stored once: ranking reads its input more than once."""
    routed = triage.prepare_flows(scored(spark, sf), worked_rules(spark))
    queue = routed.filter(F.col("route") == "tier1_llm").select("flow_id", "arrival", "ml_prob", "match", "route")
    return sinks.settle(queue, run_folder(spark, "queue"))


KEY = "CASE WHEN priority = 'priority_1' AND trigger_matched AND NOT context_only THEN 0 ELSE 1 END"


@query("review_priority", inputs.ansi(f"SELECT flow_id, row_number() OVER (ORDER BY {KEY}, -prob, arrival) AS review_rank FROM routed WHERE route = 'tier1_llm'", "flows", extra=R))
def review_priority(spark, sf):
    return verdicts.review_priority(review_queue(spark, sf)).select("flow_id", "review_rank")


@query("review_budget", inputs.ansi(f"SELECT flow_id, rk <= 500 AS judged, CASE WHEN rk > 500 THEN 'Tier 1 max calls per run reached (500).' END AS fallback_reason FROM (SELECT flow_id, row_number() OVER (ORDER BY {KEY}, -prob, arrival) AS rk FROM routed WHERE route = 'tier1_llm')", "flows", extra=R))
def review_budget(spark, sf):
    return verdicts.review_budget(review_queue(spark, sf), 500).select("flow_id", "judged", "fallback_reason")


SEV = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("top_alerts", inputs.ansi(f"SELECT flow_id, src_ip, dst_ip, dst_port, route, round(ml_prob, 6) AS ml_prob, coalesce(severity, 'unknown') AS severity FROM d WHERE verdict = 'alert' ORDER BY {SEV} DESC, coalesce(ml_prob, 0) DESC, coalesce(start_ms, 0), flow_id LIMIT 5", *STORE, extra=DAILY_SQL))
def top_alerts(spark, sf):
    return summary.top_alerts(daily(spark, sf)).select("flow_id", "src_ip", "dst_ip", "dst_port", "route", r6(F.col("ml_prob")).alias("ml_prob"), "severity")


def _reviewed(keys):
    return inputs.ansi(f"SELECT {keys}, count(*) AS count FROM d WHERE verdict IN ('alert', 'uncertain') GROUP BY {keys} ORDER BY count(*) DESC, min((coalesce(start_ms, 0), flow_id)) LIMIT 5", *STORE, extra=DAILY_SQL)


@query("top_review_sources", _reviewed("src_ip"))
def top_review_sources(spark, sf):
    return summary.top_review_sources(daily(spark, sf))


@query("top_target_assets", _reviewed("dst_ip, dst_port"))
def top_target_assets(spark, sf):
    return summary.top_target_assets(daily(spark, sf))


@query("recent_events", _ansi_ev(f"SELECT flow_id, {STATE_SQL} AS processing_state FROM ev {RECENT} LIMIT 500"))
def recent_events(spark, sf):
    return events.recent_events(event_frame(spark, sf), 9999).select("flow_id", "processing_state")


REPORT = "lower(verdict) = 'uncertain'"


@query("report_events", _ansi_ev(f"SELECT 'after' AS mode, flow_id FROM (SELECT * FROM ev WHERE {REPORT} {RECENT} LIMIT 250) WHERE {UTC_DAY} = DATE '2024-01-28' UNION ALL SELECT 'before', flow_id FROM (SELECT * FROM ev WHERE {REPORT} AND {UTC_DAY} = DATE '2024-01-28' {RECENT} LIMIT 250)"))
def report_events(spark, sf):
    """The date filter after the limit (the default) and before it."""
    rows = event_frame(spark, sf)
    run = lambda mode, push: events.report_events(rows, date="2024-01-28", verdict="uncertain", pushdown=push).select(F.lit(mode).alias("mode"), "flow_id")
    return run("after", False).unionByName(run("before", True))


@query("page_events", _ansi_ev(f"SELECT flow_id FROM ev {RECENT} LIMIT 40 OFFSET 80"))
def page_events(spark, sf):
    return events.page_events(event_frame(spark, sf), 3, 40).select("flow_id")


@query("top_attributions", inputs.ansi("SELECT flow_id, string_agg(name, '|' ORDER BY a DESC, i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY a DESC, i) AS rn FROM (SELECT flow_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['IN_BYTES', 'IN_PKTS', 'OUT_BYTES', 'OUT_PKTS', 'MIN_TTL', 'MAX_TTL', 'FLOW_DURATION_MILLISECONDS']) AS name, abs(unnest([IN_BYTES - 5000, IN_PKTS, OUT_BYTES - 2000, OUT_PKTS, MIN_TTL, MAX_TTL, FLOW_DURATION_MILLISECONDS])) AS a FROM ml_features)) WHERE rn <= 5 GROUP BY flow_id", "ml_features"))
def top_attributions(spark, sf):
    parts = {"IN_BYTES": F.col("IN_BYTES") - 5000, "IN_PKTS": F.col("IN_PKTS"), "OUT_BYTES": F.col("OUT_BYTES") - 2000, "OUT_PKTS": F.col("OUT_PKTS"), "MIN_TTL": F.col("MIN_TTL"), "MAX_TTL": F.col("MAX_TTL"), "FLOW_DURATION_MILLISECONDS": F.col("FLOW_DURATION_MILLISECONDS")}
    given = F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("contribution")) for n, v in parts.items()])
    top = F.transform(routing.top_attributions(given), lambda x: x["feature"])
    return view(spark, sf, "ml_features").select("flow_id", joined(top).alias("top"))


@query("quota_sample", inputs.ansi(
    """SELECT label, attack, port, n_found, shortfall, first_ids FROM (SELECT q.*, coalesce(n, 0) AS n_found, greatest(0, quota - coalesce(n, 0)) AS shortfall, coalesce(ids, '') AS first_ids FROM quotas q LEFT JOIN
    (SELECT label, attack, port, count(*) AS n, string_agg(CAST(source_index AS VARCHAR), '|' ORDER BY source_index) AS ids FROM (SELECT m.*, quota, row_number() OVER (PARTITION BY m.label, m.attack, m.port ORDER BY source_index) AS rn
      FROM (SELECT label, attack, output_dst_port AS port, source_index FROM manifest) m JOIN quotas qq ON qq.label = m.label AND qq.attack = m.attack AND qq.port = m.port) WHERE rn <= quota GROUP BY ALL) s USING (label, attack, port))""",
    "manifest", extra={"quotas": "SELECT label, attack, output_dst_port AS port, 3 + CAST(count(*) % 40 AS INT) AS quota FROM manifest GROUP BY ALL"}))
def quota_sample(spark, sf):
    from netsift.operators import sampling

    rows = view(spark, sf, "manifest").withColumnRenamed("output_dst_port", "port")
    quotas = rows.groupBy("label", "attack", "port").agg((F.lit(3) + (F.count("*") % 40)).cast("int").alias("quota"))
    report = sampling.quota_report(sampling.quota_sample(rows, quotas, ["label", "attack", "port"], "source_index"), quotas, ["label", "attack", "port"], "source_index")
    return report.select("label", "attack", "port", "n_found", "shortfall", joined(F.col("ids")).alias("first_ids"))


SUMMARIES = {"sm": f"SELECT CAST(day AS VARCHAR) AS date, CASE WHEN count(*) FILTER (WHERE verdict = 'alert') > 0 OR count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'High Attention' WHEN count(*) FILTER (WHERE verdict = 'uncertain') > 0 OR count(fallback_source) > 0 THEN 'Needs Review' ELSE 'Quiet' END AS risk_label, count(*) AS flow_count, count(*) FILTER (WHERE {HIT}) AS watchlist_hit_count FROM d GROUP BY day"}


def summaries(spark, sf):
    return summary.daily_summary(daily(spark, sf), view(spark, sf, "calls"))


@query("summary_list", inputs.ansi("SELECT * FROM sm ORDER BY date DESC LIMIT 20", *STORE, extra={**DAILY_SQL, **SUMMARIES}))
def summary_list(spark, sf):
    return summary.list_summaries(summaries(spark, sf), limit=20)


@query("latest_summary", inputs.ansi("SELECT * FROM sm ORDER BY date DESC LIMIT 1", *STORE, extra={**DAILY_SQL, **SUMMARIES}))
def latest_summary(spark, sf):
    return summary.list_summaries(summaries(spark, sf), limit=1)


@query("list_summaries", inputs.ansi("SELECT * FROM sm WHERE date = '2024-01-11'", *STORE, extra={**DAILY_SQL, **SUMMARIES}))
def list_summaries(spark, sf):
    return summary.list_summaries(summaries(spark, sf), date="2024-01-11")


