"""Streaming forms, drained over the given tables in three time-ordered deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import events, matching, routing
from netsift.plans import inputs, triage
from netsift.plans.catalog import query
from netsift.plans.catalog.common import view, worked_rules
from netsift.plans.catalog.sqltext import ACTIVITY, route_ctes
from netsift.plans.catalog.windows import STATE_SQL, _ansi_ev
from netsift.session import run_folder
from netsift.sources import flows as flow_source
from netsift.streaming import ingest

THIRDS = [0, 1704931200000, 1705795200000, 1 << 62]  # 2024-01-11 and 2024-01-21, UTC


def drain(spark, sf, checkpoint, handle, *, name="flows", change=None, hold=None, shape=None, mode="append"):
    """Lands the flows as three deliveries in time order and drains the stream after each.

    ``hold`` keeps rows back until the last delivery; ``shape`` transforms the
    stream before it is handled.
    """
    folder = run_folder(spark, "landing")
    rows = view(spark, sf, "flows")
    if name != "flows":
        rows = view(spark, sf, name).join(rows.select("flow_id", "start_ms"), "flow_id")
    rows = change(rows) if change else rows
    for n, (lo, hi) in enumerate(zip(THIRDS, THIRDS[1:])):
        part = (F.col("start_ms") >= lo) & (F.col("start_ms") < hi)
        part = F.coalesce(part, F.lit(n == len(THIRDS) - 2))  # flows without a time come last
        if hold is not None:
            part = (part & ~hold) | (hold if n == len(THIRDS) - 2 else F.lit(False))
        rows.filter(part).write.mode("overwrite").parquet(f"{folder}/part={n}")
        stream = ingest.read_flow_files(spark, f"{folder}/*", rows.schema, 1_000_000)
        ingest.run_available(shape(stream) if shape else stream, checkpoint, handle, mode)


@query("stream_flows", inputs.ansi("SELECT flow_id, src_ip, dst_ip, dst_port, protocol FROM flows", "flows"))
def stream_flows(spark, sf):
    """JSON payload lines as a stream of files, normalised and stored."""
    base = run_folder(spark, "json")
    flow_source.to_json(view(spark, sf, "flows")).select("payload").write.text(f"{base}/in")
    ingest.run_available(
        ingest.read_json_files(spark, f"{base}/in", 100).filter(~F.col("rejected")), f"{base}/checkpoint",
        lambda batch, n: ingest.write_batch(batch.drop("payload", "rejected"), n, f"{base}/flows"),
    )
    return spark.read.parquet(f"{base}/flows").select("flow_id", "src_ip", "dst_ip", "dst_port", "protocol")


def _run_activity(spark, sf, then, minutes=180):
    base = run_folder(spark, "activity")
    handle = ingest.activity_batches(f"{base}/flows", minutes, then(base))
    drain(spark, sf, f"{base}/checkpoint", handle)
    return base


@query("stream_activity", inputs.ansi(ACTIVITY.format(ms=1440 * 60000), "flows"))
def stream_activity(spark, sf):
    """In-order input: the stream must give what the batch form gives."""
    columns = ["flow_id", "flow_count", "distinct_dst_count", "same_dst_count", "same_dst_port_count"]
    base = _run_activity(spark, sf, lambda b: lambda df, n: ingest.write_batch(df.select(*columns), n, f"{b}/out"), 1440)
    return ingest.current(spark.read.parquet(f"{base}/out"), "flow_id").select(*columns)


@query("stream_triage", inputs.ansi("SELECT route, verdict, strength AS match_strength, count(*) AS n FROM events_out GROUP BY ALL", "flows", extra=route_ctes()))
def stream_triage(spark, sf):
    rules = worked_rules(spark)

    def then(base):
        def handle(active, n):
            scored = active.withColumns({"ml_prob": F.col("mock_prob"), "recent_alert_count": F.lit(0)})
            routed = routing.route_flows(matching.match_watchlist(scored, rules))
            judged = triage.judge_rows(routing.enrich_inline(routed))
            ingest.write_batch(triage.flat_events(judged), n, f"{base}/events")

        return handle

    base = _run_activity(spark, sf, then)
    stored = ingest.current(spark.read.parquet(f"{base}/events"), "flow_id")
    return stored.groupBy("route", "verdict", F.col("watchlist_match_strength").alias("match_strength")).agg(F.count("*").alias("n"))


LATE = f"arrival % 50 = 0 AND start_ms < {THIRDS[2]}"


@query("late_flows", inputs.ansi(f"SELECT flow_id FROM flows WHERE {LATE} AND start_ms < (SELECT max(start_ms) FROM flows WHERE start_ms < {THIRDS[2]} AND arrival % 50 <> 0) - 3600000", "flows"))
def late_flows(spark, sf):
    """Some early flows land with the last file: they go to the side table, and count for what follows."""
    base = run_folder(spark, "late")
    handle = ingest.activity_batches(f"{base}/flows", 60, lambda df, n: None, lateness_minutes=60, late_path=f"{base}/late")
    drain(spark, sf, f"{base}/checkpoint", handle, hold=F.expr(LATE))
    return spark.read.parquet(f"{base}/late").select("flow_id")


@query("stream_upsert", _ansi_ev(f"SELECT {STATE_SQL} AS processing_state, count(*) AS n FROM ev GROUP BY ALL"))
def stream_upsert(spark, sf):
    """Flows and routes become visible first, verdicts later; the view shows the state in between."""
    base = run_folder(spark, "upsert")
    for name in ("flows", "routes", "verdicts"):
        store = lambda batch, n, name=name: ingest.write_batch(batch, n, f"{base}/{name}")
        drain(spark, sf, f"{base}/checkpoint-{name}", store, name=name)
    log = lambda name: ingest.current(spark.read.parquet(f"{base}/{name}"), "flow_id")
    flows = view(spark, sf, "flows_nulls")
    table = events.assemble(flows, view(spark, sf, "ml_results"), log("routes").drop("start_ms"), log("verdicts").drop("start_ms"))
    return events.with_state(table).groupBy("processing_state").agg(F.count("*").alias("n"))


@query("stream_dedup", inputs.ansi("SELECT flow_id, CASE WHEN arrival % 4 = 0 THEN '10.9.9.9' ELSE src_ip END AS src_ip, 1 AS copies FROM flows", "flows"))
def stream_dedup(spark, sf):
    """Re-sent flows: exact copies are dropped on the stream, changed ones replace the row by key."""
    base = run_folder(spark, "dedup")
    twice = lambda rows: rows.unionByName(rows.filter(F.col("arrival") % 3 == 0))
    store = lambda batch, n: ingest.write_batch(batch, n, f"{base}/flows")
    drain(spark, sf, f"{base}/checkpoint-1", store, change=twice, shape=ingest.drop_resent)
    changed = lambda rows: rows.filter(F.col("arrival") % 4 == 0).withColumn("src_ip", F.lit("10.9.9.9"))
    later = lambda batch, n: ingest.write_batch(batch, 1000 + n, f"{base}/flows")
    drain(spark, sf, f"{base}/checkpoint-2", later, change=changed)
    log = spark.read.parquet(f"{base}/flows")
    first = log.filter(F.col("batch_id") < 1000).groupBy("flow_id").agg(F.count("*").cast("int").alias("copies"))
    return ingest.current(log, "flow_id").select("flow_id", "src_ip").join(first, "flow_id")


@query("stream_daily_counts", inputs.ansi("SELECT (start_ms + 32400000) // 86400000 * 86400000 - 32400000 AS day_ms, route AS value, count(*) AS n FROM flows f JOIN routes r ON r.flow_id = f.flow_id GROUP BY ALL", "flows", "routes"))
def stream_daily_counts(spark, sf):
    base = run_folder(spark, "daily-counts")
    replace = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/counts")
    drain(spark, sf, f"{base}/checkpoint", replace, name="routes", shape=ingest.daily_counts, mode="complete")
    return spark.read.parquet(f"{base}/counts").select("day_ms", "value", "n")


