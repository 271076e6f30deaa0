"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import curation, summary
from netsift.operators import tables as T
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.aggregates import DAILY_SQL, STORE, daily
from netsift.plans.catalog.common import joined, r6, view
from netsift.session import run_folder
from netsift.sources import context as ctx
from netsift.sources import flows as flow_source
from netsift.sources import sinks


def csv_columns(spark, sf):
    """Flows as the text columns of a CSV file, some ids and ports empty."""
    f = view(spark, sf, "flows").join(view(spark, sf, "ml_features").select("flow_id", "IN_BYTES", "MIN_TTL"), "flow_id")
    gap = F.col("arrival") % 10 == 0
    return f.select(
        "arrival", F.when(gap, "").otherwise(F.col("flow_id")).alias("flow_id"), F.col("start_ms").cast("string").alias("FLOW_START_MILLISECONDS"),
        F.when(gap, "").otherwise(F.col("end_ms").cast("string")).alias("FLOW_END_MILLISECONDS"), F.col("src_ip").alias("IPV4_SRC_ADDR"),
        F.col("dst_ip").alias("IPV4_DST_ADDR"), F.when(gap, "").otherwise(F.concat(F.col("src_port").cast("string"), F.lit(".0"))).alias("L4_SRC_PORT"),
        F.col("dst_port").cast("string").alias("L4_DST_PORT"), F.col("protocol").alias("PROTOCOL"), "IN_BYTES", "MIN_TTL",
        F.col("raw_label").alias("Label"), F.when(gap, "").otherwise(F.col("raw_attack")).alias("Attack"),
    )


@query("scan_flows", inputs.ansi(
    """SELECT f.flow_id AS was, CASE WHEN arrival % 10 = 0 THEN 'generated' ELSE f.flow_id END AS flow_id, start_ms, CASE WHEN arrival % 10 = 0 THEN 'none' ELSE CAST(end_ms AS VARCHAR) END AS end_ms, src_ip,
    CASE WHEN arrival % 10 = 0 THEN 0 ELSE src_port END AS src_port, dst_port, CAST(IN_BYTES AS VARCHAR) AS in_bytes, 3 AS n_features, raw_label, CASE WHEN arrival % 10 = 0 THEN 'none' ELSE raw_attack END AS raw_attack
    FROM flows f JOIN ml_features m ON m.flow_id = f.flow_id""".replace("arrival %", "f.arrival %"), "flows", "ml_features"))
def scan_flows(spark, sf):
    """CSV files with a header: written out, then scanned with the flow reader."""
    raw = csv_columns(spark, sf)
    folder = run_folder(spark, "flow-csv")
    original = F.concat(F.lit("flow-"), F.lpad(F.col("arrival").cast("string"), 8, "0"))
    sinks.write_csv(raw.withColumn("original", original).drop("arrival"), folder)
    names = [c for c in raw.columns if c != "arrival"] + ["original"]
    flows = flow_source.read_csv(spark, folder, names)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    generated = F.col("flow_id").rlike("^flow-[0-9A-F]{1,16}$") & (F.col("flow_id") != F.try_element_at("features", F.lit("original")))
    return flows.select(
        F.try_element_at("features", F.lit("original")).alias("was"), F.when(generated, "generated").otherwise(F.col("flow_id")).alias("flow_id"), "start_ms", text("end_ms").alias("end_ms"),
        "src_ip", "src_port", "dst_port", F.try_element_at("features", F.lit("IN_BYTES")).alias("in_bytes"), F.size("features").alias("n_features"), "raw_label", text("raw_attack").alias("raw_attack"),
    )


def payloads(spark, sf):
    """JSON payloads in both naming schemes, some without id."""
    f = view(spark, sf, "flows")
    short = F.to_json(F.struct("flow_id", "start_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.create_map(F.lit("a"), F.lit("1"), F.lit("x"), F.lit("kept")).alias("features"), F.lit("lost").alias("x"), F.lit(9).alias("y")))
    long = F.to_json(F.struct(F.col("flow_id").alias("id"), F.col("start_ms").alias("FLOW_START_MILLISECONDS"), F.col("src_ip").alias("IPV4_SRC_ADDR"), F.col("dst_ip").alias("IPV4_DST_ADDR"), F.col("dst_port").cast("string").alias("L4_DST_PORT"), F.col("protocol").alias("PROTOCOL"), F.col("raw_label").alias("Label")))
    no_id = F.to_json(F.struct("src_ip", "dst_port"))
    kind = F.col("arrival") % 3
    return f.select("arrival", F.when(kind == 0, short).when(kind == 1, long).otherwise(no_id).alias("payload"))


@query("normalize_flow_json", inputs.ansi(
    """SELECT arrival, CASE WHEN arrival % 3 = 2 THEN '' ELSE flow_id END AS flow_id, CASE WHEN arrival % 3 = 2 THEN 'none' ELSE CAST(start_ms AS VARCHAR) END AS start_ms, src_ip, CASE WHEN arrival % 3 = 2 THEN '' ELSE dst_ip END AS dst_ip, CASE WHEN arrival % 3 = 0 THEN src_port ELSE 0 END AS src_port, dst_port,
    CASE WHEN arrival % 3 = 2 THEN '' ELSE protocol END AS protocol, CASE WHEN arrival % 3 = 0 THEN 'kept|9' ELSE '' END AS extras, CASE WHEN arrival % 3 = 1 THEN raw_label ELSE 'none' END AS raw_label, arrival % 3 = 2 AS rejected FROM flows""", "flows"))
def normalize_flow_json(spark, sf):
    rows = flow_source.normalize_json(payloads(spark, sf))
    get = lambda n: F.try_element_at("features", F.lit(n))
    return rows.select("arrival", "flow_id", F.coalesce(F.col("start_ms").cast("string"), F.lit("none")).alias("start_ms"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.concat_ws("|", get("x"), get("y")).alias("extras"), F.coalesce("raw_label", F.lit("none")).alias("raw_label"), "rejected")


@query("flow_to_json", inputs.ansi("SELECT flow_id, '{\"flow_id\":\"' || flow_id || '\",\"start_ms\":' || start_ms || ',\"end_ms\":' || end_ms || ',\"src_ip\":\"' || src_ip || '\",\"dst_ip\":\"' || dst_ip || '\",\"src_port\":' || src_port || ',\"dst_port\":' || dst_port || ',\"protocol\":\"' || protocol || '\",\"raw_label\":\"' || raw_label || '\",\"raw_attack\":\"' || raw_attack || '\"}' AS payload FROM flows", "flows"))
def flow_to_json(spark, sf):
    return flow_source.to_json(view(spark, sf, "flows"))


@query("ml_dataset_scan", inputs.ansi("SELECT Label AS label, count(*) AS n, CAST(sum(IN_BYTES) AS BIGINT) AS in_bytes, max(FLOW_START_MILLISECONDS) AS latest FROM ml_features GROUP BY Label", "ml_features"))
def ml_dataset_scan(spark, sf):
    """Only the named columns are read; text that is no number fails the job."""
    rows = view(spark, sf, "ml_features").select("Label", F.col("IN_BYTES").cast("string").cast("bigint").alias("IN_BYTES"), "FLOW_START_MILLISECONDS")
    return rows.groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("n"), F.sum("IN_BYTES").alias("in_bytes"), F.max("FLOW_START_MILLISECONDS").alias("latest"))


# A second batch of the same keys: some flows sent again, one of them twice.
RESENT = "arrival % 5 = 0"


def resent(spark, sf, name, change):
    base = view(spark, sf, name).join(view(spark, sf, "flows").select("flow_id", F.col("arrival").alias("a")), "flow_id")
    new = base.filter(F.col("a") % 5 == 0).withColumns(change)
    again = new.filter(F.col("a") % 25 == 0)
    old = base.withColumn("seq", F.lit(0))
    return old, new.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))


@query("upsert_flows", inputs.ansi(f"SELECT flow_id, CASE WHEN {RESENT} THEN '10.9.9.9' ELSE src_ip END AS src_ip, CASE WHEN arrival % 25 = 0 THEN 2 WHEN {RESENT} THEN 1 ELSE 0 END AS seq FROM flows", "flows"))
def upsert_flows(spark, sf):
    old, new = resent(spark, sf, "flows", {"src_ip": F.lit("10.9.9.9")})
    return T.upsert(old, new, "flow_id", ["seq"]).select("flow_id", "src_ip", "seq")


@query("upsert_routes", inputs.ansi(f"SELECT r.flow_id, CASE WHEN {RESENT} THEN 'auto_alert' ELSE route END AS route FROM routes r JOIN flows f ON f.flow_id = r.flow_id", "routes", "flows"))
def upsert_routes(spark, sf):
    old, new = resent(spark, sf, "routes", {"route": F.lit("auto_alert")})
    return T.upsert(old, new, "flow_id", ["seq"]).select("flow_id", "route")


@query("upsert_verdicts", inputs.ansi(f"SELECT r.flow_id, CASE WHEN {RESENT} THEN 'alert' ELSE verdict END AS verdict FROM verdicts r JOIN flows f ON f.flow_id = r.flow_id", "verdicts", "flows"))
def upsert_verdicts(spark, sf):
    old, new = resent(spark, sf, "verdicts", {"verdict": F.lit("alert")})
    return T.upsert(old, new, "flow_id", ["seq"]).select("flow_id", "verdict")


@query("replace_ml_results", inputs.ansi("SELECT m.flow_id, CASE WHEN f.arrival % 4 = 0 THEN 1e0 ELSE round(m.prob, 6) END AS prob FROM ml_results m JOIN flows f ON f.flow_id = m.flow_id", "ml_results", "flows"))
def replace_ml_results(spark, sf):
    old = view(spark, sf, "ml_results").select("flow_id", r6(F.col("prob")).alias("prob"))
    ids = view(spark, sf, "flows").filter(F.col("arrival") % 4 == 0).select("flow_id")
    new = old.join(ids, "flow_id", "left_semi").withColumn("prob", F.lit(1.0))
    return T.replace_rows(old, new, "flow_id")


@query("append_model_calls", inputs.ansi("SELECT flow_id, count(*) AS calls, max(call_id) AS last_call FROM calls GROUP BY flow_id", "calls"))
def append_model_calls(spark, sf):
    log = T.append_rows(view(spark, sf, "calls_first"), view(spark, sf, "calls_second"))
    return log.groupBy("flow_id").agg(F.count("*").alias("calls"), F.max("call_id").alias("last_call"))


@query("evolve_schema", inputs.ansi("SELECT flow_id, call_id, CASE WHEN call_id % 2 = 1 THEN CAST(prompt_tokens AS VARCHAR) ELSE 'absent' END AS prompt_tokens FROM calls", "calls"))
def evolve_schema(spark, sf):
    old = view(spark, sf, "calls_first").drop("prompt_tokens", "completion_tokens")
    return T.evolve(old, view(spark, sf, "calls_second")).select("flow_id", "call_id", F.coalesce(F.col("prompt_tokens").cast("string"), F.lit("absent")).alias("prompt_tokens"))


SOURCE_ROWS = {
    "rows_by_source": """SELECT 'assets' AS source, 'assets' AS list_key, seq AS pos, ip, role IS NOT NULL AS valid FROM assets UNION ALL SELECT 'assets', 'trust_zones', zone_seq, NULL, cidr <> 'not-a-range' FROM zones
      UNION ALL SELECT 'cve_feed', 'advisories', seq, NULL, true FROM advisories UNION ALL SELECT 'threat_feed', 'known_malicious_ips', seq, ip, true FROM indicators UNION ALL SELECT 'threat_feed', 'suspicious_patterns', seq, NULL, true FROM patterns"""
}


def source_rows(spark, sf):
    part = lambda name, source, key, pos, ip, valid: view(spark, sf, name).select(F.lit(source).alias("source"), F.lit(key).alias("list_key"), F.col(pos).cast("bigint").alias("pos"), ip.cast("string").alias("ip"), valid.alias("valid"))
    none, yes = F.lit(None), F.lit(True)
    return (
        part("assets", "assets", "assets", "seq", F.col("ip"), F.col("role").isNotNull())
        .unionByName(part("zones", "assets", "trust_zones", "zone_seq", none, F.col("cidr") != "not-a-range"))
        .unionByName(part("advisories", "cve_feed", "advisories", "seq", none, yes))
        .unionByName(part("indicators", "threat_feed", "known_malicious_ips", "seq", F.col("ip"), yes))
        .unionByName(part("patterns", "threat_feed", "suspicious_patterns", "seq", none, yes))
    )


STATUS_SQL = """SELECT 'assets' AS name, 'error' AS status, 0 AS item_count, 'trust_zones[9] must be a dictionary.' AS error UNION ALL SELECT 'cve_feed', 'used', count(*), '' FROM rows_by_source WHERE source = 'cve_feed' UNION ALL
  SELECT 'threat_feed', 'used', count(*), '' FROM rows_by_source WHERE source = 'threat_feed' UNION ALL SELECT 'policy', 'missing', 0, '' UNION ALL SELECT 'organization', 'disabled', 0, ''"""


@query("load_context_sources", inputs.ansi(STATUS_SQL, "assets", "zones", "advisories", "indicators", "patterns", extra=SOURCE_ROWS))
def load_context_sources(spark, sf):
    return ctx.source_status(source_rows(spark, sf), SETTINGS)


SETTINGS = {"organization": False, "assets": True, "policy": True, "cve_feed": True, "threat_feed": True}


@query("context_status", inputs.ansi(f"SELECT name, status, item_count FROM ({STATUS_SQL}) UNION ALL SELECT 'tier1_db', 'used', count(*) FROM verdicts", "assets", "zones", "advisories", "indicators", "patterns", "verdicts", extra=SOURCE_ROWS))
def context_status(spark, sf):
    return ctx.with_history(load_context_sources(spark, sf), view(spark, sf, "verdicts")).select("name", "status", "item_count")


@query("source_status_counts", inputs.ansi(f"SELECT status, count(*) AS n FROM (SELECT status FROM ({STATUS_SQL}) UNION ALL SELECT 'used') GROUP BY status", "assets", "zones", "advisories", "indicators", "patterns", extra=SOURCE_ROWS))
def source_status_counts(spark, sf):
    return context_status(spark, sf).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def _content_sql(source: str, *lists: str) -> str:
    """The first 6,000 characters of a source's rows as JSON without nulls, in reading order."""
    rows = " UNION ALL ".join(
        f"SELECT {k} AS part, seq, CAST(json_merge_patch('{{}}', to_json(x)) AS VARCHAR) AS c FROM {name} x" for k, name in enumerate(lists)
    )
    return f"SELECT '{source}' AS name, string_agg(c, chr(10) ORDER BY part, seq, c) AS t FROM ({rows})"


CONTENT_SQL = f"{_content_sql('cve_feed', 'advisories')} UNION ALL {_content_sql('threat_feed', 'indicators', 'patterns')}"


@query("curation_payload", inputs.ansi(
    f"""SELECT '2024-01-31' AS cycle_id, s.*, CASE WHEN t IS NULL THEN '' WHEN length(t) <= 6000 THEN t ELSE left(t, 6000) || chr(10) || '... [truncated]' END AS content
    FROM ({STATUS_SQL}) s LEFT JOIN ({CONTENT_SQL}) c USING (name)""", "assets", "zones", "advisories", "indicators", "patterns", extra=SOURCE_ROWS))
def curation_payload(spark, sf):
    """The status of every context source, and the cut content of the used ones; assets have an error, so none of theirs."""
    lists = [("assets", "seq", "assets"), ("assets", "zone_seq", "zones"), ("cve_feed", "seq", "advisories"), ("threat_feed", "seq", "indicators"), ("threat_feed", "seq", "patterns")]
    rows = curation.source_table([(source, key, view(spark, sf, name)) for source, key, name in lists])
    return curation.curation_payload(rows, load_context_sources(spark, sf), "2024-01-31")


@query("clean_context_rows", inputs.ansi("SELECT seq, coalesce(nullif(policy_rule, ''), 'none') AS rule, CASE WHEN services_text = '' THEN 'none' ELSE array_to_string(list_filter(list_transform(string_split(services_text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') END AS services FROM assets", "assets"))
def clean_context_rows(spark, sf):
    rows = T.clean_rows(view(spark, sf, "assets"), ["services_text"])
    return rows.select("seq", F.coalesce("policy_rule", F.lit("none")).alias("rule"), F.coalesce(joined(F.col("services_text")), F.lit("none")).alias("services"))


@query("edit_context", inputs.ansi(
    """SELECT source, list_key, pos, coalesce(ip, 'none') AS ip FROM (SELECT source, list_key, CASE WHEN list_key = 'advisories' AND pos > 5 THEN pos - 1 ELSE pos END AS pos, ip FROM rows_by_source WHERE NOT (list_key = 'advisories' AND pos = 5)
    UNION ALL SELECT 'threat_feed', 'known_malicious_ips', (SELECT max(seq) FROM indicators) + row_number() OVER (ORDER BY seq), ip FROM assets WHERE seq % 2 = 0
    UNION ALL SELECT 'threat_feed', 'suspicious_patterns', (SELECT max(seq) FROM patterns) + row_number() OVER (ORDER BY seq), '' FROM assets WHERE seq % 2 = 1)""",
    "assets", "zones", "advisories", "indicators", "patterns", extra=SOURCE_ROWS))
def edit_context(spark, sf):
    """New threat rows go to the list their fields call for; one advisory is deleted by position."""
    rows = source_rows(spark, sf)
    new = view(spark, sf, "assets").select(F.lit("threat_feed").alias("source"), F.when(F.col("seq") % 2 == 0, F.col("ip")).otherwise("").alias("ip"), F.lit(True).alias("valid"), F.col("seq").alias("new_seq"))
    edited = T.delete_context(T.append_context(rows, new), "cve_feed", "advisories", 5)
    return edited.select("source", "list_key", F.col("pos").cast("bigint").alias("pos"), F.coalesce("ip", F.lit("none")).alias("ip"))


@query("overlay_context", inputs.ansi(
    """SELECT day, seq, CASE WHEN seq % 3 = 0 AND day >= 4 THEN 'critical' ELSE criticality END AS criticality FROM (SELECT unnest([1, 2, 3, 4, 5]) AS day, * FROM assets) WHERE seq % 2 = 0 OR (seq % 4 = 1 AND day >= 3) OR (seq % 4 = 3 AND day >= 5)""", "assets"))
def overlay_context(spark, sf):
    """Five daily versions: even assets from day 1, the others from day 3 or 5, an update from day 4."""
    rows = view(spark, sf, "assets").select("seq", "ip", "criticality")
    base = rows.filter(F.col("seq") % 2 == 0)
    additions = rows.filter(F.col("seq") % 2 == 1).withColumn("from_day", F.when(F.col("seq") % 4 == 1, 3).otherwise(5))
    updates = rows.filter(F.col("seq") % 3 == 0).select("ip", F.lit(4).alias("from_day"), F.lit("critical").alias("criticality"))
    return T.apply_updates(T.overlay(base, additions, 5), updates, "ip", ["criticality"]).select("day", "seq", "criticality")


@query("split_local_days", inputs.ansi("SELECT CAST(CAST('1970-01-01' AS DATE) + CAST(floor((start_ms + 32400000) / 86400000.0) AS INT) AS VARCHAR) AS day, count(*) AS n, min(flow_id) AS first_id FROM flows GROUP BY ALL", "flows"))
def split_local_days(spark, sf):
    """Written as one folder per local day, and counted from there."""
    folder = run_folder(spark, "local-days")
    flow_source.split_local_days(view(spark, sf, "flows"), folder)
    stored = spark.read.parquet(folder)
    return stored.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.min("flow_id").alias("first_id"))


@query("write_cycle_artifacts", inputs.ansi("SELECT seq, ip, '2024-02-01' AS cycle_id FROM assets WHERE criticality = 'critical'", "assets"))
def write_cycle_artifacts(spark, sf):
    """Two cycles are stored; the latest view shows the second."""
    folder = run_folder(spark, "cycles")
    rows = view(spark, sf, "assets").select("seq", "ip", "criticality")
    sinks.write_cycle(rows, folder, "2024-01-31")
    sinks.write_cycle(rows.filter(F.col("criticality") == "critical"), folder, "2024-02-01")
    return sinks.latest_cycle(spark, folder).select("seq", "ip", F.col("cycle_id").cast("string").alias("cycle_id"))


@query("write_daily_summary", inputs.ansi("SELECT CAST(day AS VARCHAR) AS date, count(*) AS flow_count FROM d GROUP BY day", *STORE, extra=DAILY_SQL))
def write_daily_summary(spark, sf):
    """Daily summaries as JSON, one folder per date, read back."""
    folder = run_folder(spark, "daily")
    sinks.write_daily_summary(summary.daily_summary(daily(spark, sf), view(spark, sf, "calls")), folder)
    return spark.read.json(folder).select(F.col("date").cast("string").alias("date"), "flow_count")


