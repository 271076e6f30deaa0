"""Projections and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import net, timefn
from netsift.functions import scalars as S
from netsift.operators import events
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.aggregates import EVENTS_SQL, STATE_SQL, STORE, UTC_DAY
from netsift.plans.catalog.common import event_frame, joined, view
from netsift.plans.catalog.sqltext import IPV4, between_cidr, ip_int

# Addresses of many kinds, taken from the flow and customer tables.
ODD_IP = (
    "CASE event_id % 9 WHEN 0 THEN '10.1.' || (event_id % 300) || '.7' WHEN 1 THEN '172.' || (14 + event_id % 20) || '.0.1' WHEN 2 THEN '192.168.1.' || (event_id % 256) "
    "WHEN 3 THEN '169.254.1.' || (event_id % 256) WHEN 4 THEN 'fd00::' || (event_id % 90) WHEN 5 THEN 'fe80::1' WHEN 6 THEN '2001:db8::' || (event_id % 90) WHEN 7 THEN 'host-' || event_id ELSE '8.8.8.' || (event_id % 256) END"
)
ODD_SQL = {"odd": f"SELECT event_id, {ODD_IP} AS ip, user_id, value, event_type, ts FROM events"}


def odd(spark, sf):
    return inputs.table(spark, sf, "events").selectExpr("event_id", f"{ODD_IP} AS ip", "user_id", "value", "event_type", "ts")


@query("ip_to_int", inputs.ansi(f"SELECT event_id, {ip_int('ip')} AS n FROM odd", extra=ODD_SQL))
def ip_to_int(spark, sf):
    return odd(spark, sf).select("event_id", net.ip_to_int(F.col("ip")).alias("n"))


@query("ip_in_cidrs", inputs.ansi(f"SELECT event_id, {between_cidr('ip', '10.1.0.0/17', '172.16.5.4/12', '8.8.8.128/25')} OR ip LIKE 'fd00::%' AS inside FROM odd", extra=ODD_SQL))
def ip_in_cidrs(spark, sf):
    ranges = ["10.1.0.0/17", "172.16.5.4/12", "8.8.8.128/25", "not-a-range", "fd00::/16"]
    return odd(spark, sf).select("event_id", net.in_cidrs(F.col("ip"), ranges).alias("inside"))


PRIVATE = between_cidr("ip", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")


@query("is_internal", inputs.ansi(f"SELECT event_id, {PRIVATE} OR {between_cidr('ip', '169.254.0.0/16')} AS internal FROM odd", extra=ODD_SQL))
def is_internal(spark, sf):
    return odd(spark, sf).select("event_id", net.is_internal(F.col("ip")).alias("internal"))


@query("is_private_or_local", inputs.ansi(f"SELECT event_id, {PRIVATE} OR ip LIKE 'fd00:%' OR ip LIKE 'fe80:%' AS private FROM odd", extra=ODD_SQL))
def is_private_or_local(spark, sf):
    return odd(spark, sf).select("event_id", net.is_private_or_local(F.col("ip")).alias("private"))


@query("fallback_zone", inputs.ansi(f"SELECT event_id, CASE WHEN NOT (regexp_matches(ip, '{IPV4}') OR ip LIKE '%:%') THEN 'unknown' WHEN {PRIVATE} OR ip LIKE 'fd00:%' OR ip LIKE 'fe80:%' THEN 'internal-unknown' ELSE 'external-unknown' END AS zone FROM odd", extra=ODD_SQL))
def fallback_zone(spark, sf):
    return odd(spark, sf).select("event_id", net.fallback_zone(F.col("ip")).alias("zone"))


INT = lambda c: between_cidr(c, "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")


@query("flow_direction", inputs.ansi(
    f"""SELECT f.flow_id, CASE WHEN {INT('src_ip')} THEN 'internal' ELSE 'external' END || '_to_' || CASE WHEN {INT('dst_ip')} THEN 'internal' ELSE 'external' END AS direction, r.ml_prob < r.threshold_low AS below_band
    FROM flows f JOIN routes r ON r.flow_id = f.flow_id""", "flows", "routes"))
def flow_direction(spark, sf):
    rows = view(spark, sf, "flows").join(view(spark, sf, "routes"), "flow_id")
    return rows.select("flow_id", net.flow_direction(F.col("src_ip"), F.col("dst_ip")).alias("direction"), (F.col("ml_prob") < F.col("threshold_low")).alias("below_band"))


PROTO = "CASE event_id % 6 WHEN 0 THEN ' TCP' WHEN 1 THEN '17' WHEN 2 THEN '' WHEN 3 THEN 'udp ' WHEN 4 THEN 'ICMP' ELSE '6' END"


@query("protocol_name", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'unknown' WHEN 3 THEN 'udp' WHEN 4 THEN 'icmp' ELSE 'tcp' END AS name FROM events")
def protocol_name(spark, sf):
    return inputs.table(spark, sf, "events").selectExpr("event_id", f"{PROTO} AS p").select("event_id", S.protocol_name(F.col("p")).alias("name"))


@query("service_guess", inputs.ansi("SELECT flow_id, CASE dst_port WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 445 THEN 'smb' WHEN 5432 THEN 'postgres' WHEN 8080 THEN 'http-alt' WHEN 8443 THEN 'https-alt' ELSE 'unknown' END AS service, 'unknown' AS src_service FROM flows", "flows"))
def service_guess(spark, sf):
    return view(spark, sf, "flows").select("flow_id", S.service_guess(F.col("dst_port")).alias("service"), S.service_guess(F.col("src_port")).alias("src_service"))


@query("service_ports", inputs.ansi("SELECT seq, CASE WHEN services_text LIKE 'https, http%' THEN '80|443' WHEN services_text LIKE 'ssh%' THEN '22' WHEN services_text LIKE 'dns%' THEN '53' WHEN services_text = 'https' THEN '443' ELSE '' END AS ports FROM assets", "assets"))
def service_ports(spark, sf):
    services = F.coalesce(S.split_list(F.col("services_text")), F.array().cast("array<string>"))
    return view(spark, sf, "assets").select("seq", joined(S.service_ports(services)).alias("ports"))


GROUP_CASE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(txt), '{t}')" for t in tokens) + f" THEN '{group}'" for group, tokens in K.GROUP_RULES
) + " ELSE 'other' END"


@query("classify_group", inputs.ansi(
    f"SELECT k, {GROUP_CASE} AS grp FROM (SELECT 'a' || seq AS k, coalesce(zone, '') || ' ' || role || ' ' || services_text AS txt FROM assets UNION ALL SELECT 'p' || p_partkey, p_name || ' ' || p_type || ' ' || p_brand FROM part UNION ALL SELECT 'd' || doc_id, text FROM documents)", "assets"))
def classify_group(spark, sf):
    text = lambda key, body: [key.alias("k"), S.classify_group(body).alias("grp")]
    k = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    assets = view(spark, sf, "assets").select(*text(k("a", "seq"), F.concat_ws(" ", F.coalesce("zone", F.lit("")), "role", "services_text")))
    parts = inputs.table(spark, sf, "part").select(*text(k("p", "p_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand")))
    documents = inputs.table(spark, sf, "documents").select(*text(k("d", "doc_id"), F.col("text")))
    return assets.unionByName(parts).unionByName(documents)


@query("attack_family", inputs.ansi(
    """SELECT flow_id, CASE WHEN raw_attack LIKE 'DDOS%' OR raw_attack LIKE 'DDoS%' THEN 'DDoS' WHEN raw_attack LIKE 'DoS%' THEN 'DoS' WHEN raw_attack IN ('FTP-BruteForce', 'SSH-Bruteforce') THEN 'BruteForce'
    WHEN raw_attack LIKE 'Brute_Force%' OR raw_attack = 'SQL_Injection' THEN 'WebAttack' WHEN raw_attack = 'Bot' THEN 'Bot' WHEN raw_attack = 'Infilteration' THEN 'Infiltration' END AS family FROM flows""", "flows"))
def attack_family(spark, sf):
    return view(spark, sf, "flows").select("flow_id", S.attack_family(F.col("raw_attack")).alias("family"))


FEATURES = ["L4_DST_PORT", "PROTOCOL", "TCP_FLAGS", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS", "MIN_TTL", "MAX_TTL"]


@query("feature_surface", inputs.ansi("SELECT m.flow_id, CAST(f.dst_port AS VARCHAR) AS port, f.protocol AS protocol, CAST(m.IN_BYTES AS VARCHAR) AS in_bytes, false AS has_src_port FROM ml_features m JOIN flows f ON f.flow_id = m.flow_id", "ml_features", "flows"))
def feature_surface(spark, sf):
    from netsift.operators import learning

    raw = view(spark, sf, "ml_features").select("flow_id", F.create_map(
        F.lit("IN_BYTES"), F.col("IN_BYTES").cast("string"), F.lit("L4_DST_PORT"), F.lit("0"), F.lit("L4_SRC_PORT"), F.lit("1")).alias("features"))
    surface = learning.feature_surface(raw.join(view(spark, sf, "flows"), "flow_id"))
    get = lambda name: F.try_element_at("surface", F.lit(name))
    return surface.select("flow_id", get("L4_DST_PORT").alias("port"), get("PROTOCOL").alias("protocol"), get("IN_BYTES").alias("in_bytes"), F.map_contains_key("surface", "L4_SRC_PORT").alias("has_src_port"))


@query("projection_flags", inputs.ansi(
    """SELECT flow_id, CASE WHEN p AND q THEN 'service port projected to regional-care topology; protocol projected to regional-care topology' WHEN p THEN 'service port projected to regional-care topology'
    WHEN q THEN 'protocol projected to regional-care topology' ELSE '' END AS reason FROM (SELECT flow_id, source_dst_port <> output_dst_port AS p, source_protocol <> output_protocol AS q FROM manifest)""", "manifest"))
def projection_flags(spark, sf):
    return view(spark, sf, "manifest").select("flow_id", S.projection_reason(*[F.col(c) for c in ("source_dst_port", "output_dst_port", "source_protocol", "output_protocol")]).alias("reason"))


DIRTY = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN '-1.5e3' WHEN 4 THEN 'Infinity' WHEN 5 THEN 'NaN' ELSE '80.0' END"


@query("has_ml_features", "SELECT event_id, event_id % 7 IN (3, 6) AS ok FROM events")
def has_ml_features(spark, sf):
    rows = inputs.table(spark, sf, "events").selectExpr("event_id", f"{DIRTY} AS a", "value AS b")
    return rows.select("event_id", S.has_features(["a", "b"]).alias("ok"))


@query("coerce_ints", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN -2 ELSE CAST(trunc(value) AS BIGINT) END AS n, CASE event_id % 5 WHEN 0 THEN '80' WHEN 1 THEN 'none' WHEN 2 THEN 'none' WHEN 3 THEN '-2' ELSE CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS optional FROM events")
def coerce_ints(spark, sf):
    text = "CASE event_id % 5 WHEN 0 THEN '80.0' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '-2.9' ELSE cast(value AS STRING) END AS t"
    rows = inputs.table(spark, sf, "events").selectExpr("event_id", text)
    optional = S.coerce_int(F.col("t"), None)
    return rows.select("event_id", S.coerce_int(F.col("t")).alias("n"), F.coalesce(optional.cast("string"), F.lit("none")).alias("optional"))


BAND = "CASE WHEN mock_prob < 0.04e0 THEN '<0.04' WHEN mock_prob < 0.08e0 THEN '0.04-0.08' WHEN mock_prob < 0.12e0 THEN '0.08-0.12' WHEN mock_prob < 0.2e0 THEN '0.12-0.20' WHEN mock_prob < 0.3e0 THEN '0.20-0.30' WHEN mock_prob < 0.95e0 THEN '0.30-0.95' ELSE '>=0.95' END"


@query("prob_band", inputs.ansi(f"SELECT flow_id, {BAND} AS band FROM flows", "flows"))
def prob_band(spark, sf):
    return view(spark, sf, "flows").select("flow_id", S.prob_band(F.col("mock_prob")).alias("band"))


@query("parse_flow_id", inputs.ansi("SELECT trace_id, 'd0' || day AS day, CASE WHEN label = 'Benign' THEN scenario ELSE 'unknown' END AS family FROM manifest", "manifest"))
def parse_flow_id(spark, sf):
    return view(spark, sf, "manifest").select("trace_id", S.day_of_id(F.col("trace_id")).alias("day"), S.family_of_id(F.col("trace_id")).alias("family"))


@query("filter_day_token", inputs.ansi("SELECT trace_id FROM manifest WHERE lower(trace_id) LIKE '%d03%'", "manifest"))
def filter_day_token(spark, sf):
    from netsift.sources import flows

    return flows.filter_day(view(spark, sf, "manifest"), 3, "trace_id").select("trace_id")


@query("countable", inputs.ansi("SELECT flow_id, coalesce(nullif(watchlist_matched, ''), 'unknown') AS w, coalesce(severity, 'unknown') AS s FROM verdicts", "verdicts"))
def countable(spark, sf):
    return view(spark, sf, "verdicts").select("flow_id", S.countable(F.col("watchlist_matched")).alias("w"), S.countable(F.col("severity")).alias("s"))


@query("local_day_window", inputs.ansi("SELECT flow_id FROM flows_nulls WHERE (start_ms >= 1704812400000 AND start_ms < 1704898800000) OR (start_ms IS NULL AND created_at >= TIMESTAMP '2024-01-09 15:00:00' AND created_at < TIMESTAMP '2024-01-10 15:00:00')", "flows_nulls"))
def local_day_window(spark, sf):
    rows = view(spark, sf, "flows_nulls")
    return rows.filter(timefn.in_local_day(F.col("start_ms"), F.col("created_at"), "2024-01-10")).select("flow_id")


@query("row_time", inputs.ansi("SELECT flow_id, CASE WHEN start_ms IS NOT NULL THEN strftime(make_timestamp(start_ms * 1000 + 32400000000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || '+09:00' ELSE 'arrival' END AS local FROM flows_nulls", "flows_nulls"))
def row_time(spark, sf):
    rows = view(spark, sf, "flows_nulls")
    local = timefn.row_time(F.col("start_ms"), F.col("created_at"))
    return rows.select("flow_id", F.when(F.col("start_ms").isNull() & local.startswith("2024-01"), "arrival").otherwise(local).alias("local"))


@query("event_date_utc", inputs.ansi(f"SELECT flow_id, CAST({UTC_DAY} AS VARCHAR) AS day FROM flows_nulls", "flows_nulls"))
def event_date_utc(spark, sf):
    return view(spark, sf, "flows_nulls").select("flow_id", timefn.event_date_utc(F.col("start_ms"), F.col("created_at")).alias("day"))


def _ansi_ev(body):
    return inputs.ansi(body, *STORE, extra=EVENTS_SQL)


@query("processing_state", _ansi_ev(f"SELECT flow_id, {STATE_SQL} AS processing_state, CASE WHEN verdict IS NULL AND route = 'tier1_llm' THEN 'processing' ELSE verdict END AS verdict, CASE WHEN verdict IS NULL AND route = 'tier1_llm' THEN 'pending' ELSE severity END AS severity FROM ev"))
def processing_state(spark, sf):
    return events.with_state(event_frame(spark, sf)).select("flow_id", "processing_state", "verdict", "severity")


@query("event_flags", _ansi_ev("SELECT flow_id, coalesce(verdict, '') = 'alert' OR coalesce(route, '') = 'auto_alert' OR coalesce(severity, '') IN ('high', 'critical') AS alert_event FROM ev"))
def event_flags(spark, sf):
    return event_frame(spark, sf).select("flow_id", S.alert_event(F.col("verdict"), F.col("route"), F.col("severity")).alias("alert_event"))


@query("hide_benign", _ansi_ev("SELECT flow_id FROM ev WHERE NOT (coalesce(verdict, '') = 'benign' OR coalesce(route, '') = 'auto_dismiss' OR coalesce(severity, '') = 'low')"))
def hide_benign(spark, sf):
    rows = event_frame(spark, sf)
    return rows.filter(~S.benign_event(F.col("verdict"), F.col("route"), F.col("severity"))).select("flow_id")


@query("trend_series", _ansi_ev("SELECT flow_id, CASE WHEN verdict = 'alert' OR route = 'auto_alert' THEN 'alert' WHEN verdict = 'uncertain' THEN 'uncertain' WHEN verdict = 'benign' OR route = 'auto_dismiss' THEN 'dismiss' END AS series FROM ev"))
def trend_series(spark, sf):
    return event_frame(spark, sf).select("flow_id", S.trend_series(F.col("verdict"), F.col("route")).alias("series"))


@query("report_filters", _ansi_ev("SELECT flow_id FROM ev WHERE lower(severity) = 'high' AND lower(verdict) = 'alert' AND (src_ip = '10.60.20.30' OR dst_ip = '10.60.20.30') AND (watchlist_matched IS NULL OR watchlist_matched = '')"))
def report_filters(spark, sf):
    test = events.report_predicates(severity="HIGH", verdict="Alert", asset="10.60.20.30", watchlist_hit=False)
    return event_frame(spark, sf).filter(test).select("flow_id")


@query("json_columns", inputs.ansi("SELECT flow_id, '{\"IN_BYTES\":\"' || IN_BYTES || '\",\"MIN_TTL\":\"' || MIN_TTL || '\"}' AS features_json, CAST(MIN_TTL AS VARCHAR) AS back, 0 AS broken_size FROM ml_features", "ml_features"))
def json_columns(spark, sf):
    rows = view(spark, sf, "ml_features")
    features = F.create_map(F.lit("MIN_TTL"), F.col("MIN_TTL").cast("string"), F.lit("IN_BYTES"), F.col("IN_BYTES").cast("string"))
    text = S.features_to_json(features)
    return rows.select("flow_id", text.alias("features_json")).withColumns(
        {
            "back": F.try_element_at(S.features_from_json(F.col("features_json")), F.lit("MIN_TTL")),
            "broken_size": F.size(S.features_from_json(F.concat(F.lit("not json "), F.col("features_json")))),
        }
    )


@query("safe_id", "SELECT conv_id, turn, coalesce(nullif(left(trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), 48), ''), 'PATTERN') AS id FROM conversations")
def safe_id(spark, sf):
    return inputs.table(spark, sf, "conversations").select("conv_id", "turn", S.safe_id(F.col("text")).alias("id"))


NODE = "lower(trim(regexp_replace(trim({0}), '[^0-9A-Za-z_]+', '_', 'g'), '_'))"


@query("node_id", f"SELECT page_id, CASE WHEN a = '' THEN 'node' WHEN regexp_matches(a, '^[0-9]') THEN 'n_' || a ELSE a END AS id FROM (SELECT page_id, {NODE.format('substr(url, 8)')} AS a FROM pages)")
def node_id(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", S.node_id(F.expr("substr(url, 8)")).alias("id"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE left(text, 1200) || chr(10) || '... [truncated]' END AS excerpt FROM documents")
def truncate_text(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", S.truncate_text(F.col("text"), 1200).alias("excerpt"))


@query("encode_features", inputs.ansi("SELECT flow_id, CASE PROTOCOL WHEN '6' THEN 1e0 ELSE 0e0 END AS protocol_code, CASE WHEN CAST(TCP_FLAGS AS INT) < 16 THEN CAST(TCP_FLAGS AS DOUBLE) ELSE -1e0 END AS flags_code, CAST(IN_BYTES AS DOUBLE) AS in_bytes, true AS ok FROM ml_features", "ml_features"))
def encode_features(spark, sf):
    from netsift.operators import learning

    maps = {"PROTOCOL": {"17": 0, "6": 1}, "TCP_FLAGS": {str(i): i for i in range(16)}}
    encoded = learning.encode_features(view(spark, sf, "ml_features"), ["PROTOCOL", "TCP_FLAGS", "IN_BYTES"], maps)
    return encoded.select("flow_id", F.col("x_PROTOCOL").alias("protocol_code"), F.col("x_TCP_FLAGS").alias("flags_code"), F.col("x_IN_BYTES").alias("in_bytes"), F.col("encodable").alias("ok"))


