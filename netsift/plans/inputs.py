"""Input views over the given tables.

Each view is one SELECT over one table, written so that Spark and a generic
ANSI engine read it alike; only three spellings differ between the two. The
operators never see these texts: they take the DataFrames made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spellings that differ between Spark SQL and the checking engine.
SPARK = {
    "S": "STRING",
    "MS": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000)",
    "K": "cast(get_json_object(props, '$.k') as int)",
    "DIV": "div",
}
ANSI = {
    "S": "VARCHAR",
    "MS": "(epoch_us(ts) // 1000)",
    "K": "cast(json_extract_string(props, '$.k') as int)",
    "DIV": "//",
}

FLOW_ID = "concat('flow-', lpad(cast(event_id AS {S}), 8, '0'))"
MALICIOUS = "(value > 110 OR event_id % 37 = 0)"
PROB = "least(1e0, value / 250e0)"
ADJUSTED = f"(event_id % 23 = 0 AND {PROB} >= 0.05e0 AND {PROB} < 0.30e0)"
ROUTE = (
    f"CASE WHEN {PROB} > 0.95e0 THEN 'auto_alert' WHEN {ADJUSTED} THEN 'tier1_llm' "
    f"WHEN {PROB} < 0.30e0 THEN 'auto_dismiss' ELSE 'tier1_llm' END"
)
REVIEW_THRESHOLD = (
    f"CASE WHEN {ADJUSTED} THEN CASE event_id % 3 WHEN 0 THEN 0.04e0 WHEN 1 THEN 0.08e0 ELSE 0.12e0 END "
    "ELSE 0.2e0 END"
)
DYNAMIC = f"({ADJUSTED} AND {PROB} < 0.20e0)"
VERDICT = (
    f"CASE {ROUTE} WHEN 'auto_dismiss' THEN 'benign' WHEN 'auto_alert' THEN 'alert' "
    "ELSE CASE event_id % 5 WHEN 0 THEN 'alert' WHEN 1 THEN 'benign' ELSE 'uncertain' END END"
)
SEVERITY = (
    f"CASE WHEN event_id % 211 = 0 THEN NULL ELSE CASE {VERDICT} WHEN 'benign' THEN 'low' "
    "WHEN 'alert' THEN CASE WHEN event_id % 7 = 0 THEN 'critical' ELSE 'high' END "
    "ELSE 'medium' END END"
)
FALLBACK = (
    f"CASE WHEN {ROUTE} = 'tier1_llm' AND event_id % 41 = 0 THEN 'llm' "
    f"WHEN {ROUTE} = 'tier1_llm' AND event_id % 43 = 0 THEN 'queue' ELSE NULL END"
)
SCENARIO = (
    "CASE event_id % 8 WHEN 0 THEN 'dns-tunnel' WHEN 1 THEN 'appointment-api' WHEN 2 THEN 'context-db-probe' "
    "WHEN 3 THEN 'backup-sync' WHEN 4 THEN 'tomcat-probe' WHEN 5 THEN 'fortimanager-admin' "
    "WHEN 6 THEN 'lab-results-api-access' ELSE 'monitoring-scrape' END"
)
ATTACKS = [
    "DDOS_attack-HOIC", "DDoS_attacks-LOIC-HTTP", "DDOS_attack-LOIC-UDP", "DoS_attacks-Hulk",
    "DoS_attacks-SlowHTTPTest", "DoS_attacks-GoldenEye", "DoS_attacks-Slowloris", "FTP-BruteForce",
    "SSH-Bruteforce", "Brute_Force_-Web", "Brute_Force_-XSS", "SQL_Injection", "Bot", "Infilteration",
]
ATTACK = (
    "CASE event_id % 14 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(ATTACKS[:-1]))
    + f" ELSE '{ATTACKS[-1]}' END"
)

FLOW_COLUMNS = {
    "flow_id": FLOW_ID,
    "start_ms": "{MS}",
    "end_ms": "{MS} + cast(floor(value * 10) AS BIGINT)",
    "src_ip": "CASE WHEN event_id % 10 < 6 THEN concat('10.60.100.', cast(20 + user_id % 24 AS {S})) "
    "WHEN event_id % 10 < 8 THEN concat('198.51.100.', cast(70 + user_id % 24 AS {S})) "
    "WHEN event_id % 10 = 8 THEN concat('10.60.20.', cast(15 + user_id % 16 AS {S})) "
    "ELSE concat('10.60.50.', cast(8 + user_id % 4 AS {S})) END",
    "dst_ip": "CASE event_type WHEN 'view' THEN '10.60.20.30' WHEN 'click' THEN '203.0.113.10' "
    "WHEN 'purchase' THEN '10.60.30.25' WHEN 'signup' THEN '203.0.113.20' "
    "ELSE CASE event_id % 4 WHEN 0 THEN '10.60.60.5' WHEN 1 THEN '10.60.40.12' "
    "WHEN 2 THEN '169.254.169.254' ELSE '8.8.8.8' END END",
    "src_port": "cast(40000 + event_id % 20000 AS INT)",
    "dst_port": "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 8443 ELSE 8080 END "
    "WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 80 ELSE 443 END "
    "WHEN 'purchase' THEN 5432 WHEN 'signup' THEN 443 "
    "ELSE CASE event_id % 4 WHEN 0 THEN 53 WHEN 1 THEN 445 WHEN 2 THEN 80 ELSE 53 END END",
    "protocol": "CASE WHEN event_type = 'error' AND event_id % 4 IN (0, 3) THEN '17' ELSE '6' END",
    "mock_prob": PROB,
    "raw_label": f"CASE WHEN {MALICIOUS} THEN 'Malicious' ELSE 'Benign' END",
    "raw_attack": f"CASE WHEN {MALICIOUS} THEN {ATTACK} ELSE 'Benign' END",
    "created_at": "ts + INTERVAL '2' SECOND",
    "arrival": "event_id",
}

#: The rest of the model's features: packet shapes that differ a little by kind of traffic, rates, windows and gaps.
FLOW_STATISTICS = {
    "L7_PROTO": "cast(event_id % 14 * 7 + user_id % 3 AS {S})",
    "CLIENT_TCP_FLAGS": "cast({K} % 27 AS {S})",
    "SERVER_TCP_FLAGS": "cast({K} % 19 AS {S})",
    "DURATION_IN": "cast(floor(value * 6) AS BIGINT)",
    "DURATION_OUT": "cast(floor(value * 4) AS BIGINT)",
    "LONGEST_FLOW_PKT": "200 + event_id % 14 * 60 + {K}",
    "SHORTEST_FLOW_PKT": "40 + event_id % 7 * 4 + {K} % 5",
    "MIN_IP_PKT_LEN": "40 + event_id % 7 * 4",
    "MAX_IP_PKT_LEN": "200 + event_id % 14 * 60 + {K} % 50",
    "SRC_TO_DST_SECOND_BYTES": "cast(floor(value * 90) AS BIGINT)",
    "DST_TO_SRC_SECOND_BYTES": "cast(floor(value * 33) AS BIGINT)",
    "RETRANSMITTED_IN_BYTES": "cast(floor(value) AS BIGINT) % 17 * 60",
    "RETRANSMITTED_IN_PKTS": "cast(floor(value) AS BIGINT) % 17",
    "RETRANSMITTED_OUT_BYTES": "cast(floor(value) AS BIGINT) % 11 * 60",
    "RETRANSMITTED_OUT_PKTS": "cast(floor(value) AS BIGINT) % 11",
    "SRC_TO_DST_AVG_THROUGHPUT": "cast(floor(value * 800) AS BIGINT)",
    "DST_TO_SRC_AVG_THROUGHPUT": "cast(floor(value * 300) AS BIGINT)",
    "NUM_PKTS_UP_TO_128_BYTES": "event_id % 50 + {K} % 10",
    "NUM_PKTS_128_TO_256_BYTES": "event_id % 20",
    "NUM_PKTS_256_TO_512_BYTES": "event_id % 14 + {K} % 6",
    "NUM_PKTS_512_TO_1024_BYTES": "user_id % 9",
    "NUM_PKTS_1024_TO_1514_BYTES": "user_id % 5",
    "TCP_WIN_MAX_IN": "8192 + {K} * 64",
    "TCP_WIN_MAX_OUT": "8192 + user_id * 32",
    "ICMP_TYPE": "cast(user_id % 4 * 256 AS {S})",
    "ICMP_IPV4_TYPE": "cast(user_id % 4 AS {S})",
    "DNS_QUERY_TYPE": "cast({K} % 6 AS {S})",
    "DNS_TTL_ANSWER": "{K} % 6 * 300",
    "FTP_COMMAND_RET_CODE": "cast(CASE WHEN event_id % 14 = 7 THEN 530 ELSE {K} % 3 * 110 END AS {S})",
    "SRC_TO_DST_IAT_MIN": "{K} % 9",
    "SRC_TO_DST_IAT_MAX": "{K} % 9 + user_id",
    "SRC_TO_DST_IAT_AVG": "{K} % 9 + user_id % 30",
    "SRC_TO_DST_IAT_STDDEV": "user_id % 30",
    "DST_TO_SRC_IAT_MIN": "{K} % 8",
    "DST_TO_SRC_IAT_MAX": "{K} % 8 + user_id",
    "DST_TO_SRC_IAT_AVG": "{K} % 8 + user_id % 25",
    "DST_TO_SRC_IAT_STDDEV": "user_id % 25",
}

VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "flows": ("events", FLOW_COLUMNS, ""),
    # The same flows, some of them without a flow time: they fall back to arrival time.
    "flows_nulls": (
        "events",
        {
            **FLOW_COLUMNS,
            "start_ms": "CASE WHEN event_id % 101 = 0 THEN NULL ELSE {MS} END",
        },
        "",
    ),
    "ml_features": (
        "events",
        {
            "flow_id": FLOW_ID,
            "FLOW_START_MILLISECONDS": "{MS}",
            "L4_DST_PORT": FLOW_COLUMNS["dst_port"],
            "PROTOCOL": FLOW_COLUMNS["protocol"],
            "TCP_FLAGS": "cast({K} % 32 AS {S})",
            "IN_BYTES": "cast(floor(value * 100) AS BIGINT)",
            "IN_PKTS": "1 + event_id % 50",
            "OUT_BYTES": "cast(floor(value * 37) + {K} AS BIGINT)",
            "OUT_PKTS": "1 + user_id % 40",
            "FLOW_DURATION_MILLISECONDS": "cast(floor(value * 10) AS BIGINT)",
            "MIN_TTL": "32 + {K} % 4 * 32",
            "MAX_TTL": "64 + {K} % 3 * 64",
            **FLOW_STATISTICS,
            "Label": f"CASE WHEN {MALICIOUS} THEN 1 ELSE 0 END",
            "Attack": f"CASE WHEN {MALICIOUS} THEN {ATTACK} ELSE 'Benign' END",
            "mock_prob": PROB,
            "arrival": "event_id",
        },
        "",
    ),
    "ml_results": (
        "events",
        {
            "flow_id": FLOW_ID,
            "prob": PROB,
            "category_hint": f"CASE WHEN {ROUTE} = 'auto_dismiss' THEN 'not_evaluated' "
            "ELSE CASE event_id % 3 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'Bot' ELSE 'benign' END END",
            "category_confidence": f"CASE WHEN {ROUTE} = 'auto_dismiss' THEN 0e0 ELSE 0.5e0 + (event_id % 50) / 100e0 END",
            "shap_json": "concat('[[\"IN_BYTES\", ', cast(event_id % 100 AS {S}), '.0, 0.5]]')",
        },
        "WHERE event_id % 89 <> 3",
    ),
    "routes": (
        "events",
        {
            "flow_id": FLOW_ID,
            "route": ROUTE,
            "route_reason": f"CASE WHEN {ADJUSTED} THEN 'watchlist' ELSE 'band' END",
            "threshold_low": "0.3e0",
            "threshold_high": "0.95e0",
            "adjusted_by_watchlist": ADJUSTED,
            "ml_prob": PROB,
            "effective_review_threshold": REVIEW_THRESHOLD,
            "dynamic_threshold_applied": DYNAMIC,
            "dynamic_threshold_reason": f"CASE WHEN {DYNAMIC} THEN concat('policy ', cast(event_id % 4 AS {{S}})) ELSE NULL END",
        },
        "WHERE event_id % 97 <> 5",
    ),
    "verdicts": (
        "events",
        {
            "flow_id": FLOW_ID,
            "verdict": VERDICT,
            "severity": SEVERITY,
            "rationale": f"concat('because of ', {VERDICT})",
            "recommended_action": "concat('check ', cast(user_id AS {S}))",
            "watchlist_matched": "CASE event_id % 7 WHEN 0 THEN 'W-DB' WHEN 1 THEN 'W-LAB' WHEN 2 THEN '' ELSE NULL END",
            "confidence": "0.5e0 + (event_id % 40) / 100e0",
            "fallback_source": FALLBACK,
            "fallback_reason": f"CASE WHEN {FALLBACK} IS NULL THEN NULL ELSE 'not reached' END",
        },
        "WHERE event_id % 97 <> 5 AND event_id % 53 <> 7",
    ),
    # Append-only call log: one row per reviewed flow, a second one for some of them.
    "calls_first": (
        "events",
        {
            "call_id": "event_id * 2",
            "flow_id": FLOW_ID,
            "provider": "CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'remote' END",
            "model_name": "concat('model-', cast(event_id % 2 AS {S}))",
            "latency_ms": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE 100e0 + event_id % 900 END",
            "tokens_used": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 300 + event_id % 700 END",
            "prompt_tokens": "200 + event_id % 500",
            "completion_tokens": "100 + event_id % 200",
            "success": "event_id % 41 <> 0",
            "fallback_reason": "CASE WHEN event_id % 41 = 0 THEN 'timed out' ELSE NULL END",
            "wait_ms": "1e0 * (event_id % 250)",
            "created_at": "ts + INTERVAL '3' SECOND",
        },
        f"WHERE {ROUTE} = 'tier1_llm' AND event_id % 97 <> 5 AND event_id % 53 <> 7",
    ),
    "calls_second": (
        "events",
        {
            "call_id": "event_id * 2 + 1",
            "flow_id": FLOW_ID,
            "provider": "'remote'",
            "model_name": "'model-1'",
            "latency_ms": "50e0 + event_id % 100",
            "tokens_used": "100 + event_id % 100",
            "prompt_tokens": "80 + event_id % 50",
            "completion_tokens": "20 + event_id % 50",
            "success": "true",
            "fallback_reason": "cast(NULL AS {S})",
            "wait_ms": "5e0",
            "created_at": "ts + INTERVAL '5' SECOND",
        },
        f"WHERE {ROUTE} = 'tier1_llm' AND event_id % 97 <> 5 AND event_id % 53 <> 7 AND event_id % 29 = 0",
    ),
    "manifest": (
        "events",
        {
            "flow_id": FLOW_ID,
            "trace_id": f"concat('xgb-d0', cast(1 + event_id % 5 AS {{S}}), CASE WHEN {MALICIOUS} THEN '-attack-' "
            f"ELSE '-benign-' END, {SCENARIO}, '-', lpad(cast(event_id AS {{S}}), 6, '0'))",
            "day": "1 + event_id % 5",
            "scenario": SCENARIO,
            "cve_id": f"CASE {SCENARIO} WHEN 'tomcat-probe' THEN 'CVE-2025-24813' "
            "WHEN 'fortimanager-admin' THEN 'CVE-2024-47575' ELSE NULL END",
            "label": f"CASE WHEN {MALICIOUS} THEN 'Malicious' ELSE 'Benign' END",
            "attack": f"CASE WHEN {MALICIOUS} THEN {ATTACK} ELSE 'Benign' END",
            "source_index": "event_id",
            "source_attack": f"CASE WHEN {MALICIOUS} THEN {ATTACK} ELSE 'Benign' END",
            "source_dst_port": f"CASE WHEN event_id % 6 = 0 THEN '80' ELSE cast({FLOW_COLUMNS['dst_port']} AS {{S}}) END",
            "output_dst_port": f"cast({FLOW_COLUMNS['dst_port']} AS {{S}})",
            "source_protocol": "CASE WHEN event_id % 9 = 0 THEN '17' ELSE '6' END",
            "output_protocol": FLOW_COLUMNS["protocol"],
        },
        "WHERE event_id % 19 <> 3",
    ),
}

# Asset addresses follow the supplier key; eight kinds of host share the space.
def _asset_ip(key: str) -> str:
    host = f"cast({key} {{DIV}} 8 % 200 AS {{S}})"
    site = f"cast(60 + {key} {{DIV}} 1600 % 190 AS {{S}})"
    return (
        f"CASE {key} % 8 WHEN 0 THEN concat('10.', {site}, '.20.', cast(20 + {key} {{DIV}} 8 % 200 AS {{S}})) "
        f"WHEN 1 THEN concat('10.', {site}, '.30.', cast(15 + {key} {{DIV}} 8 % 200 AS {{S}})) "
        f"WHEN 2 THEN concat('10.', {site}, '.40.', {host}) WHEN 3 THEN concat('10.', {site}, '.50.', {host}) "
        f"WHEN 4 THEN concat('10.', {site}, '.60.', {host}) "
        f"WHEN 5 THEN concat('203.', cast({key} {{DIV}} 1600 % 250 AS {{S}}), '.113.', {host}) "
        f"WHEN 6 THEN concat('10.', {site}, '.100.', {host}) ELSE concat('172.', cast(16 + {key} {{DIV}} 1600 % 16 AS {{S}}), '.7.', {host}) END"
    )


VIEWS["assets"] = (
    "supplier",
    {
        "seq": "s_suppkey",
        "ip": _asset_ip("s_suppkey"),
        "asset_id": "s_name",
        "role": "CASE s_suppkey % 8 WHEN 0 THEN 'web-portal' WHEN 1 THEN 'billing-database' WHEN 2 THEN 'backup-nas' "
        "WHEN 3 THEN 'admin-jumpbox' WHEN 4 THEN 'dns-resolver' WHEN 5 THEN 'vpn-gateway' "
        "WHEN 6 THEN 'clinic-laptop' ELSE 'imaging-pacs' END",
        "zone": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CASE s_suppkey % 8 WHEN 0 THEN 'internal-app' "
        "WHEN 1 THEN 'internal-db' WHEN 2 THEN 'internal-backup' WHEN 3 THEN 'admin' "
        "WHEN 4 THEN 'infrastructure' WHEN 5 THEN 'dmz-public' WHEN 6 THEN 'clinic-workstations' "
        "ELSE 'clinical' END END",
        "owner": "concat('team-', cast(s_nationkey AS {S}))",
        "services_text": "CASE s_suppkey % 8 WHEN 0 THEN 'https, http' WHEN 1 THEN 'postgres' WHEN 2 THEN 'smb, ' "
        "WHEN 3 THEN 'ssh,rdp' WHEN 4 THEN 'dns, ntp' WHEN 5 THEN 'https' ELSE '' END",
        "criticality": "CASE s_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END",
        "status": "CASE WHEN s_suppkey % 13 = 0 THEN 'retired' ELSE 'active' END",
        "policy_rule": "CASE s_nationkey % 6 WHEN 0 THEN 'database access only from app and admin zones' "
        "WHEN 1 THEN 'backup window only; external egress forbidden' WHEN 2 THEN 'no direct access from workstation by ssh' "
        "WHEN 3 THEN 'management-plane reachable from admin only, no outbound' WHEN 4 THEN NULL ELSE '' END",
    },
    "",
)
VIEWS["zones"] = (
    "nation",
    {
        "zone_seq": "n_nationkey",
        "cidr": "CASE n_nationkey WHEN 0 THEN '10.60.100.0/24' WHEN 1 THEN '10.60.100.20/30' WHEN 2 THEN '10.60.20.0/24' "
        "WHEN 3 THEN '10.60.30.0/24' WHEN 4 THEN '10.60.40.0/24' WHEN 5 THEN '10.60.50.0/24' "
        "WHEN 6 THEN '10.60.60.0/24' WHEN 7 THEN '203.0.113.0/24' WHEN 8 THEN '198.51.100.0/24' "
        "WHEN 9 THEN 'not-a-range' ELSE concat('10.', cast(60 + n_nationkey AS {S}), '.0.0/16') END",
        "zone": "CASE n_nationkey WHEN 0 THEN 'clinic-workstations' WHEN 1 THEN 'doctor-workstations' WHEN 2 THEN 'internal-app' "
        "WHEN 3 THEN 'internal-db' WHEN 4 THEN 'internal-backup' WHEN 5 THEN 'admin' "
        "WHEN 6 THEN 'infrastructure' WHEN 7 THEN 'dmz-public' WHEN 8 THEN 'external-unknown' "
        "ELSE concat('internal-site-', cast(n_nationkey AS {S})) END",
    },
    "",
)
VIEWS["advisories"] = (
    "part",
    {
        "seq": "p_partkey",
        "cve_id": "concat('CVE-2025-', cast(10000 + p_partkey AS {S}))",
        "asset_a": _asset_ip("(p_partkey % 100)"),
        "asset_b": _asset_ip("((p_partkey * 3 + 1) % 100)"),
        "port_a": "CASE p_size % 4 WHEN 0 THEN 8080 WHEN 1 THEN 443 WHEN 2 THEN 541 ELSE 5432 END",
        "port_b": "CASE WHEN p_size % 3 = 0 THEN 8443 ELSE NULL END",
        "title": "concat('flaw in ', p_name)",
        "content": "CASE p_type WHEN 'ECONOMY' THEN 'repeated probing seen' WHEN 'STANDARD' THEN 'unapproved management-plane access' "
        "WHEN 'PROMO' THEN 'outbound egress after exposure' ELSE 'informational only' END",
        "observable": "CASE WHEN p_size % 5 = 0 THEN 'single access is benign' ELSE 'small request sizes' END",
        "severity": "CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END",
    },
    "",
)
VIEWS["patterns"] = (
    "customer",
    {
        "seq": "c_custkey",
        "name": "concat(CASE c_mktsegment WHEN 'BUILDING' THEN 'vpn_password_spray' WHEN 'AUTOMOBILE' THEN 'database probe' "
        "WHEN 'MACHINERY' THEN 'dns tunnel' WHEN 'HOUSEHOLD' THEN 'metadata access' ELSE 'portal scanner' END, "
        "' ', cast(c_nationkey AS {S}))",
        "condition": "CASE c_mktsegment WHEN 'BUILDING' THEN 'same source repeatedly reaches the vpn gateway, password spray' "
        "WHEN 'AUTOMOBILE' THEN 'database-scanner reaches internal database' "
        "WHEN 'MACHINERY' THEN 'workstation sends repeated dns to external resolver' "
        "WHEN 'HOUSEHOLD' THEN 'direct access to 169.254.169.254' ELSE 'known web scanner reaches the portal' END",
        "dst_ip": "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '169.254.169.254' WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') "
        f"THEN NULL ELSE {_asset_ip('(c_custkey % 100)')} END",
        "dst_port": "CASE c_mktsegment WHEN 'BUILDING' THEN 443 WHEN 'AUTOMOBILE' THEN 5432 WHEN 'MACHINERY' THEN 53 "
        "WHEN 'HOUSEHOLD' THEN 80 ELSE 8080 END",
        "protocol": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 17 ELSE 6 END",
    },
    "",
)
VIEWS["indicators"] = (
    "customer",
    {
        "seq": "c_custkey",
        "ip": "concat('198.51.100.', cast(c_custkey % 250 AS {S}))",
        "tags": "CASE c_mktsegment WHEN 'BUILDING' THEN 'vpn-bruteforce' WHEN 'AUTOMOBILE' THEN 'database-scanner' "
        "WHEN 'MACHINERY' THEN 'web-rce-scanner' ELSE 'generic' END",
    },
    "",
)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class _Fill(dict):
    def __missing__(self, key: str) -> str:
        raise KeyError(key)


def _fill(text: str, dialect: dict[str, str]) -> str:
    return text.format_map(_Fill(dialect))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input view as a DataFrame; unused columns are pruned down to the scan."""
    if name == "calls":
        return view(spark, sf_dir, "calls_first").unionByName(view(spark, sf_dir, "calls_second"))
    source, columns, where = VIEWS[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.filter(_fill(where, SPARK).removeprefix("WHERE "))
    return df.selectExpr(*[f"{_fill(expr, SPARK)} AS {col}" for col, expr in columns.items()])


def ansi_view(name: str) -> str:
    """The same view as a SELECT text for the checking engine."""
    if name == "calls":
        return "SELECT * FROM calls_first UNION ALL SELECT * FROM calls_second"
    source, columns, where = VIEWS[name]
    cols = ", ".join(f"{_fill(expr, ANSI)} AS {col}" for col, expr in columns.items())
    return f"SELECT {cols} FROM {source} {_fill(where, ANSI)}"


def ansi(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A query text with its input views in front as common table expressions."""
    wanted: list[str] = []
    for name in names:
        if name == "calls":
            wanted += ["calls_first", "calls_second"]
        wanted.append(name)
    ctes = [f"{name} AS ({ansi_view(name)})" for name in dict.fromkeys(wanted)]
    ctes += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
