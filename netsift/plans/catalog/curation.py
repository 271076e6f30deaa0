"""Watchlist curation over context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import curation as C
from netsift.operators import matching_tables, watchlist
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.common import joined, r6, scored, view
from netsift.plans.catalog.joins import assets

CYCLE = "2024-01-31"


def context(spark, sf) -> C.Context:
    zones = view(spark, sf, "zones").filter(F.col("cidr") != "not-a-range")
    advisories = view(spark, sf, "advisories").select(
        "seq", F.array_distinct(F.array("asset_a", "asset_b")).alias("affects_assets"), F.array_compact(F.array("port_a", "port_b")).alias("affected_ports"),
        "title", "content", F.array("observable").alias("observables"),
    )
    return C.Context(assets(spark, sf), zones, advisories, view(spark, sf, "patterns"), view(spark, sf, "indicators"))


def seeded(spark, sf):
    return C.seed_watchlist(assets(spark, sf), CYCLE)


def draft(spark, sf):
    return C.draft_from_seed(seeded(spark, sf))


SEED = {
    "seed": f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS item_seq, 'P1-20240131-' || CASE WHEN length(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR)) < 3 THEN lpad(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER (ORDER BY seq) AS VARCHAR) END AS item_id,
      ip, role, '자산 중요도(' || criticality || ') 기반 우선 감시' AS reason, CASE WHEN services_text LIKE 'https, http%' THEN '[80,443]' WHEN services_text LIKE 'ssh%' THEN '[22]' WHEN services_text LIKE 'dns%' THEN '[53]' WHEN services_text = 'https' THEN '[443]' END AS ports,
      policy_rule FROM assets WHERE criticality IN ('critical', 'high')""",
    "txt": "SELECT item_seq, ip, role, policy_rule, lower(reason) || ' prob >= 0.20이면 tier 1 llm으로 보냄 access comes from an unauthorized or unusual source. the same source shows repeated attempts, failures, or scanning behavior. the flow uses an unexpected service, port, or protocol for this asset. traffic comes from an approved business, monitoring, or maintenance source. the flow uses an expected service port with no repeated or high-volume anomaly. recent source activity is low and has no failed or suspicious follow-up attempts.' AS t FROM seed",
}


def _seed_ansi(body, *more, extra=None):
    return inputs.ansi(body, "assets", *more, extra={**SEED, **(extra or {})})


@query("seed_watchlist", _seed_ansi("SELECT item_id, ip, role, reason, coalesce(ports, '[]') AS ports FROM seed"))
def seed_watchlist(spark, sf):
    return seeded(spark, sf).select("item_id", "ip", "role", "reason", F.to_json("ports").alias("ports"))


def zone_list(test):
    return f"(SELECT coalesce('[\"' || string_agg(DISTINCT cidr, '\",\"' ORDER BY cidr) || '\"]', NULL) FROM zones WHERE cidr <> 'not-a-range' AND {test})"


def tokens(*names):
    return "NOT (contains(zone, 'external') OR contains(zone, 'dmz') OR contains(zone, 'public')) AND (" + " OR ".join(f"contains(zone, '{n}')" for n in names) + ")"


LISTS = {
    "approved": tokens("app", "admin"), "admin": tokens("admin"), "workstation": tokens("workstation"), "inside": tokens("internal", "workstation", "admin"),
    "inside_app": tokens("internal", "workstation", "app", "admin"), "scope_db": tokens("db", "database"), "scope_inside": tokens("internal", "workstation"),
}
NON_EXTERNAL = "NOT (contains(zone, 'external') OR contains(zone, 'unknown'))"
ZL = {"zl": "SELECT " + ", ".join(f"{zone_list(test)} AS {name}" for name, test in {**LISTS, "non_external": NON_EXTERNAL}.items())}


@query("zone_token_join", inputs.ansi("SELECT approved, admin, workstation, inside, inside_app, scope_db FROM zl", "zones", extra=ZL))
def zone_token_join(spark, sf):
    lists = C.zone_lists(context(spark, sf).zones)
    return lists.select(*[F.to_json(c).alias(c) for c in ("approved", "admin", "workstation", "inside", "inside_app", "scope_db")])


@query("non_external_cidrs", inputs.ansi(f"SELECT cidr FROM zones WHERE cidr <> 'not-a-range' AND {NON_EXTERNAL}", "zones"))
def non_external_cidrs(spark, sf):
    return context(spark, sf).zones.filter(C.non_external()).select("cidr")


@query("service_assets", inputs.ansi("SELECT DISTINCT ip FROM assets WHERE services_text LIKE '%dns%' OR role LIKE '%dns%'", "assets"))
def service_assets(spark, sf):
    return C.service_assets(assets(spark, sf), "dns")


PT = {"pt": "SELECT *, lower(name || ' ' || condition) AS t FROM patterns"}
RELEVANT = """(contains(p.t, 'vpn') AND contains(i.tags, 'vpn')) OR ((contains(p.t, 'web') OR contains(p.t, 'portal') OR contains(p.t, 'scanner') OR contains(p.t, 'prober')) AND (contains(i.tags, 'web') OR contains(i.tags, 'scanner') OR contains(i.tags, 'prober') OR contains(i.tags, 'rce')))
  OR (contains(p.t, 'database') AND (contains(i.tags, 'database') OR contains(i.tags, 'postgres')))"""
BAD = {"bad": f"SELECT p.t, '[\"' || string_agg(DISTINCT i.ip, '\",\"' ORDER BY i.ip) || '\"]' AS bad_ips FROM (SELECT DISTINCT t FROM pt) p JOIN indicators i ON {RELEVANT} GROUP BY p.t"}


@query("indicator_pattern_join", inputs.ansi("SELECT seq, bad_ips FROM pt JOIN bad USING (t)", "patterns", "indicators", extra={**PT, **BAD}))
def indicator_pattern_join(spark, sf):
    ctx = context(spark, sf)
    profiled = ctx.patterns.select("seq", *C._profile(C.pattern_text()))
    found = profiled.join(C.bad_ips_by_profile(ctx.indicators), ["is_vpn", "is_web", "is_db"])
    return found.select("seq", F.to_json("bad_ips").alias("bad_ips"))


def has(col, *names):
    return "(" + " OR ".join(f"contains({col}, '{n}')" for n in names) + ")"


PATTERN_HINTS = f"""SELECT s.ip, h.f AS field, h.o AS operator, h.v AS value FROM seed s JOIN pt ON pt.dst_ip = s.ip LEFT JOIN bad b ON b.t = pt.t CROSS JOIN zl,
  LATERAL (VALUES ('dst_port', 'eq', CAST(pt.dst_port AS VARCHAR)), ('protocol', 'eq', CAST(pt.protocol AS VARCHAR)), ('src_ip', 'in_cidr', CASE WHEN s.ip = '169.254.169.254' THEN zl.inside END),
    ('recent_source_same_dst_port_count', 'gte', CASE WHEN {has('pt.t', 'repeated', 'spray')} THEN '2' END), ('src_ip', 'in', CASE WHEN {has('pt.t', 'known', 'scanner', 'prober', 'bruteforce', 'spray')} THEN b.bad_ips END)) h(f, o, v) WHERE h.v IS NOT NULL"""


@query("enrich_pattern_hints", _seed_ansi(f"SELECT DISTINCT * FROM ({PATTERN_HINTS})", "patterns", "indicators", "zones", extra={**PT, **BAD, **ZL}))
def enrich_pattern_hints(spark, sf):
    d = draft(spark, sf)
    hints, _ = C.enrich_pattern_hints(d.targets, context(spark, sf))
    return by_ip(hints, d)


def by_ip(hints, d):
    ips = d.targets.select("item_seq", "ip")
    return hints.select("item_seq", "field", "operator", F.col("value_json").alias("value")).distinct().join(ips, "item_seq").select("ip", "field", "operator", "value").distinct()


@query("pattern_asset_join", _seed_ansi("SELECT DISTINCT s.ip, pt.dst_port, pt.protocol FROM seed s JOIN pt ON pt.dst_ip = s.ip", "patterns", extra=PT))
def pattern_asset_join(spark, sf):
    return C.pattern_asset_join(draft(spark, sf).targets, context(spark, sf).patterns).select("ip", "dst_port", "protocol").distinct()


ADV = {
    "adv": """SELECT *, lower(title || ' ' || content || ' ' || observable) AS b, CASE WHEN port_b IS NULL THEN CAST(port_a AS VARCHAR) ELSE '[' || port_a || ',' || port_b || ']' END AS ports FROM advisories""",
    "adva": "SELECT DISTINCT ip, b, ports, observable, port_b IS NOT NULL AS many FROM (SELECT asset_a AS ip, * FROM adv UNION ALL SELECT asset_b AS ip, * FROM adv)",
}
CVE_HINTS = f"""SELECT s.ip, h.f AS field, h.o AS operator, h.v AS value FROM txt s JOIN adva a ON a.ip = s.ip CROSS JOIN zl,
  LATERAL (VALUES ('dst_port', CASE WHEN a.many THEN 'in' ELSE 'eq' END, a.ports), ('recent_source_same_dst_port_count', 'gte', CASE WHEN {has("(s.t || ' ' || a.b)", 'repeated', 'probing', 'spray', 'scanner')} THEN '2' END),
    ('src_ip', 'not_in_cidr', CASE WHEN {has("(s.t || ' ' || a.b)", 'unapproved', 'management-plane', 'management plane')} THEN zl.admin END), ('dst_port', 'eq', CASE WHEN {has("(s.t || ' ' || a.b)", 'outbound', 'egress')} THEN '443' END),
    ('dst_ip', 'not_in_cidr', CASE WHEN {has("(s.t || ' ' || a.b)", 'outbound', 'egress')} THEN zl.non_external END)) h(f, o, v) WHERE h.v IS NOT NULL"""


@query("enrich_cve_hints", _seed_ansi(f"SELECT DISTINCT * FROM ({CVE_HINTS})", "advisories", "zones", extra={**ADV, **ZL}))
def enrich_cve_hints(spark, sf):
    d = draft(spark, sf)
    hints, _, _ = C.enrich_cve_hints(d.targets, C.item_text(d.items), context(spark, sf))
    return by_ip(hints, d)


@query("advisory_asset_join", inputs.ansi("SELECT ip, count(DISTINCT (b, ports)) > 0 AS affected FROM (SELECT DISTINCT asset_a AS ip, * FROM adv UNION SELECT DISTINCT asset_b, * FROM adv) WHERE ip IN (SELECT ip FROM seed) GROUP BY ip", "assets", "advisories", extra={**SEED, **ADV}))
def advisory_asset_join(spark, sf):
    found = C.advisory_asset_join(draft(spark, sf).targets, context(spark, sf).advisories)
    return found.groupBy("ip").agg((F.count("*") > 0).alias("affected"))


POL = {
    "pol": "SELECT s.*, lower(s.t || ' ' || s.role || ' ' || coalesce(s.policy_rule, '')) AS c FROM txt s",
    "polf": f"""SELECT *, {has('c', 'postgres', 'database', 'db', 'billing')} AS f_db, {has('c', 'backup', 'nas', 'smb', 'ransomware')} AS f_backup,
      {has('c', 'jumpbox', 'rdp')} OR (contains(c, 'ssh') AND {has('c', 'admin', 'workstation', 'direct access')}) AS f_admin, {has('c', 'metadata', '169.254.169.254')} AS f_meta,
      {has('c', 'firewall-manager', 'fortimanager', 'management-plane', 'tcp/541')} AS f_mgmt, {has('c', 'egress', 'outbound', 'exfil', 'external')} AS f_eb, {has('c', 'egress', 'outbound', 'external')} AS f_em,
      item_seq IN (SELECT item_seq FROM seed WHERE ports IN ('[443]', '[80,443]')) OR ip IN (SELECT ip FROM ({PATTERN_HINTS}) UNION ALL SELECT NULL WHERE false) AND ip IN (SELECT ip FROM ({PATTERN_HINTS}) x WHERE field = 'dst_port' AND value = '443')
        OR ip IN (SELECT ip FROM ({CVE_HINTS}) y WHERE field = 'dst_port' AND (value = '443' OR contains(value, '443,') OR contains(value, ',443]'))) AS had FROM pol""",
}
POLICY_HINTS = """SELECT p.ip, h.f AS field, h.o AS operator, h.v AS value FROM polf p CROSS JOIN zl,
  LATERAL (VALUES ('dst_port', 'eq', CASE WHEN f_db THEN '5432' END), ('src_ip', 'not_in_cidr', CASE WHEN f_db THEN zl.approved END), ('dst_port', 'eq', CASE WHEN f_backup THEN '445' END), ('src_ip', 'in_cidr', CASE WHEN f_backup THEN zl.workstation END),
    ('dst_port', 'eq', CASE WHEN f_backup AND (had OR f_eb) THEN '443' END), ('dst_ip', 'not_in_cidr', CASE WHEN f_backup AND (had OR f_eb) THEN zl.non_external END), ('dst_port', 'in', CASE WHEN f_admin THEN '[22,3389]' END),
    ('src_ip', 'not_in_cidr', CASE WHEN f_admin THEN zl.admin END), ('dst_ip', 'eq', CASE WHEN f_meta THEN '169.254.169.254' END), ('dst_port', 'eq', CASE WHEN f_meta THEN '80' END), ('src_ip', 'in_cidr', CASE WHEN f_meta THEN zl.inside END),
    ('dst_port', 'eq', CASE WHEN f_mgmt THEN '541' END), ('src_ip', 'not_in_cidr', CASE WHEN f_mgmt THEN zl.admin END), ('dst_port', 'eq', CASE WHEN f_mgmt AND (had OR f_em OR (f_backup AND f_eb)) THEN '443' END),
    ('dst_ip', 'not_in_cidr', CASE WHEN f_mgmt AND (had OR f_em OR (f_backup AND f_eb)) THEN zl.non_external END)) h(f, o, v) WHERE h.v IS NOT NULL"""
ALL_CTX = ("patterns", "indicators", "zones", "advisories")
ALL_EXTRA = {**PT, **BAD, **ZL, **ADV, **POL}


@query("enrich_policy_hints", _seed_ansi(f"SELECT DISTINCT * FROM ({POLICY_HINTS})", *ALL_CTX, extra=ALL_EXTRA))
def enrich_policy_hints(spark, sf):
    d, ctx = draft(spark, sf), context(spark, sf)
    texts = C.item_text(d.items)
    patterns, _ = C.enrich_pattern_hints(d.targets, ctx)
    cves, _, _ = C.enrich_cve_hints(d.targets, texts, ctx)
    hints, _ = C.enrich_policy_hints(d.targets, texts, ctx, d.hints.unionByName(patterns).unionByName(cves))
    return by_ip(hints, d)


@query("policy_asset_join", _seed_ansi("SELECT ip, role, coalesce(policy_rule, '') AS rule FROM seed"))
def policy_asset_join(spark, sf):
    return C.policy_asset_join(draft(spark, sf).targets, assets(spark, sf)).select("ip", F.col("asset_role").alias("role"), "rule")


SRC = {
    "cand": f"""SELECT *, 'P1-SOURCE-PATTERN-' || left(trim(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '-'), 48) AS item_id,
      CASE WHEN contains(t, 'vpn') AND {has('t', 'spray', 'password', 'bruteforce')} THEN 'vpn' WHEN {has('t', 'database', 'postgres')} THEN 'database' WHEN contains(t, 'dns') THEN 'dns' ELSE 'metadata' END AS kind
      FROM pt WHERE {has('t', 'dns', 'vpn', 'database', 'postgres', '169.254.169.254', 'metadata')}""",
    "src": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS rn FROM cand) WHERE rn = 1",
}


@query("source_pattern_items", inputs.ansi(
    """SELECT s.item_id, h.f AS field, h.o AS operator, h.v AS value FROM src s LEFT JOIN bad b ON b.t = s.t CROSS JOIN zl, LATERAL (VALUES ('dst_ip', 'eq', s.dst_ip), ('dst_port', 'eq', CAST(s.dst_port AS VARCHAR)), ('protocol', 'eq', CAST(s.protocol AS VARCHAR)),
    ('recent_source_same_dst_port_count', 'gte', CASE WHEN kind IN ('vpn', 'dns') THEN '2' END), ('src_ip', 'in', CASE WHEN kind IN ('vpn', 'database') THEN b.bad_ips END), ('src_ip', 'not_in_cidr', CASE WHEN kind = 'database' THEN zl.approved END),
    ('src_ip', 'in_cidr', CASE kind WHEN 'dns' THEN zl.workstation WHEN 'metadata' THEN zl.inside_app END), ('dst_ip', 'not_in_cidr', CASE WHEN kind = 'dns' THEN zl.non_external END)) h(f, o, v) WHERE h.v IS NOT NULL""",
    "patterns", "indicators", "zones", extra={**PT, **BAD, **ZL, **SRC}))
def source_pattern_items(spark, sf):
    made = C.source_pattern_items(context(spark, sf), draft(spark, sf).items)
    ids = made.items.select("item_seq", "item_id")
    return made.hints.join(ids, "item_seq").select("item_id", "field", "operator", F.col("value_json").alias("value")).distinct()


@query("missing_pattern_items", inputs.ansi("SELECT item_id, seq, kind FROM src WHERE item_id NOT IN (SELECT item_id FROM cand WHERE contains(name, ' 3'))", "patterns", extra={**PT, **SRC}))
def missing_pattern_items(spark, sf):
    """Candidates not held by a watchlist that already has the items named after one region of patterns."""
    candidates = C.source_pattern_rows(context(spark, sf))
    held = candidates.filter(F.col("name").contains(" 3")).select("item_id", F.lit("priority_1").alias("priority"))
    return C.missing_pattern_items(candidates, held).select("item_id", "seq", "kind")


@query("default_guidance", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Alert when the scoped asset match is paired with an observable threat, policy, or repeated behavior trigger.' ELSE text END AS alert_when FROM conversations")
def default_guidance(spark, sf):
    none = F.array().cast("array<string>")
    rows = inputs.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.array("text")).otherwise(none).alias("alert_when"), none.alias("likely_benign_when"))
    return C.default_guidance(rows).select("conv_id", "turn", joined(F.col("alert_when")).alias("alert_when"))


@query("ensure_policy", _seed_ansi(
    f"""SELECT s.item_id, CASE WHEN p.ip IS NOT NULL THEN 0.1e0 WHEN c.ip IS NOT NULL THEN CASE WHEN c.first_egress THEN 0.12e0 ELSE 0.1e0 END END AS threshold FROM seed s LEFT JOIN (SELECT DISTINCT dst_ip AS ip FROM pt) p ON p.ip = s.ip
    LEFT JOIN (SELECT ip, arg_min({has('b', 'outbound', 'egress')}, seq) AS first_egress FROM (SELECT asset_a AS ip, * FROM adv UNION ALL SELECT asset_b, * FROM adv) GROUP BY ip) c ON c.ip = s.ip""",
    "patterns", "advisories", extra={**PT, **ADV}))
def ensure_policy(spark, sf):
    """First writer wins: patterns before advisories, earlier advisories before later ones."""
    d, ctx = draft(spark, sf), context(spark, sf)
    _, patterns = C.enrich_pattern_hints(d.targets, ctx)
    _, cves, _ = C.enrich_cve_hints(d.targets, C.item_text(d.items), ctx)
    return C.ensure_policy(d.items, patterns.unionByName(cves)).select("item_id", r6(F.col("policy.review_threshold")).alias("threshold"))


ENHANCED = f"SELECT DISTINCT ip, field, operator, value FROM ({PATTERN_HINTS}) UNION SELECT DISTINCT ip, field, operator, value FROM ({CVE_HINTS}) UNION SELECT DISTINCT ip, field, operator, value FROM ({POLICY_HINTS}) UNION SELECT ip, 'dst_port', 'in', ports FROM seed WHERE ports IS NOT NULL"


@query("enhance_watchlist", _seed_ansi(f"SELECT s.item_id, count(*) AS hints FROM ({ENHANCED}) e JOIN seed s USING (ip) GROUP BY s.item_id", *ALL_CTX, extra=ALL_EXTRA))
def enhance_watchlist(spark, sf):
    """The whole enrichment; here the seeded items with the number of their hints."""
    done = C.enhance_watchlist(draft(spark, sf), context(spark, sf))
    seeds = done.items.filter(~F.col("item_id").startswith("P1-SOURCE")).select("item_seq", "item_id")
    return done.hints.join(seeds, "item_seq").groupBy("item_id").agg(F.count("*").alias("hints"))


@query("curated_triage")
def curated_triage(spark, sf):
    """Flows against the freshly curated watchlist, through the join form (the list grows with the context)."""
    from netsift.operators import activity
    from netsift.session import run_folder
    from netsift.sources import sinks

    built = sinks.settle_draft(C.enhance_watchlist(draft(spark, sf), context(spark, sf)), run_folder(spark, "draft"))
    curated = sinks.settle_watchlist(C.to_watchlist(built), run_folder(spark, "watchlist"))

    active = activity.with_activity(scored(spark, sf), 180).withColumn("recent_alert_count", F.lit(0))
    best = matching_tables.match_watchlist(active, curated)
    return best.groupBy("match.item_id", F.col("match.match_strength").alias("strength")).agg(F.count("*").alias("flows"))


# --- raw model output, item by item ---------------------------------------------------

# One raw item per part, in every shape the normaliser and the lint must cope with.
RAW = """'{"id": ' || CASE p_partkey % 4 WHEN 0 THEN 'null' ELSE '"I-' || p_partkey || '"' END || ', "reason": ' || CASE p_partkey % 3 WHEN 0 THEN '"known malicious host"' WHEN 1 THEN '""' ELSE '"imds probing"' END ||
  ', "target_assets": ' || CASE p_partkey % 5 WHEN 0 THEN '[{"role": "x"}]' WHEN 1 THEN '[{"ip": "10.1.1.' || (p_partkey % 250) || '", "match": "DST"}, {"cidr": "10.2.0.0/16"}]' ELSE '[{"ip": "10.1.2.3"}]' END ||
  ', "detection_hints": [' || CASE p_partkey % 6 WHEN 0 THEN '{"field": "dst_port", "operator": "in", "value": 5}' WHEN 1 THEN '{"field": "dst_port", "operator": "eq", "value": 443}, {"field": "src_ip", "operator": "in_cidr", "value": ["10.0.0.0/8"]}'
    WHEN 2 THEN '{"field": "recent_source_flow_count", "operator": "gte", "value": 3}' WHEN 3 THEN '"dst_port in [80, 443]", {"field": "x", "operator": ""}' WHEN 4 THEN '{"field": "src_ip", "operator": "not_in", "value": ["1.2.3.4"]}' ELSE '{"field": "dst_ip", "operator": "eq", "value": "169.254.169.254"}' END ||
  '], "alert_when": [" a ", ""], "routing_policy": ' || CASE p_partkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '{"review_threshold": 0.1}' WHEN 2 THEN '{"review_threshold": 0.5}' WHEN 3 THEN '{"review_threshold": "x"}' WHEN 4 THEN '{"review_threshold": 0.01}'
    WHEN 5 THEN '{"review_threshold": 0.2, "action": "drop"}' ELSE '{"review_threshold": 0.2, "max_threshold_drop": "much", "reason": "r"}' END || '}'"""


def raw_items(spark, sf):
    text = RAW.replace("\n", " ")
    rows = inputs.table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS item_json", "concat('priority_', 1 + p_partkey % 2) AS priority")
    return rows.select("priority", F.col("p_partkey").cast("bigint").alias("item_seq"), F.from_json("item_json", watchlist.ITEM_SCHEMA).alias("item"))


K = "p_partkey"


@query("normalize_watchlist", f"""SELECT {K} AS item_seq, CASE {K} % 4 WHEN 0 THEN 'P' || (1 + {K} % 2) || '-20240131-' || CASE WHEN length(CAST({K} + 1 AS VARCHAR)) < 3 THEN lpad(CAST({K} + 1 AS VARCHAR), 3, '0') ELSE CAST({K} + 1 AS VARCHAR) END ELSE 'I-' || {K} END AS item_id,
    CASE {K} % 3 WHEN 0 THEN 'known malicious host' WHEN 1 THEN 'Tier 2 curated watchlist item.' ELSE 'imds probing' END AS reason, CASE {K} % 5 WHEN 1 THEN 2 ELSE 1 END AS targets,
    CASE {K} % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS hints, 'a' AS alert_when FROM part WHERE {K} % 5 <> 0""")
def normalize_watchlist(spark, sf):
    done = watchlist.normalize_items(raw_items(spark, sf), CYCLE)
    return done.select("item_seq", "item.id", "item.reason", F.size("item.target_assets").alias("targets"), F.size("item.detection_hints").alias("hints"), joined(F.col("item.alert_when")).alias("alert_when")).withColumnRenamed("id", "item_id")


@query("load_watchlist", f"""SELECT {K} AS item_seq, ip, cidr, side FROM part, LATERAL (SELECT * FROM (VALUES (0, '10.1.1.' || ({K} % 250), '', 'dst', 1), (1, '', '10.2.0.0/16', 'either', 1), (2, '10.1.2.3', '', 'either', 2), (3, '', '', 'either', 0)) v(n, ip, cidr, side, kind)
    WHERE kind = CASE {K} % 5 WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE 2 END)""")
def load_watchlist(spark, sf):
    """Stored items as tables, here the targets."""
    return watchlist.to_tables(raw_items(spark, sf)).targets.select("item_seq", "ip", "cidr", "side")


def linted(spark, sf):
    return watchlist.lint_watchlist(watchlist.to_tables(raw_items(spark, sf)))


ROUTABLE = f"{K} % 6 IN (1, 2, 4)"


@query("lint_routing_policy", f"""SELECT {K} AS item_seq, CASE WHEN {K} % 7 IN (1, 6) THEN CASE WHEN {K} % 7 = 1 THEN 0.1e0 ELSE 0.2e0 END END AS threshold, CASE {K} % 7 WHEN 2 THEN 'routing_policy.review_threshold above 0.30; ignored.' WHEN 3 THEN 'routing_policy.review_threshold must be a number; ignored.'
    WHEN 4 THEN 'routing_policy.review_threshold below 0.04; ignored.' WHEN 5 THEN 'routing_policy.action must be tier1_llm; ignored.' WHEN 6 THEN 'routing_policy.max_threshold_drop must be a number; ignored.' ELSE '' END AS warnings FROM part""")
def lint_routing_policy(spark, sf):
    rows = raw_items(spark, sf).select("item_seq", watchlist.lint_policy(F.col("item.routing_policy")).alias("c"))
    return rows.select("item_seq", F.col("c.policy.review_threshold").alias("threshold"), joined(F.col("c.warnings")).alias("warnings"))


@query("lint_watchlist", f"""SELECT {K} AS item_seq, p1 AND NOT ({ROUTABLE}) AS context_only, CASE WHEN p1 AND ({ROUTABLE}) AND {K} % 7 IN (1, 6) THEN CASE WHEN {K} % 7 = 1 THEN 0.1e0 ELSE 0.2e0 END END AS threshold,
    CASE WHEN {K} % 7 IN (2, 3, 4, 5, 6) THEN 1 ELSE 0 END + CASE WHEN p1 AND NOT ({ROUTABLE}) THEN 1 ELSE 0 END + CASE WHEN {K} % 7 IN (1, 6) AND (NOT p1 OR NOT ({ROUTABLE})) THEN 1 ELSE 0 END + CASE WHEN {K} % 6 = 3 THEN 1 ELSE 0 END
    + CASE WHEN {K} % 3 = 0 AND {K} % 6 NOT IN (1, 4) THEN 1 ELSE 0 END + CASE WHEN {K} % 3 = 2 AND {K} % 6 <> 5 THEN 1 ELSE 0 END AS warnings FROM (SELECT *, {K} % 2 = 0 AS p1 FROM part)""")
def lint_watchlist(spark, sf):
    return linted(spark, sf).items.select("item_seq", "context_only", F.col("routing_policy.review_threshold").alias("threshold"), F.size("linter_warnings").alias("warnings"))


@query("routable_contract", f"SELECT {K} AS item_seq, {ROUTABLE} AS routable FROM part")
def routable_contract(spark, sf):
    return linted(spark, sf).items.select("item_seq", "routable")


@query("mention_checks", f"SELECT {K} AS item_seq, {K} % 3 = 0 AS known_bad, {K} % 3 = 2 AS imds, {K} % 6 = 5 AS has_metadata_hint FROM part")
def mention_checks(spark, sf):
    tables = watchlist.to_tables(raw_items(spark, sf))
    flags = watchlist.mention_flags(F.col("reason"), F.col("escalation_rule"))
    facts = watchlist.hint_summary(tables.hints).select("item_seq", "has_metadata_hint")
    rows = tables.items.select("item_seq", flags.alias("m")).join(facts, "item_seq", "left")
    return rows.select("item_seq", "m.known_bad", "m.imds", F.coalesce("has_metadata_hint", F.lit(False)).alias("has_metadata_hint"))

