"""The hint language and the matching steps, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions import hints as H
from netsift.operators import activity, matching, matching_tables, watchlist
from netsift.plans import fixtures, inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.common import joined, scored, view, worked_rules
from netsift.plans.catalog.sqltext import between_cidr, match_ctes

M = match_ctes()
NOM = match_ctes(activity=False)

# Hints as data: each event carries one value and one hint of varying shape.
PAIRS = {
    "pairs": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN cast(user_id AS {S}) WHEN 1 THEN 'tcp' WHEN 2 THEN '6.0' WHEN 3 THEN ' TRUE ' WHEN 4 THEN '10.60.100.7' WHEN 5 THEN 'no-ip' ELSE '443' END AS actual,
      CASE event_id % 5 WHEN 0 THEN '6' WHEN 1 THEN 'tcp' WHEN 2 THEN 'true' WHEN 3 THEN cast(user_id AS {S}) ELSE '443' END AS expected,
      CASE event_id % 11 WHEN 0 THEN 'eq' WHEN 1 THEN 'in' WHEN 2 THEN 'not_in' WHEN 3 THEN 'nin' WHEN 4 THEN 'gt' WHEN 5 THEN 'gte' WHEN 6 THEN 'lt' WHEN 7 THEN 'lte' WHEN 8 THEN 'in_cidr' WHEN 9 THEN 'not_in_cidr' ELSE 'matches' END AS op,
      event_id % 2 = 0 AS is_list FROM events"""
}
SQL_PAIRS = {"pairs": PAIRS["pairs"].replace("{S}", "VARCHAR")}


def pairs(spark, sf):
    inputs.table(spark, sf, "events").createOrReplaceTempView("hint_pair_events")
    return spark.sql(PAIRS["pairs"].replace("{S}", "STRING").replace("FROM events", "FROM hint_pair_events"))


NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
DBL = lambda c: f"CASE WHEN regexp_matches({c}, {NUM}) THEN CAST(trim({c}) AS DOUBLE) END"
EQ = lambda a, e: f"coalesce(CASE WHEN {e} IN ('true', 'false') THEN (lower(trim({a})) IN ('1', 'true', 'yes', 'y')) = ({e} = 'true') WHEN ({DBL(a)}) IS NOT NULL AND ({DBL(e)}) IS NOT NULL THEN ({DBL(a)}) = ({DBL(e)}) ELSE {a} = {e} END, false)"


@query("hint_eq", inputs.ansi(f"SELECT event_id, {EQ('actual', 'expected')} AS same FROM pairs", extra=SQL_PAIRS))
def hint_eq(spark, sf):
    return pairs(spark, sf).select("event_id", H.hint_eq(F.col("actual"), F.col("expected")).alias("same"))


ANY_EQ = f"({EQ('actual', 'expected')} OR {EQ('actual', repr('77'))})"


@query("hint_in", inputs.ansi(f"SELECT event_id, {ANY_EQ} AS found, NOT {ANY_EQ} AS missing FROM pairs", extra=SQL_PAIRS))
def hint_in(spark, sf):
    values = F.array("expected", F.lit("77"))
    found = H.hint_in(F.col("actual"), values)
    return pairs(spark, sf).select("event_id", found.alias("found"), (~found).alias("missing"))


@query("hint_not_in", inputs.ansi(f"SELECT event_id, is_list AND NOT {ANY_EQ} AS holds FROM pairs", extra=SQL_PAIRS))
def hint_not_in(spark, sf):
    """not_in and its short form; without a list the hint is false."""
    values = F.array("expected", F.lit("77"))
    word = F.when(F.col("event_id") % 2 == 0, "not_in").otherwise("nin")
    test = H.hint_matches(F.col("actual"), word, F.col("is_list"), values, ranges())
    return pairs(spark, sf).select("event_id", test.alias("holds"))


RANGE = ["10.60.0.0/16", "bad", "192.168.0.0/24"]
INSIDE = between_cidr("actual", "10.60.0.0/16", "192.168.0.0/24")


def ranges():
    return F.transform(F.array(*[F.lit(r) for r in RANGE]), lambda r: matching_tables.net.cidr_bounds(r))


@query("hint_in_cidr", inputs.ansi(f"SELECT event_id, {INSIDE} AS inside, NOT {INSIDE} AS outside FROM pairs", extra=SQL_PAIRS))
def hint_in_cidr(spark, sf):
    inside = H.hint_in_cidr(F.col("actual"), ranges())
    return pairs(spark, sf).select("event_id", inside.alias("inside"), (~inside).alias("outside"))


@query("hint_not_in_cidr", inputs.ansi(f"SELECT event_id, is_list AND NOT {INSIDE} AS holds FROM pairs", extra=SQL_PAIRS))
def hint_not_in_cidr(spark, sf):
    """True for text that is no address at all."""
    values = F.array(*[F.lit(r) for r in RANGE])
    test = H.hint_matches(F.col("actual"), F.lit("not_in_cidr"), F.col("is_list"), values, ranges())
    return pairs(spark, sf).select("event_id", test.alias("holds"))


CMP = f"coalesce(CASE op WHEN 'gt' THEN ({DBL('actual')}) > ({DBL('expected')}) WHEN 'gte' THEN ({DBL('actual')}) >= ({DBL('expected')}) WHEN 'lt' THEN ({DBL('actual')}) < ({DBL('expected')}) WHEN 'lte' THEN ({DBL('actual')}) <= ({DBL('expected')}) END, false)"


@query("hint_compare", inputs.ansi(f"SELECT event_id, {CMP} AS holds FROM pairs", extra=SQL_PAIRS))
def hint_compare(spark, sf):
    """gt, gte, lt, lte; anything non-numeric is false."""
    return pairs(spark, sf).select("event_id", H.hint_compare(F.col("actual"), F.col("op"), F.col("expected")).alias("holds"))


MATCH = f"""CASE WHEN op = 'in' AND is_list THEN {ANY_EQ} WHEN op IN ('not_in', 'nin') AND is_list THEN NOT {ANY_EQ} WHEN op = 'in_cidr' AND is_list THEN {INSIDE}
  WHEN op = 'not_in_cidr' AND is_list THEN NOT {INSIDE} WHEN op = 'eq' AND NOT is_list THEN {EQ('actual', 'expected')} WHEN op IN ('gt', 'gte', 'lt', 'lte') AND NOT is_list THEN {CMP} ELSE false END"""


@query("hint_unknown_op", inputs.ansi(f"SELECT event_id, {MATCH} AS holds FROM pairs", extra=SQL_PAIRS))
def hint_unknown_op(spark, sf):
    """All operators on one column: unknown ones, and list operators without a list, are false."""
    values = F.array("expected", F.lit("77"))
    test = H.hint_matches(F.col("actual"), F.col("op"), F.col("is_list"), values, ranges())
    return pairs(spark, sf).select("event_id", test.alias("holds"))


@query("hint_status", inputs.ansi(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unrecognized' WHEN {MATCH} THEN 'match' ELSE 'no_match' END AS status FROM pairs", extra=SQL_PAIRS))
def hint_status(spark, sf):
    env = F.create_map(F.lit("x"), F.col("actual"))
    field = F.when(F.col("event_id") % 3 == 0, "y").otherwise("x")
    values = F.array("expected", F.lit("77"))
    status = H.hint_status(env, field, F.col("op"), F.col("is_list"), values, ranges())
    return pairs(spark, sf).select("event_id", status.alias("status"))


FIELDS = "CASE event_id % 13 WHEN 0 THEN 'L4_DST_PORT' WHEN 1 THEN 'dst_ip' WHEN 2 THEN 'src_ip' WHEN 3 THEN 'known_bad_source' WHEN 4 THEN 'src_zone' WHEN 5 THEN 'dst_external' WHEN 6 THEN 'recent_source_x' WHEN 7 THEN 'bytes_out' WHEN 8 THEN 'protocol' WHEN 9 THEN 'ml_prob' WHEN 10 THEN 'TCP_FLAGS' WHEN 11 THEN 'dst_ip' ELSE 'src_port' END"
FIELD_VALUE = "CASE WHEN event_id % 13 = 11 THEN '169.254.169.254' ELSE expected END"


@query("hint_strength", inputs.ansi(
    """SELECT event_id, CASE WHEN f IN ('L4_DST_PORT', 'protocol', 'src_port') THEN 'asset_service' WHEN f = 'dst_ip' AND v = '169.254.169.254' AND op IN ('eq', 'in') THEN 'review_candidate'
    WHEN f = 'dst_ip' AND op IN ('not_in', 'nin', 'not_in_cidr') THEN 'review_candidate' WHEN f = 'dst_ip' THEN 'asset_service' WHEN f = 'src_ip' AND op IN ('not_in', 'nin', 'not_in_cidr') THEN 'policy_violation'
    WHEN f = 'src_ip' AND op = 'in' THEN 'threat_source' WHEN f = 'src_ip' THEN 'review_candidate' WHEN f = 'known_bad_source' THEN 'threat_source' WHEN f = 'src_zone' THEN 'policy_violation'
    WHEN f = 'dst_external' THEN 'behavioral_review' WHEN f IN ('recent_source_x', 'bytes_out', 'ml_prob') THEN 'behavior' ELSE 'none' END AS strength FROM q""",
    extra={**SQL_PAIRS, "q": f"SELECT *, {FIELDS} AS f, {FIELD_VALUE} AS v FROM pairs"}))
def hint_strength(spark, sf):
    rows = pairs(spark, sf).selectExpr("*", f"{FIELDS} AS f", f"{FIELD_VALUE} AS v")
    return rows.select("event_id", H.hint_strength(F.col("f"), F.col("op"), F.array("v")).alias("strength"))


@query("condition_text", inputs.ansi(
    """SELECT event_id, f || ' ' || CASE WHEN op = 'eq' THEN '==' WHEN op IN ('in', 'in_cidr') THEN 'in' WHEN op IN ('not_in', 'nin', 'not_in_cidr') THEN 'not in' ELSE op END || ' ' ||
    CASE WHEN is_list THEN '[''' || expected || ''', ''77'']' ELSE expected END AS text FROM q""", extra={**SQL_PAIRS, "q": f"SELECT *, {FIELDS} AS f FROM pairs"}))
def condition_text(spark, sf):
    rows = pairs(spark, sf).selectExpr("*", f"{FIELDS} AS f")
    value = F.when(F.col("is_list"), F.to_json(F.array("expected", F.lit("77")))).otherwise(F.col("expected"))
    return rows.select("event_id", H.condition_text(F.col("f"), F.col("op"), H.printable(value, F.col("is_list"))).alias("text"))


@query("hint_string_ports", inputs.ansi("SELECT flow_id, dst_port || '|443' AS ports, CASE WHEN src_port % 2 = 0 THEN src_port ELSE dst_port END IN (dst_port, 443) AS hit FROM flows", "flows"))
def hint_string_ports(spark, sf):
    text = F.concat(F.lit("alert if dst_port in [ "), F.col("dst_port").cast("string"), F.lit(" , 443]"))
    ports = H.string_port_values(text)
    actual = F.when(F.col("src_port") % 2 == 0, F.col("src_port")).otherwise(F.col("dst_port"))
    return view(spark, sf, "flows").select("flow_id", joined(ports).alias("ports"), H.hint_in(actual.cast("string"), ports).alias("hit"))


@query("hint_value", inputs.ansi("SELECT f.flow_id, CAST(dst_port AS VARCHAR) AS aliased, CAST(m.IN_BYTES AS VARCHAR) AS feature, f.src_ip AS core_wins, false AS missing, '7' AS counter FROM flows f JOIN ml_features m ON m.flow_id = f.flow_id", "flows", "ml_features"))
def hint_value(spark, sf):
    features = view(spark, sf, "ml_features").select("flow_id", F.create_map(F.lit("IN_BYTES"), F.col("IN_BYTES").cast("string"), F.lit("src_ip"), F.lit("spoofed")).alias("features"))
    rows = scored(spark, sf).join(features, "flow_id").withColumns({c: F.lit(7) for c in ("flow_count", "distinct_dst_count", "same_dst_count", "same_dst_port_count", "watchlist_hit_count", "recent_alert_count")})
    rows = rows.select("flow_id", H.hint_env().alias("env"))
    get = lambda name: F.try_element_at("env", F.lit(name))
    return rows.select("flow_id", get("L4_DST_PORT").alias("aliased"), get("IN_BYTES").alias("feature"), get("src_ip").alias("core_wins"), F.map_contains_key("env", "nothing").alias("missing"), get("recent_source_alert_count").alias("counter"))


# --- matching steps over the worked watchlist -----------------------------------------


_TABLES: dict[str, watchlist.Watchlist] = {}


def tables(spark):
    """The worked watchlist as linted tables; nine items, so they stay cached."""
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        wl = watchlist.load_watchlist(watchlist.document_frame(spark, fixtures.WATCHLIST))
        _TABLES[app] = watchlist.Watchlist(*(t.coalesce(1).cache() for t in (wl.items, wl.targets, wl.hints, wl.groups)))
    return _TABLES[app]


def active(spark, sf):
    return activity.with_activity(scored(spark, sf), 180).withColumn("recent_alert_count", F.lit(0))


def graded(spark, sf):
    return matching_tables.item_rows(active(spark, sf), tables(spark))


TXT = lambda c: f"array_to_string({c}, '|')"


@query("evaluate_hints", inputs.ansi(f"SELECT flow_id, item_id, {TXT('matched_list')} AS matched, {TXT('scope_list')} AS scope, {TXT('trigger_list')} AS triggers, {TXT('unmatched_list')} AS unmatched, coalesce(recognized, false) AS recognized FROM results r JOIN wl_items i USING (seq)", "flows", extra=M))
def evaluate_hints(spark, sf):
    return graded(spark, sf).select("flow_id", "item_id", joined(F.col("matched_list")).alias("matched"), joined(F.col("scope_list")).alias("scope"), joined(F.col("trigger_list")).alias("triggers"), joined(F.col("unmatched_list")).alias("unmatched"), "recognized")


NAMES = ["none", "asset_only", "asset_service", "review_candidate", "behavioral_review", "behavior", "threat_source", "policy_violation", "critical_forbidden"]


def name_of(rank):
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col(rank) + 1)


@query("combined_strength", inputs.ansi("SELECT flow_id, item_id, combined AS strength FROM strengths s JOIN wl_items i USING (seq)", "flows", extra=M))
def combined_strength(spark, sf):
    return graded(spark, sf).select("flow_id", "item_id", name_of("combined_rank").alias("strength"))


@query("trigger_completeness", inputs.ansi("SELECT completeness, strength, count(*) AS n FROM results GROUP BY ALL", "flows", extra=M))
def trigger_completeness(spark, sf):
    return graded(spark, sf).groupBy("completeness", name_of("rank").alias("strength")).agg(F.count("*").alias("n"))


@query("trigger_groups", inputs.ansi("SELECT flow_id, group_done AS complete, group_done AND supported AS supported FROM strengths WHERE n_groups > 0", "flows", extra=M))
def trigger_groups(spark, sf):
    rows = graded(spark, sf).filter(F.col("g").isNotNull())
    return rows.select("flow_id", "g.complete", "g.supported")


@query("benign_hints", inputs.ansi(f"SELECT flow_id, item_id, {TXT('benign_list')} AS benign FROM results r JOIN wl_items i USING (seq) WHERE len(benign_list) > 0", "flows", extra=M))
def benign_hints(spark, sf):
    return graded(spark, sf).filter(F.size("benign_list") > 0).select("flow_id", "item_id", joined(F.col("benign_list")).alias("benign"))


@query("best_match", inputs.ansi("SELECT flow_id, item_id, strength, completeness FROM best", "flows", extra=M))
def best_match(spark, sf):
    """The join form of the matcher; must agree with the compiled form."""
    best = matching_tables.best_match(graded(spark, sf))
    return best.select("flow_id", "match.item_id", F.col("match.match_strength").alias("strength"), F.col("match.trigger_completeness").alias("completeness"))


@query("watchlist_match", inputs.ansi(f"SELECT flow_id, item_id, strength, completeness, trigger_matched, context_only, coalesce({TXT('matched_list')}, '') AS matched, coalesce({TXT('unmatched_list')}, '') AS unmatched, {TXT('benign_list')} AS benign FROM matches", "flows", extra=M))
def watchlist_match(spark, sf):
    rows = matching.match_watchlist(active(spark, sf), worked_rules(spark))
    m = F.col("match")
    return rows.select("flow_id", m["item_id"].alias("item_id"), m["match_strength"].alias("strength"), m["trigger_completeness"].alias("completeness"), m["trigger_matched"].alias("trigger_matched"), m["context_only"].alias("context_only"), joined(m["matched_conditions"]).alias("matched"), joined(m["unmatched_trigger_hints"]).alias("unmatched"), joined(m["matched_benign_hints"]).alias("benign"))


@query("rematch_event", inputs.ansi(f"SELECT flow_id, item_id, priority, reason, strength, completeness, trigger_matched, context_only, coalesce({TXT('matched_list')}, '') AS matched, coalesce({TXT('scope_list')}, '') AS scope FROM matches WHERE flow_id IN (SELECT flow_id FROM ml_results)", "flows", "ml_results", extra=NOM))
def rematch_event(spark, sf):
    """Stored events against the current watchlist, without their recent activity."""
    stored = view(spark, sf, "flows").join(view(spark, sf, "ml_results").select("flow_id", F.col("prob").alias("ml_prob")), "flow_id")
    rows = matching.match_watchlist(stored, worked_rules(spark), activity=False)
    m = F.col("match")
    return rows.select("flow_id", m["item_id"].alias("item_id"), m["priority"].alias("priority"), m["reason"].alias("reason"), m["match_strength"].alias("strength"), m["trigger_completeness"].alias("completeness"), m["trigger_matched"].alias("trigger_matched"), m["context_only"].alias("context_only"), joined(m["matched_conditions"]).alias("matched"), joined(m["scope_conditions"]).alias("scope"))


@query("scope_join", inputs.ansi(f"SELECT flow_id, item_id, {TXT('base')} AS conditions FROM scoped s JOIN wl_items i USING (seq)", "flows", extra=M))
def scope_join(spark, sf):
    wl = tables(spark)
    found = matching_tables.scope_join(view(spark, sf, "flows"), wl.targets)
    return found.join(F.broadcast(wl.items.select("item_seq", "item_id")), "item_seq").select("flow_id", "item_id", joined(F.col("scope_conditions")).alias("conditions"))


