"""Scoring, routing, verdicts, end-to-end triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift import constants as K
from netsift.operators import activity, matching, routing, verdicts
from netsift.plans import fixtures, inputs, triage
from netsift.plans.catalog import query
from netsift.plans.catalog.common import joined, r6, scored, view, worked_rules
from netsift.plans.catalog.sqltext import match_ctes, route_ctes

R = route_ctes()
M = match_ctes()


def routed(spark, sf):
    return triage.prepare_flows(scored(spark, sf), worked_rules(spark))


def enriched(spark, sf):
    return routing.enrich_inline(routed(spark, sf))


@query("mock_score", inputs.ansi("SELECT flow_id, greatest(0e0, least(1e0, mock_prob)) AS score, CASE WHEN mock_prob = 0 THEN 0.5e0 ELSE mock_prob END AS numeric_score, 0.5e0 AS missing_score FROM flows", "flows"))
def mock_score(spark, sf):
    from netsift.functions import scalars as S

    flows = view(spark, sf, "flows")
    text = F.create_map(F.lit("mock_prob"), F.col("mock_prob").cast("string"))
    other = F.create_map(F.lit("x"), F.lit("1"))
    return flows.select(
        "flow_id", S.mock_score(text).alias("score"), S.mock_score_number(F.col("mock_prob")).alias("numeric_score"),
        S.mock_score(other).alias("missing_score"),
    )


@query("effective_threshold", inputs.ansi("SELECT flow_id, round(review_t, 6) AS review_threshold, t_reason AS threshold_reason FROM eff2", "flows", extra=R))
def effective_threshold(spark, sf):
    active = triage.prepare_flows(scored(spark, sf), worked_rules(spark))
    frame = routing.with_effective_threshold(active.select("flow_id", "match"))
    return frame.select("flow_id", r6(F.col("review_threshold")).alias("review_threshold"), "threshold_reason")


@query(
    "route_flows",
    inputs.ansi(
        "SELECT flow_id, route, route_reason, adjusted_by_watchlist, round(effective_review_threshold, 6) AS effective_review_threshold, dynamic_threshold_applied, dynamic_threshold_reason FROM routed",
        "flows", extra=R,
    ),
)
def route_flows(spark, sf):
    return routed(spark, sf).select(
        "flow_id", "route", "route_reason", "adjusted_by_watchlist",
        r6(F.col("effective_review_threshold")).alias("effective_review_threshold"),
        "dynamic_threshold_applied", "dynamic_threshold_reason",
    )


@query("enrich_after_route", inputs.ansi("SELECT flow_id, category_hint, category_confidence, CASE WHEN route = 'tier1_llm' THEN 1 ELSE 0 END AS n_attributions FROM events_out", "flows", extra=R))
def enrich_after_route(spark, sf):
    return routing.enrich_after_route(routed(spark, sf)).select(
        "flow_id", "category_hint", "category_confidence", F.size("attributions").alias("n_attributions")
    )


def _auto(spark, sf):
    stored = view(spark, sf, "routes").join(view(spark, sf, "ml_results"), "flow_id").filter(F.col("route") != "tier1_llm")
    blank = verdicts.verdict_columns(None, None, None, None, F.lit(None).cast("double"))
    return verdicts.automatic(stored.withColumns(blank))


@query(
    "auto_verdicts",
    inputs.ansi(
        """SELECT r.flow_id, CASE WHEN route = 'auto_dismiss' THEN 'benign' ELSE 'alert' END AS verdict, CASE WHEN route = 'auto_dismiss' THEN 'low' ELSE 'high' END AS severity,
        CASE WHEN route = 'auto_dismiss' THEN 'ML probability is low, so the flow was auto-dismissed.'
          ELSE 'ML probability is high, so the flow was classified as an automatic alert.' || CASE WHEN category_hint <> 'not_evaluated' AND category_confidence > 0
          THEN format(' ML attack-family hint is {} (confidence {:.2f}); this is supporting evidence, not a final category label.', category_hint, category_confidence) ELSE '' END END AS rationale,
        0.8e0 AS confidence FROM routes r JOIN ml_results m ON m.flow_id = r.flow_id WHERE route <> 'tier1_llm'""",
        "routes", "ml_results",
    ),
)
def auto_verdicts(spark, sf):
    return _auto(spark, sf).select("flow_id", "verdict", "severity", "rationale", "confidence")


@query(
    "rule_judge",
    inputs.ansi(
        """SELECT flow_id, CASE WHEN is_alert THEN 'alert' WHEN lower(category_hint) = 'benign' AND prob < 0.35e0 THEN 'benign' ELSE 'uncertain' END AS verdict,
        CASE WHEN is_alert THEN 'high' WHEN lower(category_hint) = 'benign' AND prob < 0.35e0 THEN 'low' ELSE 'medium' END AS severity, 0.6e0 AS confidence, item_id AS verdict_watchlist
        FROM (SELECT q.flow_id, prob, item_id, h.category_hint, q.route = 'auto_alert' OR prob >= 0.95e0 OR (trigger_matched
          AND strength IN ('behavior', 'threat_source', 'policy_violation') AND prob >= 0.2e0 AND lower(h.category_hint) <> 'benign') AS is_alert
          FROM routed q JOIN (SELECT flow_id, category_hint FROM ml_results) h ON h.flow_id = q.flow_id WHERE q.route = 'tier1_llm')""",
        "flows", "ml_results", extra=R,
    ),
)
def rule_judge(spark, sf):
    hints = view(spark, sf, "ml_results").select("flow_id", "category_hint")
    reviews = routed(spark, sf).filter(F.col("route") == "tier1_llm").join(hints, "flow_id")
    return verdicts.rule_judge(reviews).select("flow_id", "verdict", "severity", "confidence", "verdict_watchlist")


@query("queue_fallback", inputs.ansi("SELECT flow_id, 'uncertain' AS verdict, 'medium' AS severity, 0.5e0 AS confidence, 'queue' AS fallback_source, 'waited ' || CAST(CAST(wait_ms AS BIGINT) AS VARCHAR) AS fallback_reason, 'Tier 1 LLM queue fallback was applied. Reason: waited ' || CAST(CAST(wait_ms AS BIGINT) AS VARCHAR) AS rationale FROM calls_first", "calls_first"))
def queue_fallback(spark, sf):
    calls = view(spark, sf, "calls_first")
    reason = F.concat(F.lit("waited "), F.col("wait_ms").cast("bigint").cast("string"))
    return calls.select("flow_id", reason.alias("why")).withColumns(
        verdicts.queue_fallback(F.col("why"), F.lit(None).cast("string"))
    ).select("flow_id", "verdict", "severity", "confidence", "fallback_source", "fallback_reason", "rationale")


# Raw judge answers, varied by the call log: enums in and out of range, missing and odd confidences.
ANSWERS = (
    "CASE call_id % 14 WHEN 0 THEN 'maybe' WHEN 2 THEN ' alert ' WHEN 4 THEN NULL WHEN 6 THEN 'benign' ELSE 'uncertain' END AS a_verdict, "
    "CASE call_id % 6 WHEN 0 THEN 'severe' WHEN 2 THEN 'low' ELSE 'high' END AS a_severity, "
    "CASE call_id % 10 WHEN 0 THEN NULL WHEN 2 THEN '1.7' WHEN 4 THEN 'much' WHEN 6 THEN '0' ELSE '0.25' END AS a_confidence, "
    "CASE WHEN call_id % 4 = 0 THEN '' ELSE 'seen before' END AS a_rationale"
)


@query(
    "validate_verdicts",
    inputs.ansi(
        f"""SELECT call_id, CASE WHEN bad THEN 'uncertain' ELSE v END AS verdict, CASE WHEN bad THEN 'medium' ELSE a_severity END AS severity,
        CASE WHEN bad THEN 0.5e0 ELSE greatest(0e0, least(1e0, coalesce(nullif(TRY_CAST(a_confidence AS DOUBLE), 0e0), 0.5e0))) END AS confidence,
        CASE WHEN bad THEN 'llm' END AS fallback_source,
        CASE WHEN v NOT IN ('benign', 'alert', 'uncertain') THEN 'LLM verdict field is missing or invalid: ''' || v || '''.'
          WHEN bad THEN 'LLM severity field is missing or invalid: ''' || a_severity || '''.' END AS fallback_reason,
        CASE WHEN NOT bad THEN coalesce(nullif(a_rationale, ''), '{K.RESPONSE_RATIONALE}') END AS good_rationale
        FROM (SELECT *, v NOT IN ('benign', 'alert', 'uncertain') OR a_severity NOT IN ('low', 'medium', 'high', 'critical') AS bad
          FROM (SELECT *, trim(coalesce(a_verdict, '')) AS v FROM (SELECT *, {ANSWERS} FROM calls)))""",
        "calls",
    ),
)
def validate_verdicts(spark, sf):
    calls = view(spark, sf, "calls").selectExpr("*", *_split_exprs(ANSWERS))
    answer = F.struct(
        F.col("a_verdict").alias("verdict"), F.col("a_severity").alias("severity"), F.col("a_confidence").alias("confidence"),
        F.col("a_rationale").alias("rationale"), F.lit(None).cast("string").alias("recommended_action"),
    )
    checked = verdicts.validate_verdicts(
        calls.select("call_id", answer.alias("response"), F.struct(F.lit(None).cast("string").alias("item_id")).alias("match"))
    )
    return checked.select(
        "call_id", "verdict", "severity", "confidence", "fallback_source", "fallback_reason",
        F.when(F.col("fallback_source").isNull(), F.col("rationale")).alias("good_rationale"),
    )


def _split_exprs(text: str) -> list[str]:
    """'expr AS a, expr AS b' -> the single expressions (split after each alias)."""
    import re

    return [part.strip() for part in re.split(r"(?<=AS a_verdict), |(?<=AS a_severity), |(?<=AS a_confidence), ", text)]


def _all_alert(rows):
    """A reviewer that always alerts: what the guard and the floor are for."""
    return rows.withColumns(
        verdicts.verdict_columns("alert", "low", "because", "act", 0.9, F.col("match.item_id"))
    )


@query(
    "watchlist_only_guard",
    inputs.ansi(
        """SELECT flow_id, CASE WHEN weak THEN 'uncertain' ELSE 'alert' END AS verdict, CASE WHEN weak THEN 'medium' ELSE 'low' END AS severity, CASE WHEN weak THEN 0.5e0 ELSE 0.9e0 END AS confidence
        FROM (SELECT flow_id, r_adjusted AND prob < 0.3e0 AND (strength IN ('asset_only', 'asset_service') OR (completeness IN ('scope_only', 'partial') AND len(benign_list) > 0)) AS weak
          FROM (SELECT q.*, s.adjusted_by_watchlist AS r_adjusted FROM (SELECT * EXCLUDE (adjusted_by_watchlist) FROM routed) q JOIN routes s ON s.flow_id = q.flow_id))""",
        "flows", "routes", extra=R,
    ),
)
def watchlist_only_guard(spark, sf):
    stored = view(spark, sf, "routes").select("flow_id", "adjusted_by_watchlist")
    rows = _all_alert(routed(spark, sf).drop("adjusted_by_watchlist").join(stored, "flow_id"))
    return verdicts.watchlist_only_guard(rows).select("flow_id", "verdict", "severity", "confidence")


@query(
    "verdict_floor",
    inputs.ansi(
        """SELECT flow_id, CASE WHEN trigger_matched AND strength IN ('behavioral_review', 'behavior', 'threat_source', 'policy_violation', 'critical_forbidden')
        AND len(benign_list) = 0 THEN 'medium' ELSE 'low' END AS severity FROM routed""",
        "flows", extra=R,
    ),
)
def verdict_floor(spark, sf):
    return verdicts.verdict_floor(_all_alert(routed(spark, sf))).select("flow_id", "severity")


@query("effective_watchlist_id", inputs.ansi("SELECT m.flow_id, coalesce(nullif(v.watchlist_matched, ''), m.item_id) AS watchlist_matched FROM matches m JOIN verdicts v ON v.flow_id = m.flow_id", "flows", "verdicts", extra=M))
def effective_watchlist_id(spark, sf):
    stored = view(spark, sf, "verdicts").select("flow_id", F.col("watchlist_matched").alias("verdict_watchlist"))
    rows = routed(spark, sf).join(stored, "flow_id")
    return rows.select("flow_id", verdicts.effective_watchlist_id().alias("watchlist_matched"))


@query(
    "triage_events",
    inputs.ansi(
        """SELECT flow_id, src_ip, dst_ip, src_port, dst_port, route, route_reason, adjusted_by_watchlist, round(effective_review_threshold, 6) AS effective_review_threshold,
        dynamic_threshold_applied, dynamic_threshold_reason, round(prob, 6) AS ml_prob, category_hint, category_confidence, verdict, severity, item_id AS watchlist_matched,
        priority AS watchlist_priority, reason AS watchlist_reason, coalesce(list_aggregate(matched_list, 'string_agg', '|'), '') AS watchlist_conditions,
        coalesce(list_aggregate(scope_list, 'string_agg', '|'), '') AS watchlist_scope_conditions, coalesce(list_aggregate(trigger_list, 'string_agg', '|'), '') AS watchlist_matched_trigger_hints,
        coalesce(list_aggregate(unmatched_list, 'string_agg', '|'), '') AS watchlist_unmatched_trigger_hints, coalesce(list_aggregate(benign_list, 'string_agg', '|'), '') AS watchlist_matched_benign_hints,
        completeness AS watchlist_trigger_completeness, strength AS watchlist_match_strength, item_id IS NOT NULL AS watchlist_scope_match, trigger_matched AS watchlist_trigger_match,
        context_only AS watchlist_context_only FROM events_out""",
        "flows", extra=R,
    ),
)
def triage_events(spark, sf):
    events = triage.triage_events(scored(spark, sf), worked_rules(spark))
    lists = [
        "watchlist_conditions", "watchlist_scope_conditions", "watchlist_matched_trigger_hints",
        "watchlist_unmatched_trigger_hints", "watchlist_matched_benign_hints",
    ]
    events = events.withColumns({name: joined(F.col(name)) for name in lists})
    events = events.withColumn("ml_prob", r6(F.col("ml_prob"))).withColumn(
        "effective_review_threshold", r6(F.col("effective_review_threshold"))
    )
    return events.drop("attributions", "rationale", "recommended_action", "watchlist_linter_warnings", "fallback_source", "fallback_reason")


@query("triage_counts", inputs.ansi("SELECT route, verdict, severity, strength AS match_strength, count(*) AS flows FROM events_out GROUP BY ALL", "flows", extra=R))
def triage_counts(spark, sf):
    """The flagship report: how many flows ended where, and on what evidence."""
    events = triage.triage_events(scored(spark, sf), worked_rules(spark))
    return events.groupBy("route", "verdict", "severity", F.col("watchlist_match_strength").alias("match_strength")).agg(
        F.count("*").alias("flows")
    )


FEEDBACK = route_ctes(watchlist=fixtures.FEEDBACK_WATCHLIST, feedback=True, minutes=4320)


@query("triage_with_feedback", inputs.ansi(
    """SELECT e.flow_id, route, verdict, severity, item_id AS watchlist_matched, strength AS watchlist_match_strength, round(effective_review_threshold, 6) AS effective_review_threshold, trigger_matched AS watchlist_trigger_match,
    coalesce(list_aggregate(trigger_list, 'string_agg', '|'), '') AS watchlist_matched_trigger_hints, act.watchlist_hit_count, act.recent_alert_count FROM events_out e JOIN act ON act.flow_id = e.flow_id""",
    "flows", "verdicts", extra=FEEDBACK))
def triage_with_feedback(spark, sf):
    """The triage with the verdicts of three earlier days: hints on recent alerts and watchlist hits of a source fire."""
    rules, stored = worked_rules(spark, feedback=True), view(spark, sf, "verdicts")
    prepared = triage.prepare_flows(scored(spark, sf), rules, stored=stored, window_minutes=4320)
    events = triage.flat_events(triage.judge_rows(routing.enrich_inline(prepared)), "watchlist_hit_count", "recent_alert_count")
    return events.select(
        "flow_id", "route", "verdict", "severity", "watchlist_matched", "watchlist_match_strength", "watchlist_trigger_match",
        r6(F.col("effective_review_threshold")).alias("effective_review_threshold"),
        joined(F.col("watchlist_matched_trigger_hints")).alias("watchlist_matched_trigger_hints"), "watchlist_hit_count", "recent_alert_count",
    )


def reviews(spark, sf):
    """The evidence record of every reviewed flow, with three days of stored feedback."""
    flows, stored = scored(spark, sf), view(spark, sf, "verdicts")
    prepared = triage.prepare_flows(flows, worked_rules(spark, feedback=True), stored=stored, window_minutes=4320)
    found = routing.enrich_inline(prepared).filter(F.col("route") == "tier1_llm")
    found = found.join(activity.top_ports(flows, 4320 * activity.MINUTE_MS), "flow_id", "left")
    told = verdicts.source_activity(4320, F.col("top_dst_ports"), F.col("recent_verdicts"))
    return found.select("flow_id", verdicts.evidence(told, BRIEF).alias("evidence"))


BRIEF = "Only listed sources reach the database. " * 40
PORTS_SQL = "SELECT flow_id, string_agg(CAST(dst_port AS VARCHAR), ',' ORDER BY n DESC, dst_port) AS ports FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY n DESC, dst_port) AS rn FROM (SELECT a.flow_id, b.dst_port, count(*) AS n FROM flows a JOIN flows b ON b.src_ip = a.src_ip AND b.start_ms < a.start_ms AND b.start_ms >= a.start_ms - 259200000 GROUP BY ALL)) WHERE rn <= 5 GROUP BY flow_id"
JUDGED_FIELDS = {
    "dst_port": "flow.dst_port", "flow_count": "source_activity.flow_count", "distinct_dst_count": "source_activity.distinct_dst_count",
    "same_dst_port": "source_activity.same_src_same_dst_port_count", "hits": "source_activity.watchlist_hit_count",
    "alerts": "source_activity.recent_alert_count", "sentence": "source_activity.summary_ko", "item_id": "watchlist_match.item_id",
    "strength": "watchlist_match.match_strength", "completeness": "watchlist_match.trigger_completeness", "route_reason": "route.reason",
    "excerpt": "brief_context_excerpt",
}


@query("judge_payload", inputs.ansi(
    f"""SELECT e.flow_id, CAST(e.dst_port AS VARCHAR) AS dst_port, CAST(flow_count AS VARCHAR) AS flow_count, CAST(distinct_dst_count AS VARCHAR) AS distinct_dst_count, CAST(a.same_dst_port_count AS VARCHAR) AS same_dst_port,
    CAST(watchlist_hit_count AS VARCHAR) AS hits, CAST(recent_alert_count AS VARCHAR) AS alerts, '최근 4320분 기준 DB에서 같은 출발지 flow ' || flow_count || '건, 목적지 ' || distinct_dst_count || '개를 확인했습니다.' AS sentence,
    item_id, strength, completeness, route_reason, '{BRIEF[:1200]}' AS excerpt, '[' || coalesce(ports, '') || ']' AS ports FROM events_out e JOIN act a ON a.flow_id = e.flow_id LEFT JOIN ({PORTS_SQL}) p ON p.flow_id = e.flow_id WHERE route = 'tier1_llm'""",
    "flows", "verdicts", extra=FEEDBACK))
def judge_payload(spark, sf):
    """What the evidence record of every reviewed flow says."""
    told = reviews(spark, sf)
    said = [F.get_json_object("evidence", f"$.{path}").alias(name) for name, path in JUDGED_FIELDS.items()]
    return told.select("flow_id", *said, F.get_json_object("evidence", "$.source_activity.top_dst_ports").alias("ports"))


def _sample_judge(evidence: str) -> str:
    import json

    prob = json.loads(evidence)["ml"]["prob"]
    if prob > 0.9:
        raise RuntimeError("bad request")
    verdict = "alert" if prob > 0.6 else "uncertain"
    return f"thinking... {json.dumps({'verdict': verdict, 'severity': 'high', 'confidence': 0.7})} done"


@query("model_judge", inputs.ansi(
    """SELECT flow_id, CASE WHEN prob > 0.6e0 AND prob <= 0.9e0 THEN 'alert' ELSE 'uncertain' END AS verdict, CASE WHEN prob > 0.9e0 THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN prob > 0.9e0 THEN 0.5e0 ELSE 0.7e0 END AS confidence, CASE WHEN prob > 0.9e0 THEN 'LLM provider call failed: bad request' END AS fallback_reason FROM events_out WHERE route = 'tier1_llm'""",
    "flows", "verdicts", extra=FEEDBACK))
def model_judge(spark, sf):
    """Evidence -> injected judge -> parsed, validated verdicts."""
    answers = verdicts.parse_responses(verdicts.model_judge(reviews(spark, sf), _sample_judge, backoff_seconds=0.0))
    checked = verdicts.validate_verdicts(
        answers.withColumn("response", verdicts.response_struct(F.col("object_json"))).withColumn(
            "match", F.struct(F.lit(None).cast("string").alias("item_id"))
        )
    )
    failed = F.col("error").isNotNull()
    return checked.select(
        "flow_id", "verdict", "severity", "confidence", F.when(failed, F.col("error")).otherwise(F.col("fallback_reason")).alias("fallback_reason")
    )


@query("parse_model_responses", """SELECT conv_id, turn, CASE WHEN found THEN CASE WHEN turn % 2 = 0 THEN 'alert' ELSE 'uncertain' END END AS verdict, CASE WHEN found THEN 'high' END AS severity,
  CASE WHEN found THEN text END AS rationale FROM (SELECT *, coalesce(turn % 3 = 0 OR (turn % 3 = 1 AND text IS NOT NULL), false) AS found FROM conversations)""")
def parse_model_responses(spark, sf):
    """Answers embedded in conversation turns: whole JSON, JSON inside prose and broken JSON, or none."""
    turns = verdicts.parse_responses(view_conversations(spark, sf))
    said = turns.withColumn("r", verdicts.response_struct(F.col("object_json")))
    return said.select("conv_id", "turn", "r.verdict", "r.severity", "r.rationale")


def view_conversations(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    body = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, "alert").otherwise("uncertain").alias("verdict"), F.lit("high").alias("severity"),
        F.col("text").alias("rationale_ko"),
    ))
    content = (
        F.when(F.col("turn") % 3 == 0, body)
        .when(F.col("turn") % 3 == 1, F.concat("text", F.lit(' {"note": 1} '), body, F.lit(" {broken")))
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", "turn", content.alias("content"))


@query("prompt_guard_merge", inputs.ansi(
    """SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND len(checks) > 0 THEN trim(text) ELSE 'rule text' END AS summary,
    CASE WHEN trim(text) <> '' AND len(checks) > 0 THEN array_to_string(checks[1:4], '|') ELSE 'rule check' END AS checks
    FROM (SELECT *, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') AS checks FROM conversations)"""
))
def prompt_guard_merge(spark, sf):
    from netsift.operators import summary

    turns = inputs.table(spark, sf, "conversations")
    generated = F.struct(F.col("text").alias("summary"), F.split("text", "[.]").alias("checks"))
    merged = summary.merge_generated(generated, F.lit("rule text"), F.array(F.lit("rule check")))
    return turns.select("conv_id", "turn", merged["summary"].alias("summary"), joined(merged["checks"]).alias("checks"))


@query("item_results", inputs.ansi("SELECT flow_id, item_id, strength, completeness FROM results r JOIN wl_items i USING (seq)", "flows", extra=M))
def item_results(spark, sf):
    """Every (flow, item) in scope, before the best item is taken."""
    from netsift.operators import activity

    active = activity.with_activity(scored(spark, sf), 180).withColumn("recent_alert_count", F.lit(0))
    return matching.item_matches(active, worked_rules(spark)).select(
        "flow_id", "match.item_id", F.col("match.match_strength").alias("strength"),
        F.col("match.trigger_completeness").alias("completeness"),
    )
