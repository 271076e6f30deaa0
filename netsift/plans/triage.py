"""End-to-end triage: activity, match, route, enrich, verdict, flat event rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.operators import activity, match, matching, routing, verdicts
from netsift.operators.watchlist import Watchlist

EVENT_COLUMNS = [
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "route", "route_reason",
    "adjusted_by_watchlist", "effective_review_threshold", "dynamic_threshold_applied",
    "dynamic_threshold_reason", "ml_prob", "category_hint", "category_confidence", "attributions",
    "verdict", "severity", "rationale", "recommended_action", "watchlist_matched",
    "watchlist_priority", "watchlist_reason", "watchlist_conditions", "watchlist_scope_conditions",
    "watchlist_matched_trigger_hints", "watchlist_unmatched_trigger_hints",
    "watchlist_matched_benign_hints", "watchlist_trigger_completeness", "watchlist_match_strength",
    "watchlist_scope_match", "watchlist_trigger_match", "watchlist_context_only",
    "watchlist_linter_warnings", "fallback_source", "fallback_reason",
]


def prepare_flows(
    flows: DataFrame,
    rules: Watchlist | list[matching.Rule],
    *,
    window_minutes: int = 180,
    low: float = K.THRESHOLD_LOW,
    high: float = K.THRESHOLD_HIGH,
    priority_1: float = K.PRIORITY_1_THRESHOLD,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Scored flows (with ``ml_prob``) -> activity, match and route columns.

    ``stored`` are the verdicts of earlier runs (flow_id, verdict, watchlist_matched): they give the recent alerts and
    watchlist hits of a source. Without them both counters are zero.
    """
    if stored is not None:
        active = activity.with_feedback(flows, stored, window_minutes)
    else:
        active = activity.with_activity(flows, window_minutes).withColumn("recent_alert_count", F.lit(0).cast("bigint"))
    matched = match.match_flows(active, rules)
    return routing.route_flows(matched, low=low, high=high, priority_1=priority_1)


def judge_rows(enriched: DataFrame, *, apply_floor: bool = True) -> DataFrame:
    """Adds the verdict columns: automatic for dismiss and alert, the rule judge for reviews."""
    judged = verdicts.watchlist_only_guard(verdicts.rule_judge(enriched))
    if apply_floor:
        judged = verdicts.verdict_floor(judged)
    return verdicts.automatic(judged)


def flat_events(judged: DataFrame, *extra: str) -> DataFrame:
    found = F.col("match")
    from_match = {
        "watchlist_matched": verdicts.effective_watchlist_id(),
        "watchlist_priority": found["priority"],
        "watchlist_reason": found["reason"],
        "watchlist_conditions": found["matched_conditions"],
        "watchlist_scope_conditions": found["scope_conditions"],
        "watchlist_matched_trigger_hints": found["matched_trigger_hints"],
        "watchlist_unmatched_trigger_hints": found["unmatched_trigger_hints"],
        "watchlist_matched_benign_hints": found["matched_benign_hints"],
        "watchlist_trigger_completeness": found["trigger_completeness"],
        "watchlist_match_strength": found["match_strength"],
        "watchlist_scope_match": found["scope_matched"],
        "watchlist_trigger_match": found["trigger_matched"],
        "watchlist_context_only": found["context_only"],
        "watchlist_linter_warnings": found["linter_warnings"],
    }
    return judged.select(
        *extra, *[from_match[name].alias(name) if name in from_match else F.col(name) for name in EVENT_COLUMNS]
    )


def triage_events(
    flows: DataFrame,
    rules: Watchlist | list[matching.Rule],
    *,
    enrich: Callable[[DataFrame], DataFrame] = routing.enrich_inline,
    apply_floor: bool = True,
    **settings,
) -> DataFrame:
    """The whole triage as one plan: one shuffle for activity, one to bring it back to its flow."""
    prepared = prepare_flows(flows, rules, **settings)
    return flat_events(judge_rows(enrich(prepared), apply_floor=apply_floor))
