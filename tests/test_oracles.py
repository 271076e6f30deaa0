"""Registered queries against their SQL counterparts on the smallest tables."""

import pytest

from netsift.plans import catalog
from tools.check import rows_of

catalog.load()

# Broad cover in a few minutes; tools/check.py runs them all.
SAMPLE = [
    "triage_events", "route_flows", "enrich_after_route", "validate_verdicts", "watchlist_only_guard", "verdict_floor",
    "watchlist_match", "best_match", "evaluate_hints", "trigger_groups", "rematch_event", "scope_join", "hint_unknown_op",
    "hint_status", "hint_strength", "condition_text", "source_activity", "source_activity_narrow_panes", "activity_top_ports",
    "recent_verdicts", "source_activity_unbounded", "review_budget", "event_assembly", "event_detail", "report_events",
    "daily_counts", "daily_summary", "history_snapshot", "dashboard_counters", "confusion", "slice_metrics", "fp_counts",
    "numeric_summary", "outcome_trend", "zone_lookup", "topology_nodes", "topology_edges", "asset_map", "seed_watchlist",
    "enrich_policy_hints", "source_pattern_items", "normalize_watchlist", "lint_watchlist", "scan_flows", "normalize_flow_json",
    "upsert_flows", "edit_context", "overlay_context", "time_split", "stratified_split", "select_thresholds", "binary_metrics",
    "multiclass_metrics", "stream_activity", "stream_dedup", "late_flows", "ip_in_cidrs", "row_time", "safe_id", "classify_group",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(name, spark, data, duck):
    df = catalog.QUERIES[name](spark, data)
    got = rows_of(df.columns, df.collect())
    result = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
