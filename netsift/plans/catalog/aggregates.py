"""Aggregations: daily summaries, dashboards, detection quality, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import scalars as S
from netsift.functions import timefn
from netsift.operators import evaluation as E
from netsift.operators import events, matching, summary
from netsift.plans import inputs
from netsift.plans.catalog import query
from netsift.plans.catalog.common import event_frame, joined, r6, view, worked_rules
from netsift.plans.catalog.sqltext import match_ctes

STORE = ("flows_nulls", "ml_results", "routes", "verdicts")
NOW = "2024-01-31 00:00:00"

EVENTS_SQL = {
    "ev": """SELECT f.flow_id, f.start_ms, f.end_ms, f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol, f.raw_label, f.raw_attack, f.created_at,
      m.prob, m.category_hint, m.category_confidence, r.route, r.route_reason, r.adjusted_by_watchlist, r.effective_review_threshold,
      r.dynamic_threshold_applied, r.dynamic_threshold_reason, r.ml_prob, v.verdict, v.severity, v.watchlist_matched, v.fallback_source, v.fallback_reason
      FROM flows_nulls f LEFT JOIN ml_results m ON m.flow_id = f.flow_id LEFT JOIN routes r ON r.flow_id = f.flow_id LEFT JOIN verdicts v ON v.flow_id = f.flow_id"""
}
DAY = "CAST(CAST('1970-01-01' AS DATE) + CAST(floor((coalesce(start_ms, epoch_us(created_at) // 1000) + 32400000) / 86400000.0) AS INT) AS DATE)"
DAILY_SQL = {**EVENTS_SQL, "d": f"SELECT *, {DAY} AS day FROM ev"}


def daily(spark, sf):
    return summary.daily_rows(*(view(spark, sf, n) for n in ("flows_nulls", "routes", "verdicts")))


def complete(spark, sf):
    """Flows with route and verdict (and the manifest facts)."""
    rows = view(spark, sf, "flows").join(view(spark, sf, "routes"), "flow_id").join(view(spark, sf, "verdicts"), "flow_id")
    return rows


COMPLETE_SQL = {
    "c": """SELECT f.flow_id, f.start_ms, f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol, f.raw_label, f.raw_attack, f.mock_prob, r.* EXCLUDE (flow_id), v.* EXCLUDE (flow_id),
      f.raw_label = 'Malicious' AS mal FROM flows f JOIN routes r ON r.flow_id = f.flow_id JOIN verdicts v ON v.flow_id = f.flow_id"""
}


def _ansi_daily(body, *more, extra=None):
    return inputs.ansi(body, *STORE, *more, extra={**DAILY_SQL, **(extra or {})})


def _ansi_complete(body, *more, extra=None):
    return inputs.ansi(body, "flows", "routes", "verdicts", *more, extra={**COMPLETE_SQL, **(extra or {})})


def long_sql(source, dims, by=""):
    by = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {by}'{name}' AS dimension, CAST({expr} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE ({expr}) IS NOT NULL GROUP BY ALL"
        for name, expr in dims.items()
    )


HIT = "(watchlist_matched IS NOT NULL AND watchlist_matched <> '')"
DAILY_DIMS = {
    "flows": "'all'", "route": "coalesce(route, 'unknown')", "verdict": "coalesce(verdict, 'unknown')", "severity": "coalesce(severity, 'unknown')",
    "fallback": "fallback_source", "watchlist_hits": f"CASE WHEN {HIT} THEN 'all' END", "dynamic_threshold": "CASE WHEN dynamic_threshold_applied THEN 'all' END",
}


@query("daily_counts", _ansi_daily(long_sql("d", DAILY_DIMS, "day")))
def daily_counts(spark, sf):
    return summary.daily_counts(daily(spark, sf))


@query(
    "daily_call_stats",
    _ansi_daily(
        """SELECT day, count(call_id) AS total, CAST(sum(CASE WHEN NOT success THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(avg(latency_ms), 6) AS avg_latency_ms,
        max(latency_ms) AS max_latency_ms, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS tokens_used FROM d JOIN calls ON calls.flow_id = d.flow_id GROUP BY day""",
        "calls",
    ),
)
def daily_call_stats(spark, sf):
    rows = daily(spark, sf).select("flow_id", "day")
    stats = summary.call_stats(view(spark, sf, "calls").join(rows, "flow_id"), "day")
    return stats.withColumn("avg_latency_ms", r6(F.col("avg_latency_ms")))


RISK = """CASE WHEN count(*) FILTER (WHERE verdict = 'alert') > 0 OR count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'high_attention'
  WHEN count(*) FILTER (WHERE verdict = 'uncertain') > 0 OR count(fallback_source) > 0 THEN 'needs_review' ELSE 'quiet' END"""


@query("daily_risk", _ansi_daily(f"SELECT day, lvl AS risk_level, CASE lvl WHEN 'quiet' THEN 'Quiet' WHEN 'needs_review' THEN 'Needs Review' ELSE 'High Attention' END AS risk_label FROM (SELECT day, {RISK} AS lvl FROM d GROUP BY day)"))
def daily_risk(spark, sf):
    return summary.daily_risk(daily(spark, sf))


SUMMARY_SQL = _ansi_daily(
    f"""SELECT t.*, coalesce(k.total, 0) AS calls, s.src_ip AS top_source, s.n AS top_source_flows, CASE WHEN alerts > 0 THEN 1 ELSE 0 END + CASE WHEN s.src_ip IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN uncertain > 0 THEN 1 ELSE 0 END + CASE WHEN fallbacks > 0 THEN 1 ELSE 0 END AS n_checks,
      'flow ' || flow_count || '건' AS flow_text
      FROM (SELECT day, {RISK} AS risk_level, count(*) AS flow_count, count(*) FILTER (WHERE route = 'auto_dismiss') AS dismissed, count(*) FILTER (WHERE route = 'tier1_llm') AS reviewed,
        count(*) FILTER (WHERE route = 'auto_alert') AS auto_alerts, count(*) FILTER (WHERE verdict = 'alert') AS alerts, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain,
        count(fallback_source) AS fallbacks, count(*) FILTER (WHERE {HIT}) AS watchlist_hit_count, count(*) FILTER (WHERE dynamic_threshold_applied) AS dynamic_threshold_applied_count FROM d GROUP BY day) t
      LEFT JOIN (SELECT day, count(*) AS total FROM d JOIN calls ON calls.flow_id = d.flow_id GROUP BY day) k USING (day)
      LEFT JOIN (SELECT * FROM (SELECT day, src_ip, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, t0, f0) AS rn FROM
        (SELECT day, src_ip, count(*) AS n, min(coalesce(start_ms, 0)) AS t0, arg_min(flow_id, (coalesce(start_ms, 0), flow_id)) AS f0 FROM d WHERE verdict IN ('alert', 'uncertain') GROUP BY day, src_ip)) WHERE rn = 1) s USING (day)""",
    "calls",
)


@query("daily_summary", SUMMARY_SQL)
def daily_summary(spark, sf):
    days = summary.daily_summary(daily(spark, sf), view(spark, sf, "calls"))
    return days.select(
        "day", "risk_level", "flow_count", "dismissed", "reviewed", "auto_alerts", "alerts", "uncertain", "fallbacks",
        "watchlist_hit_count", "dynamic_threshold_applied_count", F.coalesce("total", F.lit(0)).alias("calls"),
        F.col("top_source.src_ip").alias("top_source"), F.col("top_source.n").alias("top_source_flows"),
        F.size("first_checks").alias("n_checks"), F.regexp_extract("summary_text", "(flow [0-9]+건)", 1).alias("flow_text"),
    )


@query(
    "history_snapshot",
    inputs.ansi(
        f"""SELECT 'route' AS dimension, route AS value, count(*) AS n FROM h JOIN routes USING (flow_id) GROUP BY route
        UNION ALL SELECT 'verdict', coalesce(verdict, 'unknown'), count(*) FROM h JOIN verdicts USING (flow_id) GROUP BY ALL
        UNION ALL SELECT 'total', 'all', count(*) FROM h JOIN verdicts USING (flow_id)
        UNION ALL SELECT 'watchlist', 'all', count(*) FROM h JOIN verdicts USING (flow_id) WHERE {HIT}
        UNION ALL SELECT 'fallback', 'all', count(*) FROM h JOIN verdicts USING (flow_id) WHERE fallback_source IS NOT NULL
        UNION ALL SELECT * FROM (SELECT 'alert', flow_id || ' ' || src_ip || ' ' || verdict || ' ' || coalesce(severity, ''), 1 FROM h JOIN verdicts USING (flow_id)
          WHERE severity IN ('high', 'critical') OR verdict = 'alert' ORDER BY coalesce(start_ms, 0), flow_id LIMIT 50)""",
        "flows_nulls", "routes", "verdicts", extra={"h": f"SELECT * FROM flows_nulls WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY"},
    ),
)
def history_snapshot(spark, sf):
    flows, routes, verdicts = (view(spark, sf, n) for n in ("flows_nulls", "routes", "verdicts"))
    counts = summary.history_counts(flows, routes, verdicts, NOW)
    alerts = summary.history_alerts(flows, verdicts, NOW)
    lines = alerts.select(
        F.lit("alert").alias("dimension"), F.concat_ws(" ", "flow_id", "src_ip", "verdict", "severity").alias("value"), F.lit(1).alias("n")
    )
    return counts.unionByName(lines)


@query(
    "memory_report",
    inputs.ansi(
        f"""SELECT 0 AS pos, '- 총 판정 수: ' || count(*) AS line FROM h JOIN verdicts USING (flow_id) UNION ALL SELECT 1, '- Watchlist 매칭 수: ' || count(*) FILTER (WHERE {HIT}) FROM h JOIN verdicts USING (flow_id)
        UNION ALL SELECT 1 + row_number() OVER (ORDER BY coalesce(start_ms, 0), flow_id), '- ' || src_ip || ' -> ' || dst_ip || ':' || dst_port || ' (' || verdict || ', ' || coalesce(severity, '') || ')' FROM
          (SELECT * FROM h JOIN verdicts USING (flow_id) WHERE severity IN ('high', 'critical') OR verdict = 'alert' ORDER BY coalesce(start_ms, 0), flow_id LIMIT 5)""",
        "flows_nulls", "verdicts", extra={"h": f"SELECT * FROM flows_nulls WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY"},
    ),
)
def memory_report(spark, sf):
    flows, routes, verdicts = (view(spark, sf, n) for n in ("flows_nulls", "routes", "verdicts"))
    return summary.memory_report(
        summary.history_counts(flows, routes, verdicts, NOW), summary.history_alerts(flows, verdicts, NOW)
    )


RECENT = "ORDER BY coalesce(start_ms, 0) DESC, created_at DESC, flow_id DESC"
STATE_SQL = """CASE WHEN verdict IS NOT NULL THEN 'complete' WHEN route = 'tier1_llm' THEN 'tier1_processing' WHEN route IS NOT NULL THEN 'route_processing' ELSE 'ingested' END"""


@query(
    "dashboard_counters",
    _ansi_daily(
        long_sql(
            "l",
            {
                "total": "'all'", "route": "coalesce(route, 'unknown')",
                "verdict": "CASE WHEN st <> 'tier1_processing' THEN coalesce(verdict, 'unknown') END",
                "severity": "CASE WHEN st <> 'tier1_processing' THEN coalesce(severity, 'unknown') END",
                "watchlist_hits": f"CASE WHEN {HIT} THEN 'all' END", "fallbacks": "CASE WHEN fallback_source IS NOT NULL THEN 'all' END",
                "pending": "CASE WHEN st = 'tier1_processing' THEN 'all' END",
            },
        ),
        extra={"l": f"SELECT *, {STATE_SQL} AS st FROM ev {RECENT} LIMIT 100"},
    ),
)
def dashboard_counters(spark, sf):
    return events.dashboard_counters(event_frame(spark, sf))


@query(
    "dashboard_kpis",
    inputs.ansi(
        """SELECT count(*) FILTER (WHERE verdict = 'alert') AS alerts, count(*) FILTER (WHERE verdict = 'alert' AND severity IN ('high', 'critical')) AS severe_alerts,
        count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain_total,
        (SELECT count(*) FROM verdicts v JOIN flows_nulls f USING (flow_id) WHERE verdict = 'uncertain' AND NOT created_at < TIMESTAMP '2024-01-20 00:00:00') AS new_reviews FROM verdicts""",
        "verdicts", "flows_nulls",
    ),
)
def dashboard_kpis(spark, sf):
    now = event_frame(spark, sf)
    before = now.filter(F.col("created_at") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return events.dashboard_kpis(now, before)


@query(
    "table_counts",
    inputs.ansi(
        " UNION ALL ".join(f"SELECT 'table' AS kind, '{t}' AS value, count(*) AS n FROM {t}" for t in ("flows_nulls", "ml_results", "routes", "verdicts", "calls"))
        + " UNION ALL SELECT 'route', route, count(*) FROM routes GROUP BY route UNION ALL SELECT 'verdict', verdict, count(*) FROM verdicts GROUP BY verdict"
        " UNION ALL SELECT 'fallback', fallback_source, count(*) FROM verdicts WHERE fallback_source IS NOT NULL GROUP BY fallback_source",
        *STORE, "calls",
    ),
)
def table_counts(spark, sf):
    tables = {n: view(spark, sf, n) for n in (*STORE, "calls")}
    return events.table_counts(tables, tables["routes"], tables["verdicts"])


UTC_DAY = "coalesce(CAST(CAST('1970-01-01' AS DATE) + CAST(floor(start_ms / 86400000.0) AS INT) AS DATE), CAST(created_at AS DATE))"


@query(
    "filter_options",
    inputs.ansi(
        f"""SELECT DISTINCT 'date' AS kind, CAST({UTC_DAY} AS VARCHAR) AS value FROM (SELECT * FROM flows_nulls {RECENT} LIMIT 1000)
        UNION ALL SELECT DISTINCT 'severity', severity FROM verdicts WHERE severity <> '' UNION ALL SELECT DISTINCT 'verdict', verdict FROM verdicts WHERE verdict <> ''
        UNION ALL SELECT 'asset', a FROM (SELECT src_ip AS a FROM flows_nulls UNION SELECT dst_ip FROM flows_nulls ORDER BY a LIMIT 250)""",
        "flows_nulls", "verdicts",
    ),
)
def filter_options(spark, sf):
    return events.filter_options(view(spark, sf, "verdicts"), view(spark, sf, "flows_nulls"))


@query("latest_event_date", inputs.ansi(f"SELECT CAST(max({UTC_DAY}) AS VARCHAR) AS latest FROM flows_nulls", "flows_nulls"))
def latest_event_date(spark, sf):
    flows = view(spark, sf, "flows_nulls")
    return flows.agg(F.max(timefn.event_date_utc(F.col("start_ms"), F.col("created_at"))).alias("latest"))


# --- detection quality -----------------------------------------------------------


def rates_sql(source, by=""):
    b = f"{by}, " if by else ""
    return f"""SELECT {b}metric, tp, fp, tn, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
      round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_positive_rate, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS false_negative_rate,
      round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM
        (SELECT {b}metric, count(*) FILTER (WHERE mal AND hit) AS tp, count(*) FILTER (WHERE NOT mal AND hit) AS fp, count(*) FILTER (WHERE NOT mal AND NOT hit) AS tn,
          count(*) FILTER (WHERE mal AND NOT hit) AS fn FROM {source} GROUP BY ALL))"""


TWO = "(SELECT *, 'alert' AS metric, verdict = 'alert' AS hit FROM {0} UNION ALL SELECT *, 'review' AS metric, verdict <> 'benign' AS hit FROM {0})"
RATES = ["precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "accuracy"]


def rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in RATES})


@query("confusion", _ansi_complete(rates_sql(TWO.format("c"))))
def confusion(spark, sf):
    return rounded(E.confusion(complete(spark, sf)))


@query(
    "baseline_confusion",
    _ansi_complete(rates_sql("(SELECT *, 'ml>0.95' AS metric, ml_prob > 0.95e0 AS hit FROM c UNION ALL SELECT *, 'ml>0.5' AS metric, ml_prob > 0.5e0 AS hit FROM c)")),
)
def baseline_confusion(spark, sf):
    return rounded(E.baseline_confusion(complete(spark, sf), [0.95, 0.5]))


@query("dynamic_threshold_metrics", _ansi_complete("SELECT count(*) FILTER (WHERE dynamic_threshold_applied) AS applied, count(*) FILTER (WHERE dynamic_threshold_applied AND NOT mal AND verdict = 'alert') AS false_positives, count(*) FILTER (WHERE dynamic_threshold_applied AND mal AND verdict <> 'benign') AS recovered FROM c"))
def dynamic_threshold_metrics(spark, sf):
    return E.dynamic_threshold_metrics(complete(spark, sf))


MANIFEST_SQL = {"cm": "SELECT c.*, m.trace_id, m.day, coalesce(m.scenario, 'unknown') AS scenario, m.cve_id, coalesce(m.source_attack, 'unknown') AS source_attack FROM c LEFT JOIN manifest m ON m.flow_id = c.flow_id"}


def with_manifest(spark, sf):
    facts = view(spark, sf, "manifest")
    return E.manifest_join(complete(spark, sf), facts).join(facts.select("flow_id", "trace_id", "day"), "flow_id", "left")


@query(
    "context_attack_metrics",
    _ansi_complete(
        "SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'alert') AS alert_count, count(*) FILTER (WHERE verdict <> 'benign') AS review_count, round(count(*) FILTER (WHERE verdict = 'alert') / count(*), 6) AS alert_rate, round(count(*) FILTER (WHERE verdict <> 'benign') / count(*), 6) AS review_rate FROM cm WHERE mal AND trace_id LIKE '%attack-context-%'",
        "manifest", extra=MANIFEST_SQL,
    ),
)
def context_attack_metrics(spark, sf):
    out = E.context_attack_metrics(with_manifest(spark, sf), flow_id="trace_id")
    return out.withColumns({c: r6(F.col(c)) for c in ("alert_rate", "review_rate")})


@query("usage_costs", inputs.ansi("""SELECT provider, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, round(avg(latency_ms), 6) AS avg_latency_ms,
    max(latency_ms) AS max_latency_ms, CAST(sum(coalesce(tokens_used, 0)) AS BIGINT) AS total, round(sum(prompt_tokens) / 1e6 * 1.5 + sum(completion_tokens) / 1e6 * 9.0, 6) AS cost_usd FROM calls GROUP BY provider""", "calls"))
def usage_costs(spark, sf):
    out = E.usage_costs(view(spark, sf, "calls"), "provider", input_usd=1.5, output_usd=9.0)
    return out.withColumns({c: r6(F.col(c)) for c in ("avg_latency_ms", "cost_usd")})


@query("rollup_days", _ansi_complete(rates_sql(TWO.format("c"))))
def rollup_days(spark, sf):
    daily_counts = E.confusion(complete(spark, sf).withColumn("day", timefn.local_day(F.col("start_ms"))), "day")
    return rounded(E.rollup_days(daily_counts, "metric"))


@query("change_window_metrics", _ansi_complete(rates_sql(TWO.format("(SELECT *, CASE WHEN day <= 2 THEN 'pre_change' ELSE 'post_change' END AS win FROM cm WHERE day IS NOT NULL)"), "win"), "manifest", extra=MANIFEST_SQL))
def change_window_metrics(spark, sf):
    rows = with_manifest(spark, sf).filter(F.col("day").isNotNull())
    counts = E.confusion(rows, "day").withColumn("win", E.change_window(F.col("day")))
    return rounded(E.rollup_days(counts, "win", "metric"))


SLICES_SQL = """(SELECT *, 'cve:' || cve_id AS slice FROM cm WHERE cve_id IN ('CVE-2025-24813', 'CVE-2024-47575') UNION ALL SELECT *, 'low_ml_contextual' FROM cm WHERE mal AND ml_prob < 0.3e0
  UNION ALL SELECT *, 'infilteration_family' FROM cm WHERE raw_attack = 'Infilteration')"""


@query("slice_metrics", _ansi_complete(rates_sql(TWO.format(SLICES_SQL), "slice"), "manifest", extra=MANIFEST_SQL))
def slice_metrics(spark, sf):
    return rounded(E.slice_metrics(with_manifest(spark, sf)))


@query("benign_control_fpr", _ansi_complete(
    """SELECT control_of, count(*) AS controls, count(*) FILTER (WHERE verdict = 'alert') AS alerts, round(count(*) FILTER (WHERE verdict = 'alert') / count(*), 6) AS alert_fpr
    FROM (SELECT *, CASE WHEN scenario IN ('lab-results-api-access', 'appointment-api') THEN 'CVE-2025-24813' WHEN scenario IN ('admin-management', 'monitoring-scrape') THEN 'CVE-2024-47575' END AS control_of FROM cm WHERE NOT mal)
    WHERE control_of IS NOT NULL GROUP BY control_of""", "manifest", extra=MANIFEST_SQL))
def benign_control_fpr(spark, sf):
    out = E.benign_control_fpr(with_manifest(spark, sf))
    return out.withColumn("alert_fpr", r6(F.col("alert_fpr")))


@query("scenario_counts", _ansi_complete(long_sql("cm", {"scenario": "scenario", "cve": "cve_id", "source_attack": "source_attack"}), "manifest", extra=MANIFEST_SQL))
def scenario_counts(spark, sf):
    return E.scenario_counts(with_manifest(spark, sf))


@query("manifest_join", _ansi_complete("SELECT flow_id, scenario, cve_id, source_attack FROM cm", "manifest", extra=MANIFEST_SQL))
def manifest_join(spark, sf):
    return with_manifest(spark, sf).select("flow_id", "scenario", "cve_id", "source_attack")


# --- false positives -----------------------------------------------------------


def fp_frame(spark, sf):
    """False positives matched again to the watchlist, without recent activity."""
    rows = with_manifest(spark, sf).drop("day")
    fps = E.false_positives(rows)
    matched = matching.match_watchlist(fps, worked_rules(spark), activity=False)
    return matched.select(
        *fps.columns, F.coalesce("match.item_id", F.lit("none")).alias("watchlist_item"),
        F.col("match.match_strength").alias("match_strength"), F.col("match.trigger_matched").alias("trigger_matched"),
        F.col("match.context_only").alias("context_only"), F.col("match.matched_conditions").alias("matched_conditions"),
    )


BAND_SQL = "CASE WHEN ml_prob < 0.04e0 THEN '<0.04' WHEN ml_prob < 0.08e0 THEN '0.04-0.08' WHEN ml_prob < 0.12e0 THEN '0.08-0.12' WHEN ml_prob < 0.2e0 THEN '0.12-0.20' WHEN ml_prob < 0.3e0 THEN '0.20-0.30' WHEN ml_prob < 0.95e0 THEN '0.30-0.95' ELSE '>=0.95' END"
FP_SQL = {
    **match_ctes(activity=False), **COMPLETE_SQL, **MANIFEST_SQL,
    "fp": f"""SELECT x.*, b.strength AS match_strength, coalesce(b.item_id, 'none') AS watchlist_item, b.trigger_matched, b.context_only, b.matched_list, {BAND_SQL} AS ml_prob_band,
      coalesce(split_part(trace_id, '-', 2), 'unknown') AS fday,
      CASE WHEN trace_id LIKE '%-benign-%' THEN regexp_replace(substr(trace_id, strpos(trace_id, '-benign-') + 8), '-[^-]*$', '') ELSE 'unknown' END AS flow_family
      FROM cm x JOIN matches b ON b.flow_id = x.flow_id WHERE NOT mal AND x.verdict = 'alert'""",
}


def _ansi_fp(body):
    return inputs.ansi(body, "flows", "routes", "verdicts", "manifest", extra=FP_SQL)


TXT = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"


@query(
    "fp_counts",
    _ansi_fp(long_sql("fp", {
        "day": TXT("fday"), "flow_family": TXT("flow_family"), "route": TXT("route"), "dynamic_threshold_applied": TXT("dynamic_threshold_applied"),
        "adjusted_by_watchlist": TXT("adjusted_by_watchlist"), "match_strength": TXT("match_strength"), "watchlist_item": TXT("watchlist_item"),
        "severity": TXT("severity"), "ml_prob_band": TXT("ml_prob_band"), "effective_review_threshold": TXT("round(effective_review_threshold, 3)"),
    })),
)
def fp_counts(spark, sf):
    return E.fp_counts(fp_frame(spark, sf))


@query("fp_breakdown", _ansi_fp(long_sql("fp", {"strength": "match_strength", "item": "watchlist_item", "adjusted": "CASE WHEN adjusted_by_watchlist THEN 'all' END"})))
def fp_breakdown(spark, sf):
    return E.fp_breakdown(fp_frame(spark, sf))


def _top_sql(col, n):
    return f"SELECT * FROM (SELECT '{col}' AS kind, {TXT(col)} AS value, count(*) AS n FROM fp GROUP BY ALL ORDER BY n DESC, min((start_ms, flow_id)) LIMIT {n})"


@query("fp_top", _ansi_fp(f"{_top_sql('dst_ip', 20)} UNION ALL {_top_sql('src_ip', 20)} UNION ALL {_top_sql('dynamic_threshold_reason', 10)}"))
def fp_top(spark, sf):
    rows = E.false_positives(with_manifest(spark, sf).drop("day"))
    result = None
    for column, limit in (("dst_ip", 20), ("src_ip", 20), ("dynamic_threshold_reason", 10)):
        part = E.top_values(rows, column, limit, ["start_ms", "flow_id"]).select(F.lit(column).alias("kind"), "value", "n")
        result = part if result is None else result.unionByName(part)
    return result


@query("fp_top_conditions", _ansi_fp("SELECT condition, count(*) AS n FROM (SELECT start_ms, flow_id, unnest(matched_list) AS condition, generate_subscripts(matched_list, 1) AS pos FROM fp) GROUP BY condition ORDER BY n DESC, min((start_ms, flow_id, pos)) LIMIT 20"))
def fp_top_conditions(spark, sf):
    return E.top_conditions(fp_frame(spark, sf), 20, ["start_ms", "flow_id"])


@query("write_fp_csv", _ansi_fp("SELECT flow_id, fday AS day, flow_family, src_ip, dst_ip, src_port, dst_port, protocol, route, round(ml_prob, 6) AS ml_prob, ml_prob_band, round(effective_review_threshold, 3) AS effective_review_threshold, adjusted_by_watchlist, dynamic_threshold_applied, dynamic_threshold_reason, watchlist_item, match_strength, trigger_matched, context_only, severity, round(confidence, 6) AS confidence FROM fp"))
def write_fp_csv(spark, sf):
    """Written to CSV with the fixed columns, and read back."""
    from netsift.session import run_folder
    from netsift.sources import sinks

    rows = fp_frame(spark, sf).withColumns({"ml_prob": r6(F.col("ml_prob")), "confidence": r6(F.col("confidence"))})
    return sinks.round_trip_csv(rows.select(*K.FP_COLUMNS), run_folder(spark, "fp-csv"))


@query(
    "numeric_summary",
    _ansi_complete(
        """SELECT count(*) AS n, round(min(v), 6) AS "min", round(list(v ORDER BY v)[CAST(floor((count(*) - 1) * 0.25) AS INT) + 1], 6) AS p25, round(list(v ORDER BY v)[CAST(floor((count(*) - 1) * 0.5) AS INT) + 1], 6) AS p50,
        round(list(v ORDER BY v)[CAST(floor((count(*) - 1) * 0.75) AS INT) + 1], 6) AS p75, round(avg(v), 6) AS mean, round(max(v), 6) AS "max" FROM (SELECT ml_prob AS v FROM c WHERE NOT mal AND verdict = 'alert')"""
    ),
)
def numeric_summary(spark, sf):
    from netsift.operators.ranks import lower_quantiles

    fps = E.false_positives(with_manifest(spark, sf).drop("day"))
    out = lower_quantiles(fps, "ml_prob", [0.25, 0.5, 0.75])
    return out.withColumns({c: r6(F.col(c)) for c in ("min", "p25", "p50", "p75", "mean", "max")})


# --- labels, splits, manifests, queues, trends -----------------------------------


@query("label_distribution", inputs.ansi(long_sql("ml_features", {"rows": "'all'", "label": "Label", "attack": "Attack"}), "ml_features"))
def label_distribution(spark, sf):
    rows = view(spark, sf, "ml_features")
    return events.count_by(rows, {"rows": F.lit("all"), "label": F.col("Label"), "attack": F.col("Attack")})


@query("manifest_counts", inputs.ansi(long_sql("manifest", {
    "label": "label", "attack": "attack", "day": "day", "scenario": "scenario", "cve": "cve_id",
    "projection_override": "CASE WHEN source_dst_port <> output_dst_port OR source_protocol <> output_protocol THEN 'all' END"}), "manifest"))
def manifest_counts(spark, sf):
    changed = (F.col("source_dst_port") != F.col("output_dst_port")) | (F.col("source_protocol") != F.col("output_protocol"))
    dims = {"label": "label", "attack": "attack", "day": "day", "scenario": "scenario", "cve": "cve_id"}
    tags = {name: F.col(column) for name, column in dims.items()}
    return events.count_by(view(spark, sf, "manifest"), {**tags, "projection_override": F.when(changed, "all")})


@query("queue_stats", inputs.ansi("SELECT count(*) AS calls, count(*) FILTER (WHERE wait_ms > 0) AS queued, count(*) FILTER (WHERE NOT success) AS failed, count(*) FILTER (WHERE fallback_reason = 'timed out') AS timed_out, round(avg(wait_ms), 6) AS avg_wait_ms, max(wait_ms) AS max_wait_ms FROM calls", "calls"))
def queue_stats(spark, sf):
    out = view(spark, sf, "calls").agg(
        F.count("*").alias("calls"), F.count_if(F.col("wait_ms") > 0).alias("queued"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("fallback_reason") == "timed out").alias("timed_out"), F.avg("wait_ms").alias("avg_wait_ms"),
        F.max("wait_ms").alias("max_wait_ms"),
    )
    return out.withColumn("avg_wait_ms", r6(F.col("avg_wait_ms")))


@query(
    "outcome_trend",
    _ansi_daily(
        """SELECT bucket, min(lo + bucket * size) AS bucket_ms, count(*) FILTER (WHERE s = 'dismiss') AS dismiss, count(*) FILTER (WHERE s = 'alert') AS alert, count(*) FILTER (WHERE s = 'uncertain') AS uncertain
        FROM (SELECT *, least(n - 1, CAST(floor((tm - lo) / size) AS BIGINT)) AS bucket FROM (SELECT t.*, b.*, greatest(1, CAST(ceil(greatest(1, hi - lo) / n) AS BIGINT)) AS size FROM t,
          (SELECT min(tm) AS lo, max(tm) AS hi, least(12, greatest(4, count(*))) AS n FROM t) b)) GROUP BY bucket""",
        extra={"t": """SELECT coalesce(start_ms, epoch_us(created_at) // 1000) AS tm, CASE WHEN verdict = 'alert' OR route = 'auto_alert' THEN 'alert' WHEN verdict = 'uncertain' THEN 'uncertain'
          WHEN verdict = 'benign' OR route = 'auto_dismiss' THEN 'dismiss' END AS s FROM ev WHERE verdict IS NOT NULL OR route IN ('auto_alert', 'auto_dismiss')"""},
    ),
)
def outcome_trend(spark, sf):
    return events.outcome_trend(event_frame(spark, sf))


# --- sets ---------------------------------------------------------------------


@query("assets_union", inputs.ansi("SELECT src_ip AS value FROM flows UNION SELECT dst_ip FROM flows", "flows"))
def assets_union(spark, sf):
    return events.union_of_ends(view(spark, sf, "flows"))


@query("append_unique", inputs.ansi(
    """SELECT conv_id, turn, array_to_string(list_concat(u, list_filter(list_distinct_in_order, lambda x: x <> '' AND NOT list_contains(u, x))), '|') AS words FROM (SELECT conv_id, turn, ['alert', 'the'] AS u,
    list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))"""))
def append_unique(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    start = F.array(F.lit("alert"), F.lit("the"))
    return turns.select("conv_id", "turn", joined(S.append_unique(start, F.split("text", " "))).alias("words"))


@query("merge_counters", _ansi_complete("SELECT verdict, count(*) AS n FROM c GROUP BY verdict"))
def merge_counters(spark, sf):
    per_day = complete(spark, sf).groupBy(timefn.local_day(F.col("start_ms")).alias("day"), "verdict").agg(F.count("*").alias("n"))
    return E.merge_counters(per_day, "verdict")
