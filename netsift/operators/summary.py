"""Daily summaries and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import scalars as S
from netsift.functions import timefn


def merge_generated(generated: Column, rule_summary: Column, rule_checks: Column, limit: int = 4) -> Column:
    """Accepts a generated summary only with text and at least one check; else keeps the rule text."""
    text = F.trim(F.coalesce(generated["summary"], F.lit("")))
    checks = F.filter(
        F.transform(F.coalesce(generated["checks"], F.array().cast("array<string>")), lambda t: F.trim(t)), lambda c: c != ""
    )
    accepted = (text != "") & (F.size(checks) > 0)
    return F.struct(
        F.when(accepted, text).otherwise(rule_summary).alias("summary"),
        F.when(accepted, F.slice(checks, 1, limit)).otherwise(rule_checks).alias("checks"),
    )


# --- local-day summaries -------------------------------------------------------


def daily_rows(flows: DataFrame, routes: DataFrame, verdicts: DataFrame, day: str | None = None) -> DataFrame:
    """Flows of one local day (or of all days, tagged) with route and verdict.

    The day filter sits on the flow side before the joins.
    """
    arrival_ms = timefn.ntz_millis(F.col("created_at"))
    tagged = flows.withColumn("day", timefn.local_day(F.coalesce("start_ms", arrival_ms)))
    if day is not None:
        tagged = tagged.filter(timefn.in_local_day(F.col("start_ms"), F.col("created_at"), day))
    return tagged.join(routes, "flow_id", "left").join(verdicts, "flow_id", "left")


def daily_counts(rows: DataFrame) -> DataFrame:
    """Per local day one row per (dimension, value): all counters of the day in one shuffle."""
    tags = {
        "flows": F.lit("all"),
        "route": S.countable(F.col("route")),
        "verdict": S.countable(F.col("verdict")),
        "severity": S.countable(F.col("severity")),
        "fallback": S.blank_to_null(F.col("fallback_source")),
        "watchlist_hits": F.when(S.watchlist_hit(F.col("watchlist_matched")), "all"),
        "dynamic_threshold": F.when(F.coalesce("dynamic_threshold_applied", F.lit(False)), "all"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in tags.items()])
    return (
        rows.select("day", F.explode(pairs).alias("t"))
        .filter(F.col("t.value").isNotNull())
        .groupBy("day", F.col("t.dimension").alias("dimension"), F.col("t.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def call_stats(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, failures, latency and tokens; missing tokens count as zero, missing latency is skipped."""
    return calls.groupBy(*by).agg(
        F.count("call_id").alias("total"),
        F.count_if(~F.col("success")).alias("failed"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens_used"),
    )


def risk_level(alerts: Column, critical: Column, uncertain: Column, fallbacks: Column) -> Column:
    return (
        F.when((alerts > 0) | (critical > 0), "high_attention")
        .when((uncertain > 0) | (fallbacks > 0), "needs_review")
        .otherwise("quiet")
    )


def daily_risk(rows: DataFrame) -> DataFrame:
    levels = rows.groupBy("day").agg(
        F.count_if(F.col("verdict") == "alert").alias("alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("verdict") == "uncertain").alias("uncertain"),
        F.count_if(S.watchlist_hit(F.col("fallback_source"))).alias("fallbacks"),
    )
    level = risk_level(*[F.col(c) for c in ("alerts", "critical", "uncertain", "fallbacks")])
    return levels.select("day", level.alias("risk_level"), S.case_of(level, K.RISK_LABELS, "").alias("risk_label"))


def severity_rank(severity: Column) -> Column:
    return S.case_of(F.lower(severity), K.SEVERITY_RANK, 0)


def top_alerts(rows: DataFrame, limit: int = 5) -> DataFrame:
    """Alerts by severity, probability, time and id (a top-k)."""
    order = [
        severity_rank(F.coalesce("severity", F.lit("none"))).desc(),
        F.coalesce("ml_prob", F.lit(0.0)).desc(),
        F.coalesce("start_ms", F.lit(0)).asc(),
        F.col("flow_id").asc(),
    ]
    picked = rows.filter(F.col("verdict") == "alert").orderBy(*order).limit(max(0, limit))
    return picked.select(
        "flow_id", timefn.row_time(F.col("start_ms"), F.col("created_at")).alias("time"), "src_ip", "dst_ip",
        F.coalesce("dst_port", F.lit(0)).alias("dst_port"), S.countable(F.col("route")).alias("route"),
        F.coalesce("ml_prob", F.lit(0.0)).alias("ml_prob"), S.countable(F.col("severity")).alias("severity"),
        S.blank_to_null(F.col("watchlist_matched")).alias("watchlist_matched"),
    )


def _top_reviewed(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Most frequent keys among alerts and uncertain rows; ties go to the first seen."""
    first = F.min(F.struct(F.coalesce("start_ms", F.lit(0)).alias("t"), F.col("flow_id").alias("f")))
    return (
        rows.filter(F.col("verdict").isin("alert", "uncertain") & F.coalesce(F.col(keys[0]) != "", F.lit(False)))
        .groupBy(*keys)
        .agg(F.count("*").alias("count"), first.alias("_first"))
        .orderBy(F.desc("count"), "_first")
        .limit(limit)
        .drop("_first")
    )


def top_review_sources(rows: DataFrame, limit: int = 5) -> DataFrame:
    return _top_reviewed(rows, ["src_ip"], limit)


def top_target_assets(rows: DataFrame, limit: int = 5) -> DataFrame:
    return _top_reviewed(rows.withColumn("dst_port", F.coalesce("dst_port", F.lit(0))), ["dst_ip", "dst_port"], limit)


def _per_day_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per day the most frequent reviewed key: counts first, then one argmax per day."""
    first = F.min(F.struct(F.coalesce("start_ms", F.lit(0)).alias("t"), F.col("flow_id").alias("f")))
    counted = rows.filter(F.col("verdict").isin("alert", "uncertain")).groupBy("day", *keys).agg(
        F.count("*").alias("n"), first.alias("seen")
    )
    rank = F.struct((-F.col("n")).alias("neg"), "seen")
    return counted.groupBy("day").agg(F.min_by(F.struct(*keys, "n"), rank).alias("first"))


def daily_summary(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per local day: counters, calls, risk, summary text and up to four first checks."""
    verdict, route = F.col("verdict"), F.col("route")
    totals = rows.groupBy("day").agg(
        F.count("*").alias("flow_count"),
        F.count_if(route == "auto_dismiss").alias("dismissed"),
        F.count_if(route == "tier1_llm").alias("reviewed"),
        F.count_if(route == "auto_alert").alias("auto_alerts"),
        F.count_if(verdict == "alert").alias("alerts"),
        F.count_if(verdict == "uncertain").alias("uncertain"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(S.watchlist_hit(F.col("fallback_source"))).alias("fallbacks"),
        F.count_if(S.watchlist_hit(F.col("watchlist_matched"))).alias("watchlist_hit_count"),
        F.count_if(F.coalesce("dynamic_threshold_applied", F.lit(False))).alias("dynamic_threshold_applied_count"),
        F.min_by(
            F.struct("flow_id", "src_ip", "dst_ip", F.coalesce("dst_port", F.lit(0)).alias("dst_port")),
            F.when(
                verdict == "alert",
                F.struct(
                    (-severity_rank(F.coalesce("severity", F.lit("none")))).alias("a"),
                    (-F.coalesce("ml_prob", F.lit(0.0))).alias("b"), F.coalesce("start_ms", F.lit(0)).alias("c"), "flow_id",
                ),
            ),
        ).alias("top_alert"),
    )
    sources = _per_day_first(rows, ["src_ip"]).withColumnRenamed("first", "top_source")
    talk = call_stats(calls.join(rows.select("flow_id", "day"), "flow_id"), "day")
    level = risk_level(*[F.col(c) for c in ("alerts", "critical", "uncertain", "fallbacks")])
    merged = totals.join(sources, "day", "left").join(talk, "day", "left").withColumn("risk_level", level)
    return merged.withColumns({"summary_text": summary_text(), "first_checks": first_checks()})


def _say(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in columns])


def summary_text() -> Column:
    opening = _say(K.SUMMARY_OPENING, "flow_count", "dismissed", "reviewed")
    alerts = F.when(F.col("alerts") > 0, _say(K.SUMMARY_ALERTS, "alerts", "auto_alerts")).otherwise(K.SUMMARY_NO_ALERTS)
    review = F.when(F.col("uncertain") > 0, _say(K.SUMMARY_UNCERTAIN, "uncertain")).otherwise(K.SUMMARY_NO_UNCERTAIN)
    hits = _say(K.SUMMARY_HITS, "watchlist_hit_count")
    tail = F.when(F.col("fallbacks") > 0, _say(K.SUMMARY_FALLBACKS, "fallbacks")).otherwise("")
    return F.concat(F.concat_ws(" ", opening, alerts, review, hits), tail)


def first_checks(limit: int = 4) -> Column:
    checks = F.array_compact(
        F.array(
            F.when(F.col("alerts") > 0, _say(K.CHECK_ALERT, "top_alert.flow_id", "top_alert.src_ip", "top_alert.dst_ip", "top_alert.dst_port")),
            F.when(F.col("top_source").isNotNull(), _say(K.CHECK_SOURCE, "top_source.src_ip", "top_source.n")),
            F.when(F.col("uncertain") > 0, _say(K.CHECK_UNCERTAIN, "uncertain")),
            F.when(F.col("fallbacks") > 0, _say(K.CHECK_FALLBACKS, "fallbacks")),
        )
    )
    return F.when(F.size(checks) == 0, F.array(F.lit(K.CHECK_NONE))).otherwise(F.slice(checks, 1, limit))


# --- history for curation --------------------------------------------------------


def history_counts(flows: DataFrame, routes: DataFrame, verdicts: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Counters over flows that arrived in the last days: (dimension, value, n)."""
    recent = recent_arrivals(flows, now, days).select("flow_id")
    by_route = recent.join(routes.select("flow_id", "route"), "flow_id").select(
        F.array(F.struct(F.lit("route").alias("dimension"), F.col("route").alias("value"))).alias("tags")
    )
    judged = recent.join(verdicts.select("flow_id", "verdict", "watchlist_matched", "fallback_source"), "flow_id").select(
        F.array(
            F.struct(F.lit("verdict").alias("dimension"), S.countable(F.col("verdict")).alias("value")),
            F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
            F.struct(F.lit("watchlist").alias("dimension"), F.when(S.watchlist_hit(F.col("watchlist_matched")), "all").alias("value")),
            F.struct(F.lit("fallback").alias("dimension"), F.when(S.watchlist_hit(F.col("fallback_source")), "all").alias("value")),
        ).alias("tags")
    )
    tags = by_route.unionByName(judged).select(F.explode("tags").alias("t")).filter(F.col("t.value").isNotNull())
    return tags.groupBy(F.col("t.dimension").alias("dimension"), F.col("t.value").alias("value")).agg(F.count("*").alias("n"))


def recent_arrivals(flows: DataFrame, now: str, days: int = 7) -> DataFrame:
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    return flows.filter(F.col("created_at") >= since)


def history_alerts(flows: DataFrame, verdicts: DataFrame, now: str, days: int = 7, limit: int = 50) -> DataFrame:
    """Up to 50 high, critical or alert rows; ordered by time and id so that the list is stable."""
    severity = F.lower(F.coalesce("severity", F.lit("")))
    verdict = S.countable(F.col("verdict"))
    rows = recent_arrivals(flows, now, days).join(verdicts.select("flow_id", "verdict", "severity"), "flow_id")
    kept = rows.filter(severity.isin("high", "critical") | (verdict == "alert"))
    top = kept.orderBy(F.coalesce("start_ms", F.lit(0)), "flow_id").limit(limit)
    return top.select("flow_id", "start_ms", "src_ip", "dst_ip", "dst_port", verdict.alias("verdict"), severity.alias("severity"))


def memory_report(counts: DataFrame, alerts: DataFrame, limit: int = 5) -> DataFrame:
    """Weekly totals and the first alerts as text lines (position, line)."""
    totals = counts.agg(
        F.coalesce(F.sum(F.when(F.col("dimension") == "total", F.col("n"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("dimension") == "watchlist", F.col("n"))), F.lit(0)).alias("hits"),
    )
    head = totals.select(
        F.posexplode(F.array(_say(K.MEMORY_TOTAL, "total"), _say(K.MEMORY_HITS, "hits"))).alias("pos", "line")
    )
    first = alerts.orderBy(F.coalesce("start_ms", F.lit(0)), "flow_id").limit(limit)
    line = _say("- %s -> %s:%d (%s, %s)", "src_ip", "dst_ip", "dst_port", "verdict", "severity")
    entries = F.array_sort(F.collect_list(F.struct(F.coalesce("start_ms", F.lit(0)).alias("t"), "flow_id", line.alias("line"))))
    listed = first.agg(entries.alias("e")).select(F.posexplode("e").alias("p", "x")).select(
        (F.col("p") + 2).alias("pos"), F.col("x.line").alias("line")
    )
    return head.unionByName(listed)


def list_summaries(summaries: DataFrame, limit: int | None = None, date: str | None = None) -> DataFrame:
    """Newest first with the headline fields."""
    kept = summaries.filter(F.col("day").cast("string") == date) if date else summaries
    ordered = kept.orderBy(F.desc("day"))
    ordered = ordered.limit(limit) if limit else ordered
    label = S.case_of(F.col("risk_level"), K.RISK_LABELS, "Unknown")
    return ordered.select(F.col("day").cast("string").alias("date"), label.alias("risk_label"), "flow_count", "watchlist_hit_count")
