"""Stored events: assembly, recent lists, reports, detail, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions import scalars as S
from netsift.functions.timefn import event_date_utc, ntz_millis
from netsift.operators.ranks import range_rank

EVENT_COLUMNS = [
    "flow_id", "start_ms", "end_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "raw_label",
    "raw_attack", "created_at", "prob", "category_hint", "category_confidence", "route", "route_reason",
    "adjusted_by_watchlist", "effective_review_threshold", "dynamic_threshold_applied",
    "dynamic_threshold_reason", "verdict", "severity", "watchlist_matched", "fallback_source", "fallback_reason",
]


def assemble(flows: DataFrame, ml_results: DataFrame, routes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """flows with their model result, route and verdict; three left joins on the unique flow id."""
    return (
        flows.join(ml_results, "flow_id", "left")
        .join(routes, "flow_id", "left")
        .join(verdicts, "flow_id", "left")
        .select(*EVENT_COLUMNS)
    )


def complete_events(flows: DataFrame, routes: DataFrame, verdicts: DataFrame, ids: DataFrame) -> DataFrame:
    """Only flows with route and verdict, restricted to an id table."""
    return flows.join(ids.select("flow_id"), "flow_id", "left_semi").join(routes, "flow_id").join(verdicts, "flow_id")


def events_with_calls(events: DataFrame, calls: DataFrame) -> DataFrame:
    return events.join(calls, "flow_id", "left")


def fan_out(joined: DataFrame, ids: DataFrame) -> DataFrame:
    """Row count against id count: unequal counts mean a join multiplied or lost events."""
    rows = joined.agg(F.count("*").alias("row_count"))
    wanted = ids.agg(F.count("*").alias("id_count"))
    return rows.join(wanted, how="cross").withColumn("ok", F.col("row_count") == F.col("id_count"))


def require_no_fan_out(joined: DataFrame, ids: DataFrame) -> DataFrame:
    check = fan_out(joined, ids).first()
    if not check["ok"]:
        raise ValueError(f"expected {check['id_count']} rows, got {check['row_count']}")
    return joined


def with_state(events: DataFrame) -> DataFrame:
    """Adds ``processing_state``; a review without verdict shows as processing / pending."""
    waiting = F.col("verdict").isNull() & (F.col("route") == "tier1_llm")
    state = S.processing_state(F.col("verdict"), F.col("route"))
    return events.withColumn("processing_state", state).withColumns(
        {
            "verdict": F.when(waiting, "processing").otherwise(F.col("verdict")),
            "severity": F.when(waiting, "pending").otherwise(F.col("severity")),
        }
    )


def recency() -> list[Column]:
    """Newest first; the flow id settles full ties."""
    return [F.coalesce("start_ms", F.lit(0)).desc(), F.col("created_at").desc(), F.col("flow_id").desc()]


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """Latest n events, 1..500 (a top-k, never a full sort)."""
    return with_state(events.orderBy(*recency()).limit(max(1, min(int(limit), 500))))


def report_predicates(
    severity: str | None = None, verdict: str | None = None, asset: str | None = None, watchlist_hit: bool | None = None
) -> Column:
    test = F.lit(True)
    if severity:
        test = test & (F.lower("severity") == severity.lower())
    if verdict:
        test = test & (F.lower("verdict") == verdict.lower())
    if asset:
        test = test & ((F.col("src_ip") == asset) | (F.col("dst_ip") == asset))
    if watchlist_hit is not None:
        hit = S.watchlist_hit(F.col("watchlist_matched"))
        test = test & (hit if watchlist_hit else ~hit)
    return test


def report_events(
    events: DataFrame, *, limit: int = 250, date: str | None = None, pushdown: bool = False, **filters
) -> DataFrame:
    """Filtered latest n events, 1..1000.

    The date filter applies after the limit; ``pushdown=True`` applies it
    before, which is what most readers expect but gives other rows.
    """
    limit = max(1, min(int(limit), 1000))
    kept = events.filter(report_predicates(**filters))
    day = event_date_utc(F.col("start_ms"), F.col("created_at"))
    if date and pushdown:
        kept = kept.filter(day == date)
    top = kept.orderBy(*recency()).limit(limit)
    if date and not pushdown:
        top = top.filter(day == date)
    return with_state(top)


def event_detail(
    flow_id: str, flows: DataFrame, ml_results: DataFrame, routes: DataFrame, verdicts: DataFrame, calls: DataFrame
) -> DataFrame:
    """One event with its call log, newest call first; the id filter reaches every scan."""
    one = lambda df: df.filter(F.col("flow_id") == flow_id)
    rows = detail_frame(one(flows), one(ml_results), one(routes), one(verdicts), one(calls))
    return rows.orderBy(F.desc("call_at"))


def detail_frame(
    flows: DataFrame, ml_results: DataFrame, routes: DataFrame, verdicts: DataFrame, calls: DataFrame
) -> DataFrame:
    """Events with their calls, one row per call: a flow with many calls is never gathered into a list."""
    log = calls.select(
        "flow_id", F.col("created_at").alias("call_at"), "provider", "model_name", "latency_ms", "tokens_used", "success"
    )
    return with_state(assemble(flows, ml_results, routes, verdicts)).join(log, "flow_id", "left")


def filter_options(events: DataFrame, flows: DataFrame, assets: int = 250) -> DataFrame:
    """Long table (kind, value): severities, verdicts, dates of the latest 1000 flows, first assets."""
    latest = flows.select("flow_id", "start_ms", "created_at").orderBy(*recency()).limit(1000)
    dates = latest.select(event_date_utc(F.col("start_ms"), F.col("created_at")).alias("value")).distinct()
    column = lambda name: (
        events.filter(F.coalesce(F.col(name) != "", F.lit(False))).select(F.col(name).alias("value")).distinct()
    )
    ends = union_of_ends(flows).orderBy("value").limit(assets)
    parts = {"date": dates, "severity": column("severity"), "verdict": column("verdict"), "asset": ends}
    result = None
    for kind, frame in parts.items():
        tagged = frame.select(F.lit(kind).alias("kind"), "value")
        result = tagged if result is None else result.unionByName(tagged)
    return result


def union_of_ends(flows: DataFrame) -> DataFrame:
    """Distinct non-empty source and destination addresses, from one scan."""
    ends = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("value"))
    return ends.filter(F.coalesce(F.col("value") != "", F.lit(False))).distinct()


def count_by(df: DataFrame, dimensions: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """Several counters over the same rows in one pass: (dimension, value, n) plus sums.

    Each row is tagged once per dimension and pre-aggregated before the
    shuffle, so the shuffle carries counters, not rows. Null values are skipped.
    """
    tags = F.array(*[F.struct(F.lit(name).alias("dimension"), column.cast("string").alias("value")) for name, column in dimensions.items()])
    counted = df.select(F.explode(tags).alias("t"), *[c.alias(n) for n, c in (extra or {}).items()])
    return (
        counted.filter(F.col("t.value").isNotNull())
        .groupBy(F.col("t.dimension").alias("dimension"), F.col("t.value").alias("value"))
        .agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in (extra or {})])
    )


def dashboard_counters(events: DataFrame, limit: int = 100) -> DataFrame:
    """Counters over the latest events; reviews still running count as pending only."""
    latest = recent_events(events, limit)
    pending = F.col("processing_state") == "tier1_processing"
    known = lambda name: S.countable(F.col(name))
    return count_by(
        latest,
        {
            "total": F.lit("all"),
            "route": known("route"),
            "verdict": F.when(~pending, known("verdict")),
            "severity": F.when(~pending, known("severity")),
            "watchlist_hits": F.when(S.watchlist_hit(F.col("watchlist_matched")), "all"),
            "fallbacks": F.when(S.watchlist_hit(F.col("fallback_source")), "all"),
            "pending": F.when(pending, "all"),
        },
    )


def new_reviews(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Review ids of this snapshot that the previous one did not have; none on the first snapshot."""
    is_review = F.lower(F.coalesce("verdict", F.lit(""))) == "uncertain"
    now = current.filter(is_review).select("flow_id").distinct()
    if previous is None:
        return now.limit(0)
    return now.join(previous.filter(is_review).select("flow_id"), "flow_id", "left_anti")


def dashboard_kpis(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    verdict = F.lower(F.coalesce("verdict", F.lit("")))
    severe = F.lower(F.coalesce("severity", F.lit(""))).isin("high", "critical")
    totals = current.agg(
        F.count_if(verdict == "alert").alias("alerts"),
        F.count_if((verdict == "alert") & severe).alias("severe_alerts"),
        F.count_if(verdict == "uncertain").alias("uncertain_total"),
    )
    fresh = new_reviews(current, previous).agg(F.count("*").alias("new_reviews"))
    return totals.join(fresh, how="cross")


def table_counts(tables: dict[str, DataFrame], routes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(kind, value, n): rows per table, routes, verdicts, fallbacks."""
    result = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(name).alias("value"), "n")
        result = part if result is None else result.unionByName(part)
    for kind, df, column in (("route", routes, "route"), ("verdict", verdicts, "verdict"), ("fallback", verdicts, "fallback_source")):
        part = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        result = result.unionByName(part.select(F.lit(kind).alias("kind"), "value", "n"))
    return result


def page_events(events: DataFrame, page: int, size: int) -> DataFrame:
    """Page n of the newest-first list; the page is clamped to the existing ones."""
    ranked = range_rank(events, recency(), "_place", total="_all")
    pages = F.greatest(F.lit(1), F.ceil(F.col("_all") / size))
    wanted = F.greatest(F.lit(1), F.least(F.lit(page), pages))
    on_page = ranked.filter(F.ceil(F.col("_place") / size) == wanted)  # at most ``size`` rows
    return on_page.orderBy("_place").drop("_place", "_all")


def outcome_trend(events: DataFrame) -> DataFrame:
    """Outcome counts over at most 12 equal time buckets taken from the data."""
    at = F.coalesce(F.col("start_ms"), ntz_millis(F.col("created_at")))
    rows = events.select(at.alias("at"), S.trend_series(F.col("verdict"), F.col("route")).alias("series")).filter(
        F.col("at").isNotNull() & F.col("series").isNotNull()
    )
    bounds = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).select(
        "lo", F.least(F.lit(12), F.greatest(F.lit(4), F.col("n"))).alias("buckets"),
        F.greatest(F.lit(1), F.col("hi") - F.col("lo")).alias("span"),
    ).withColumn("size", F.greatest(F.lit(1), F.ceil(F.col("span") / F.col("buckets"))))
    placed = rows.join(F.broadcast(bounds), how="cross").withColumn(  # one row of bounds
        "bucket", F.least(F.col("buckets") - 1, F.floor((F.col("at") - F.col("lo")) / F.col("size")))
    )
    return placed.groupBy("bucket").agg(
        F.min(F.col("lo") + F.col("bucket") * F.col("size")).alias("bucket_ms"),
        *[F.count_if(F.col("series") == s).alias(s) for s in ("dismiss", "alert", "uncertain")],
    )
