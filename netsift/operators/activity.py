"""Trailing-window activity per source, exact and safe for hot sources.

A range frame over one source would put a third of all rows into one task and
re-read the frame for every row. Instead each flow becomes two ticks, one that
enters the count at its own time and one that leaves it after the window, and
every counter is a running sum of ticks. The time of a hot source is cut into panes
of equal row count, the sums of earlier panes travel as carry rows, and the
work is shuffled once by (source, pane).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.ranks import range_sums
from netsift.session import run_folder
from netsift.sources.sinks import settle

MINUTE_MS = 60_000
PANE_ROWS = 200_000
MOST_HOT = 100_000
MOST_PANES = 4_096
CARRIED = -(1 << 62)  # the time of carry rows, before all others

SERVICE = ["dst_ip", "dst_port", "protocol"]


def with_panes(rows: DataFrame, at: str = "at", pane_rows: int = PANE_ROWS) -> DataFrame:
    """Adds ``pane``: 0, or for hot sources the number of the stretch of time that a row falls in.

    A source is hot above ``pane_rows`` rows and one row in ``MOST_HOT``, so there are at most MOST_HOT. Its stretches hold
    ``pane_rows`` rows each (more, if there would be more than ``MOST_PANES``): the rows before an instant, divided
    by that size, name its pane. So a burst makes many short panes for itself and changes no other. Rows of one instant
    stay together. Sums over the panes of a source read at most MOST_PANES of them.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("src_ip").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    hot = sizes.join(F.broadcast(total), F.col("n") > F.greatest(F.lit(pane_rows), F.col("total") / MOST_HOT))
    size = F.greatest(F.lit(pane_rows), F.ceil(F.col("n") / MOST_PANES)).cast("bigint")
    hot = settle(hot.select("src_ip", size.alias("size")), run_folder(spark, "hot-sources"))
    if hot.isEmpty():
        return rows.withColumn("pane", F.lit(0).cast("bigint"))
    instants = rows.join(F.broadcast(hot), "src_ip").groupBy("src_ip", at).agg(F.count("*").alias("m"), F.max("size").alias("size"))
    placed = range_sums(instants, [at], {"upto": F.col("m")}, keys=["src_ip"])
    placed = placed.select("src_ip", at, F.floor((F.col("upto") - F.col("m")) / F.col("size")).alias("_pane"))
    return rows.join(placed, ["src_ip", at], "left").withColumn("pane", F.coalesce("_pane", F.lit(0)).cast("bigint")).drop("_pane")


def _ticks(flows: DataFrame, keys: list[str], window_ms: int | None, pane_rows: int) -> DataFrame:
    """Two ticks per flow with their panes, +1 at its time and -1 after the window."""
    kind = "struct<flow_id:string,at:bigint,delta:bigint>"
    enter = F.struct(F.col("flow_id"), F.col("start_ms"), F.lit(1)).cast(kind)
    ticks = [enter]
    if window_ms is not None:
        ticks.append(F.struct(F.lit(None), F.col("start_ms") + window_ms, F.lit(-1)).cast(kind))
    exploded = flows.select("src_ip", *keys, F.explode(F.array(*ticks)).alias("t"))
    return with_panes(exploded.select("src_ip", *keys, "t.flow_id", "t.at", "t.delta"), "at", pane_rows)


def _earlier(keys: list[str]):
    return Window.partitionBy("src_ip", *keys).orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)


def trailing_counts(flows: DataFrame, window_ms: int | None, *, pane_rows: int = PANE_ROWS) -> DataFrame:
    """flow_id plus flow_count, distinct_dst_count, same_dst_count, same_dst_port_count, watchlist_hit_count.

    Counts flows of the same source with ``start - window <= t < start``;
    ``window_ms=None`` counts everything earlier. Rows need a start_ms; an
    optional boolean ``hit`` column marks earlier flows with a watchlist hit.
    """
    hits = "hit" in flows.columns
    keys = [*SERVICE, *(["hit"] if hits else [])]
    ticks = _ticks(flows.select("flow_id", "src_ip", *keys, "start_ms"), keys, window_ms, pane_rows)
    nothing = F.lit(0).cast("bigint")
    hit_delta = F.when(F.col("hit"), F.col("delta")).otherwise(nothing) if hits else nothing

    # Pane totals, each level from the finer one; every level feeds the carry rows of its own.
    by_svc = ticks.groupBy("src_ip", *SERVICE, "pane").agg(F.sum("delta").alias("delta"), F.sum(hit_delta).alias("d_hit"))
    by_dst = by_svc.groupBy("src_ip", "dst_ip", "pane").agg(F.sum("delta").alias("delta"), F.sum("d_hit").alias("d_hit"))
    before_dst = F.coalesce(F.sum("delta").over(_earlier(["dst_ip"])), nothing)
    dst_state = by_dst.withColumn("before", before_dst)
    turned = (F.col("before") + F.col("delta") > 0).cast("bigint") - (F.col("before") > 0).cast("bigint")
    by_src = dst_state.groupBy("src_ip", "pane").agg(
        F.sum("delta").alias("delta"), F.sum("d_hit").alias("d_hit"), F.sum(turned).alias("d_distinct"),
    )

    text, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    start = F.lit(CARRIED).alias("at")

    def row(dst, port, protocol, flow_id, at, src, dst_delta, svc, hit, distinct):
        return [
            "src_ip", "pane", dst.alias("dst_ip"), port.alias("dst_port"), protocol.alias("protocol"), flow_id.alias("flow_id"), at,
            src.alias("d_src"), dst_delta.alias("d_dst"), svc.alias("d_svc"), hit.alias("d_hit"), distinct.alias("c_distinct"),
        ]

    delta, c = F.col("delta"), F.col
    levels = ticks.select(*row(c("dst_ip"), c("dst_port"), c("protocol"), c("flow_id"), c("at"), delta, delta, delta, hit_delta, nothing))
    so_far = lambda name, keys: F.sum(name).over(_earlier(keys))
    carry_src = by_src.select(
        *row(text, whole, text, text, start, so_far("delta", []), nothing, nothing, so_far("d_hit", []), so_far("d_distinct", []))
    ).filter("d_src > 0")
    carry_dst = dst_state.filter("before > 0").select(*row(c("dst_ip"), whole, text, text, start, nothing, c("before"), nothing, nothing, nothing))
    carry_svc = by_svc.select(
        *row(c("dst_ip"), c("dst_port"), c("protocol"), text, start, nothing, nothing, so_far("delta", SERVICE), nothing, nothing)
    ).filter("d_svc > 0")
    rows = levels.unionByName(carry_src).unionByName(carry_dst).unionByName(carry_svc)
    rows = rows.repartition("src_ip", "pane")

    def over(*keys: str):
        return Window.partitionBy("src_ip", "pane", *keys).orderBy("at")

    strictly = (Window.unboundedPreceding, -1)
    by_target = over("dst_ip")
    active = rows.withColumns(
        {
            "same_dst_port_count": F.sum("d_svc").over(over(*SERVICE).rangeBetween(*strictly)),
            "same_dst_count": F.sum("d_dst").over(by_target.rangeBetween(*strictly)),
            "after_dst": F.sum("d_dst").over(by_target.rangeBetween(Window.unboundedPreceding, 0)),
            "position": F.row_number().over(by_target),
            "earlier": F.count("*").over(by_target.rangeBetween(*strictly)),
        }
    )
    # A destination turns active or idle at this instant: +1 / -1 distinct, once per instant.
    # Carry rows hold no tick of their own: they restore the level the pane opens with.
    first = F.col("position") == F.col("earlier") + 1
    change = (F.col("after_dst") > 0).cast("bigint") - (F.coalesce("same_dst_count", F.lit(0)) > 0).cast("bigint")
    active = active.withColumn("d_distinct", F.when((F.col("d_src") != 0) & (F.col("d_dst") != 0) & first, change).otherwise(F.col("c_distinct")))

    by_source = over().rangeBetween(*strictly)
    zero = F.lit(0)
    return active.select(
        "flow_id",
        F.coalesce(F.sum("d_src").over(by_source), zero).alias("flow_count"),
        F.coalesce(F.sum("d_distinct").over(by_source), zero).alias("distinct_dst_count"),
        F.coalesce("same_dst_count", zero).alias("same_dst_count"),
        F.coalesce("same_dst_port_count", zero).alias("same_dst_port_count"),
        F.coalesce(F.sum("d_hit").over(by_source), zero).alias("watchlist_hit_count"),
    ).filter(F.col("flow_id").isNotNull())


def untimed_counts(flows: DataFrame) -> DataFrame:
    """Flows without a time see every other row of their source (no window); only their sources are counted."""
    wanted = flows.filter(F.col("start_ms").isNull()).select("src_ip").distinct()
    flows = flows.join(wanted, "src_ip", "left_semi")
    if "hit" not in flows.columns:
        flows = flows.withColumn("hit", F.lit(False))
    hit = F.col("hit").cast("bigint")
    by_service = flows.groupBy("src_ip", *SERVICE).agg(F.count("*").alias("n_svc"), F.sum(hit).alias("h"))
    by_dst = by_service.groupBy("src_ip", "dst_ip").agg(F.sum("n_svc").alias("n_dst"), F.sum("h").alias("h"))
    by_src = by_dst.groupBy("src_ip").agg(
        F.sum("n_dst").alias("n_src"), F.count("*").alias("n_targets"), F.sum("h").alias("h_src")
    )
    return (
        flows.filter(F.col("start_ms").isNull())
        .join(by_service.drop("h"), ["src_ip", *SERVICE])
        .join(by_dst.drop("h"), ["src_ip", "dst_ip"])
        .join(by_src, "src_ip")
        .select(
            "flow_id",
            (F.col("n_src") - 1).alias("flow_count"),
            (F.col("n_targets") - (F.col("n_dst") == 1).cast("bigint")).alias("distinct_dst_count"),
            (F.col("n_dst") - 1).alias("same_dst_count"),
            (F.col("n_svc") - 1).alias("same_dst_port_count"),
            (F.col("h_src") - hit).alias("watchlist_hit_count"),
        )
    )


def source_counts(flows: DataFrame, window_minutes: int, **panes) -> DataFrame:
    """Activity counters for all flows, timed or not."""
    timed = trailing_counts(flows.filter(F.col("start_ms").isNotNull()), window_minutes * MINUTE_MS, **panes)
    return timed.unionByName(untimed_counts(flows))


def with_stored_verdicts(flows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``stored_verdict`` and ``hit`` from the verdicts (flow_id, verdict, watchlist_matched) of earlier runs; one per flow."""
    hit = F.coalesce(F.col("watchlist_matched") != "", F.lit(False))
    known = stored.select("flow_id", F.col("verdict").alias("stored_verdict"), hit.alias("hit"))
    return flows.join(known, "flow_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def with_feedback(flows: DataFrame, stored: DataFrame, window_minutes: int = 180, **panes) -> DataFrame:
    """Flows plus activity counters with earlier watchlist hits, ``recent_verdicts`` and the alerts among them."""
    # Stored once: panes, ticks and verdicts read the flows many times, and each reading would join the verdicts again.
    known = settle(with_stored_verdicts(flows, stored), run_folder(flows.sparkSession, "feedback-flows"))
    rows = known.select("flow_id", "src_ip", "start_ms", F.col("stored_verdict").alias("verdict"))
    timed = recent_verdicts(rows.filter(F.col("start_ms").isNotNull()), window_minutes * MINUTE_MS, **panes)
    recent = timed.unionByName(untimed_verdicts(rows))
    return with_activity(known, window_minutes, **panes).join(recent, "flow_id").drop("stored_verdict", "hit")


def untimed_verdicts(flows: DataFrame, limit: int = 5) -> DataFrame:
    """Flows without a time see the newest verdicts of all other rows of their source, untimed ones last."""
    newest = Window.partitionBy("src_ip").orderBy(F.coalesce("start_ms", F.lit(0)).desc(), F.desc("flow_id"))
    judged = flows.filter(F.coalesce(F.col("verdict") != "", F.lit(False))).withColumn("rn", F.row_number().over(newest))
    kept = judged.filter(F.col("rn") <= limit + 1)  # one more than is shown, as a flow does not see itself
    item = F.struct("rn", F.col("flow_id").alias("id"), "verdict")
    last = kept.groupBy("src_ip").agg(F.array_sort(F.collect_list(item)).alias("items"))
    found = flows.filter(F.col("start_ms").isNull()).join(last, "src_ip", "left")
    others = F.slice(F.filter(F.coalesce("items", F.array().cast(last.schema["items"].dataType)), lambda x: x["id"] != F.col("flow_id")), 1, limit)
    return found.withColumn("seen", F.transform(others, lambda x: x["verdict"])).select(
        "flow_id", F.col("seen").alias("recent_verdicts"), F.size(F.filter("seen", lambda v: v == "alert")).cast("bigint").alias("recent_alert_count")
    )


def with_activity(flows: DataFrame, window_minutes: int = 180, **panes) -> DataFrame:
    """Flows plus their activity counters, with or without a time; the join back is on the unique flow id."""
    return flows.join(source_counts(flows, window_minutes, **panes), "flow_id")


# --- most frequent ports ------------------------------------------------------


def _rank_ports(limit: int, first_seen: bool):
    """Streams sorted (source, pane) runs, keeping the ports of the run sorted by frequency.

    Batches arrive sorted, so memory holds one batch and the ports of one run. A batch may hold no flow (a run can open with
    many carry rows), so the columns sent back have types of their own. Rows without a port rank last.
    """
    from bisect import bisect_left, insort

    kinds = [pa.string(), pa.list_(pa.int32())]

    def walk(batches):
        run = None
        for rows in batches:
            out_ids: list[str] = []
            out_ports: list[list[int]] = []
            for src, pane, at, flow_id, port, delta, seen_at in zip(
                *[rows.column(c).to_pylist() for c in ("src_ip", "pane", "at", "flow_id", "dst_port", "delta", "seen_at")],
                strict=True,
            ):
                port = (port is None, port)
                if (src, pane) != run:
                    run, current = (src, pane), at
                    count: dict[tuple, int] = {}
                    seen: dict[tuple, int] = {}
                    ranked: list[tuple] = []
                    pending: list[tuple[tuple, int, int]] = []
                if at != current:
                    current = at
                    for p, d, s in pending:
                        held = count.get(p, 0)
                        if held > 0:
                            del ranked[bisect_left(ranked, (-held, seen[p], p))]
                        seen[p] = min(seen.get(p, s), s) if first_seen else 0
                        count[p] = held + d
                        if held + d > 0:
                            insort(ranked, (-held - d, seen[p], p))
                    pending = []
                if flow_id is not None:
                    out_ids.append(flow_id)
                    out_ports.append([item[2][1] for item in ranked[:limit]])
                pending.append((port, delta, seen_at))
            columns = [pa.array(found, kind) for found, kind in zip((out_ids, out_ports), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["flow_id", "top_dst_ports"])

    return walk


def top_ports(
    flows: DataFrame, window_ms: int | None, limit: int = 5, *, pane_rows: int = PANE_ROWS
) -> DataFrame:
    """flow_id and the most frequent destination ports of the window.

    Ties go to the lower port with a window, to the first seen port without
    one. A pane starts from the port counts left open by earlier panes, at most
    one row per port: 65,536, fewer than the rows of a full pane.
    """
    flows = flows.select("flow_id", "src_ip", "dst_port", "start_ms")
    ticks = _ticks(flows, ["dst_port"], window_ms, pane_rows).withColumn("seen_at", F.col("at"))
    change = ticks.groupBy("src_ip", "dst_port", "pane").agg(F.sum("delta").alias("delta"), F.min("at").alias("seen_at"))
    so_far = Window.partitionBy("src_ip", "dst_port").orderBy("pane").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("src_ip", "dst_port").orderBy("pane")
    busy = ticks.groupBy("src_ip").agg(F.max("pane").alias("last_pane"))
    open_counts = (
        change.select(
            "src_ip", "dst_port", "pane",
            F.sum("delta").over(so_far).alias("delta"),
            F.min("seen_at").over(so_far).alias("seen_at"),
            F.lead("pane").over(ahead).alias("next_pane"),
        )
        .filter(F.col("delta") > 0)
        .join(busy, "src_ip")
        .withColumn("until", F.coalesce("next_pane", F.col("last_pane")))
        .filter(F.col("until") > F.col("pane"))
        # Only until the port changes again: a count falls to zero within one window.
        .withColumn("pane", F.explode(F.sequence(F.col("pane") + 1, F.col("until"))))
        .select(
            "src_ip", "dst_port", "pane", F.lit(None).cast("string").alias("flow_id"),
            F.lit(CARRIED).alias("at"), "delta", "seen_at",
        )
    )
    rows = ticks.select("src_ip", "dst_port", "pane", "flow_id", "at", "delta", "seen_at").unionByName(open_counts)
    runs = rows.repartition("src_ip", "pane").sortWithinPartitions("src_ip", "pane", "at")
    return runs.mapInArrow(
        _rank_ports(limit, first_seen=window_ms is None), "flow_id string, top_dst_ports array<int>"
    )


# --- latest verdicts ----------------------------------------------------------


def recent_verdicts(
    flows: DataFrame, window_ms: int, limit: int = 5, *, pane_rows: int = PANE_ROWS
) -> DataFrame:
    """flow_id, the last non-null verdicts of the window (newest first), alerts among them."""
    flows = with_panes(flows.select("flow_id", "src_ip", "start_ms", "verdict"), "start_ms", pane_rows)
    instant = Window.partitionBy("src_ip", "pane", "start_ms").orderBy(F.desc("flow_id"))
    groups = (
        flows.filter(F.coalesce(F.col("verdict") != "", F.lit(False)))
        .withColumn("rn", F.row_number().over(instant))
        .filter(F.col("rn") <= limit)
        .groupBy("src_ip", "pane", "start_ms")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("start_ms")).alias("neg_at"), "rn", "verdict"))).alias("items"))
    )

    def newest(items: Column) -> Column:
        return F.slice(F.array_sort(F.flatten(items)), 1, limit)

    in_pane = Window.partitionBy("src_ip", "pane").orderBy("start_ms").rowsBetween(1 - limit, 0)
    trail = groups.withColumn("items", newest(F.collect_list("items").over(in_pane)))
    # The newest trail of each pane, handed on to the panes after it.
    closing = trail.groupBy("src_ip", "pane").agg(F.max_by("items", "start_ms").alias("items"))
    panes = flows.select("src_ip", "pane").distinct().join(closing, ["src_ip", "pane"], "left")
    handed = panes.join(
        closing.withColumn("with_self", newest(F.collect_list("items").over(
            Window.partitionBy("src_ip").orderBy("pane").rowsBetween(1 - limit, 0)
        ))).select("src_ip", "pane", "with_self"),
        ["src_ip", "pane"], "left",
    ).select(
        "src_ip", "pane",
        F.last("with_self", ignorenulls=True).over(
            Window.partitionBy("src_ip").orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
        ).alias("handed"),
    )
    null_items = F.lit(None).cast("array<struct<neg_at:bigint,rn:int,verdict:string>>")
    marks = trail.select("src_ip", "pane", "start_ms", "items", F.lit(None).cast("string").alias("flow_id")).unionByName(
        flows.select("src_ip", "pane", "start_ms", null_items.alias("items"), "flow_id")
    )
    before = Window.partitionBy("src_ip", "pane").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    empty = F.array().cast("array<struct<neg_at:bigint,rn:int,verdict:string>>")
    merged = (
        marks.withColumn("near", F.last("items", ignorenulls=True).over(before))
        .filter(F.col("flow_id").isNotNull())
        .join(handed, ["src_ip", "pane"], "left")
        .withColumn("all", F.concat(F.coalesce("near", empty), F.coalesce("handed", empty)))
        .withColumn(
            "kept",
            F.slice(
                F.array_sort(F.filter("all", lambda x: -x["neg_at"] >= F.col("start_ms") - window_ms)), 1, limit
            ),
        )
    )
    return merged.select(
        "flow_id",
        F.transform("kept", lambda x: x["verdict"]).alias("recent_verdicts"),
        F.size(F.filter("kept", lambda x: x["verdict"] == "alert")).cast("bigint").alias("recent_alert_count"),
    )


# --- the full summary, and the store-less form ------------------------------


def source_activity(flows: DataFrame, window_minutes: int = 180) -> DataFrame:
    """Counters, top ports and recent verdicts for timed flows (verdict and hit columns optional)."""
    window_ms = window_minutes * MINUTE_MS
    counts = trailing_counts(flows, window_ms)
    ports = top_ports(flows, window_ms)
    result = counts.join(ports, "flow_id")
    if "verdict" in flows.columns:
        result = result.join(recent_verdicts(flows, window_ms), "flow_id")
    return result


def source_activity_unbounded(flows: DataFrame) -> DataFrame:
    """Everything that arrived earlier, in arrival order; ``arrival`` plays the clock."""
    ordered = flows.drop("start_ms").withColumn("start_ms", F.col("arrival"))
    counts = trailing_counts(ordered, None).drop("watchlist_hit_count")
    return counts.join(top_ports(ordered, None), "flow_id")


def prior_flows(flows: DataFrame, window_minutes: int, *, pane_rows: int = PANE_ROWS) -> DataFrame:
    """How many earlier flows of the same source fall in the window, and when the last one was.

    The self range join without its pairs: the count is a running sum of
    ticks, the last one is the newest earlier time in the pane or, before the
    first flow of a pane, the newest time of the panes before it.
    """
    window_ms = window_minutes * MINUTE_MS
    counts = trailing_counts(flows, window_ms, pane_rows=pane_rows).select("flow_id", F.col("flow_count").alias("prior_count"))
    placed = with_panes(flows.select("flow_id", "src_ip", "start_ms"), "start_ms", pane_rows)
    closing = placed.groupBy("src_ip", "pane").agg(F.max("start_ms").alias("last_ms"))
    earlier = Window.partitionBy("src_ip").orderBy("pane").rowsBetween(Window.unboundedPreceding, -1)
    handed = closing.select("src_ip", "pane", F.max("last_ms").over(earlier).alias("handed_ms"))
    inside = Window.partitionBy("src_ip", "pane").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    last = placed.withColumn("near_ms", F.max("start_ms").over(inside)).join(handed, ["src_ip", "pane"])
    newest = F.coalesce("near_ms", "handed_ms")
    return last.select(
        "flow_id", F.when(newest >= F.col("start_ms") - window_ms, newest).alias("last_prior_ms")
    ).join(counts, "flow_id")
