"""Watchlist matching as joins, for watchlists of any size.

Scope is found on distinct addresses, not on flows: each address meets exact
targets by equality and ranges by (prefix length, prefix), one equality per
length in use. The conditions of both ends are put together once for each pair
of addresses, and flows look their pair up. An item's hints travel
as one array, parsed once, and meet values parsed once per flow, so a (flow, item)
row is graded in place and never moves: what is shuffled is one number per flow,
pre-aggregated, that names the best item. Only that item's lists are then spelled
out. Flows that share an id are rare; their conditions are merged by id, as one
flow has them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import hints as H
from netsift.functions import net
from netsift.functions.scalars import literal_map, number
from netsift.operators.matching import SEQ_SPACE
from netsift.operators.watchlist import Watchlist
from netsift.session import run_folder
from netsift.sources.sinks import settle

BROADCAST_ROWS = 200_000

def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Checked size: reads at most limit + 1 rows."""
    return df.limit(limit + 1).count() <= limit


def _maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only behind a size check; a larger side joins by shuffle (adaptive skew handling applies)."""
    return F.broadcast(df) if small_enough(df, limit) else df


def address_scopes(addresses: DataFrame, targets: DataFrame) -> DataFrame:
    """(side, ip, item_seq, target_seq, pos, condition) for distinct (side, ip) rows."""
    sides = F.when(F.col("side") == "either", F.array(F.lit("dst"), F.lit("src"))).otherwise(F.array("side"))
    rows = targets.withColumn("at", F.explode(sides))
    exact = rows.filter(F.col("ip") != "").select(
        F.col("at").alias("side"), F.col("ip").alias("t_ip"), "item_seq", "target_seq", F.lit(None).cast("string").alias("cidr")
    )
    ranges = rows.filter(F.col("bounds").isNotNull() & (F.col("cidr") != "")).select(
        F.col("at").alias("side"), F.col("bounds.prefix").alias("prefix"), F.col("bounds.lo").alias("lo"), "item_seq", "target_seq", "cidr"
    )
    by_ip = addresses.join(_maybe_broadcast(exact.withColumnRenamed("t_ip", "ip")), ["side", "ip"])
    numbered = addresses.withColumn("key", net.ip_key(F.col("ip"))).filter(F.col("key").isNotNull())
    lengths = ranges.select("side", "prefix", F.substring("lo", 1, 1).alias("family")).distinct()  # at most 33 and 129 per side
    keyed = numbered.withColumn("family", F.substring("key", 1, 1)).join(F.broadcast(lengths), ["side", "family"]).withColumn(
        "lo", net.masked_key(F.col("key"), F.col("prefix"))
    )
    by_range = keyed.join(_maybe_broadcast(ranges), ["side", "prefix", "lo"]).select(
        "side", "ip", "item_seq", "target_seq", "cidr"
    )
    found = by_ip.select("side", "ip", "item_seq", "target_seq", "cidr").unionByName(by_range)
    source = F.when(F.col("side") == "src", 1).otherwise(0)
    pos = F.col("target_seq") * 4 + source + F.when(F.col("cidr").isNull(), 0).otherwise(2)
    text = F.when(
        F.col("cidr").isNull(), F.concat(F.lit("target_assets.ip == flow."), F.col("side"), F.lit("_ip"))
    ).otherwise(F.concat(F.lit("target_assets.cidr "), F.col("cidr"), F.lit(" contains flow."), F.col("side"), F.lit("_ip")))
    return found.select("side", "ip", "item_seq", pos.alias("pos"), text.alias("condition"))


ENDS = ["dst_ip", "src_ip"]


@dataclass
class Scopes:
    """Which items hold a flow in scope, and why."""

    pairs: DataFrame  # dst_ip, src_ip, item_seq, scope_conditions
    repeated: DataFrame  # flow_id of ids that several rows have
    merged: DataFrame  # flow_id, item_seq, scope_conditions of those ids


def flow_scopes(flows: DataFrame, targets: DataFrame) -> Scopes:
    """Scopes by pair of addresses, stored once; by flow for repeated ids only."""
    spark = flows.sparkSession
    ends = F.array(
        F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")), F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip"))
    )
    addresses = flows.select(F.explode(ends).alias("e")).select("e.side", "e.ip").distinct()
    scopes = address_scopes(addresses, targets)
    per_address = scopes.groupBy("side", "ip", "item_seq").agg(
        F.array_sort(F.collect_list(F.struct("pos", "condition"))).alias("conditions")  # bounded by the item's targets
    )
    lookup = _maybe_broadcast(per_address)

    def of(rows: DataFrame, keys: list[str]) -> DataFrame:
        found = rows.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.side", "e.ip").join(lookup, ["side", "ip"])
        both = found.groupBy(*keys, "item_seq").agg(F.flatten(F.collect_list("conditions")).alias("c"))  # two entries a row at most
        return both.select(*keys, "item_seq", F.transform(F.array_sort("c"), lambda x: x["condition"]).alias("scope_conditions"))

    pairs = settle(of(flows.select(*ENDS).distinct(), ENDS), run_folder(spark, "pair-scopes"))
    repeated = settle(flows.groupBy("flow_id").agg(F.count("*").alias("n")).filter("n > 1").select("flow_id"), run_folder(spark, "repeated-flows"))
    same = flows.alias("f").join(repeated.alias("r"), F.col("f.flow_id").eqNullSafe(F.col("r.flow_id")), "left_semi")
    return Scopes(_maybe_broadcast(pairs), _maybe_broadcast(repeated), of(same, ["flow_id"]))


def _single(flows: DataFrame, scopes: Scopes) -> DataFrame:
    """The flows whose id no other row has."""
    return flows.alias("f").join(scopes.repeated.alias("r"), F.col("f.flow_id").eqNullSafe(F.col("r.flow_id")), "left_anti")


def _paired(flows: DataFrame, scopes: Scopes) -> DataFrame:
    """Flows with the items in scope of their pair of addresses; with ``item_seq``, that item only."""
    renamed = scopes.pairs.withColumnsRenamed({"dst_ip": "_dst", "src_ip": "_src", "item_seq": "_item"})
    test = F.col("dst_ip").eqNullSafe(F.col("_dst")) & F.col("src_ip").eqNullSafe(F.col("_src"))
    if "item_seq" in flows.columns:
        return flows.join(renamed, test & (F.col("item_seq") == F.col("_item"))).drop("_dst", "_src", "_item")
    return flows.join(renamed, test).drop("_dst", "_src").withColumnRenamed("_item", "item_seq")


def in_scope(flows: DataFrame, scopes: Scopes) -> DataFrame:
    """Flows with an id and each item they are in scope of (or just ``item_seq``, if they name one)."""
    named = flows.filter(F.col("flow_id").isNotNull())
    merged = named.join(scopes.merged, ["flow_id", "item_seq"] if "item_seq" in flows.columns else ["flow_id"])
    return _paired(_single(named, scopes), scopes).unionByName(merged)


def scope_join(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """(flow_id, item_seq, scope_conditions): flows with every item whose scope they are in."""
    scopes = flow_scopes(flows, targets)
    alone = _paired(_single(flows.select("flow_id", *ENDS), scopes), scopes)
    return alone.select("flow_id", "item_seq", "scope_conditions").unionByName(scopes.merged)


FLAGS = {"metadata_dst": 1, "port_80": 2, "egress_port": 4, "outside_dst": 8}
STRENGTH_BIT = 16  # times two to the power of the strength rank: every hint has one


def _strength_bit(name: str) -> int:
    return STRENGTH_BIT << K.STRENGTH_RANK[name]


def packed_hint(slots: dict[str, int]) -> Column:
    """What one hint needs at a flow, parsed once: its test, typed values, and its strength and flags as bits (``marks``).

    A value is a truth word, a number or a text, and can only equal one of its kind. ``slot`` is the place of the field in
    ``env``; other fields are looked up by name.
    """
    field, op, is_list, vals = (F.col(c) for c in ("field", "operator", "is_list", "vals"))
    no = F.lit(False)
    listed = F.coalesce(F.when(is_list, vals).otherwise(F.slice(vals, 1, 1)), F.array().cast("array<string>"))
    plain = F.filter(listed, lambda v: ~v.isin("true", "false"))
    test = (
        F.when(op.isin("in", "not_in", "nin") & is_list & vals.isNotNull(), "values")
        .when(op.isin("in_cidr", "not_in_cidr") & is_list, "ranges")
        .when((op == "eq") & ~is_list, "values")
        .when(op.isin("gt", "gte", "lt", "lte") & ~is_list, op)
        .otherwise("none")
    )
    marks = F.call_function("shiftleft", F.lit(STRENGTH_BIT), F.col("rank"))
    for flag, bit in FLAGS.items():
        marks = marks + F.when(F.col(flag), bit).otherwise(0)
    name = F.when(op != "", F.coalesce(F.try_element_at(literal_map(K.FIELD_ALIASES), field), field))
    return F.struct(
        "hint_seq", "field", "condition", name.alias("name"), F.try_element_at(literal_map(slots), name).alias("slot"),
        test.alias("test"), (~F.coalesce(op.isin("not_in", "nin", "not_in_cidr"), no)).alias("wanted"),
        F.coalesce(F.array_contains(listed, "true"), no).alias("yes"), F.coalesce(F.array_contains(listed, "false"), no).alias("no"),
        F.filter(F.transform(plain, number), lambda n: n.isNotNull()).alias("nums"),
        F.filter(plain, lambda v: number(v).isNull()).alias("texts"),
        F.filter(F.coalesce("ranges", F.from_json(F.lit("[]"), RANGES)), lambda r: r.isNotNull()).alias("ranges"),
        number(F.get(vals, 0)).alias("limit"), F.coalesce((field == "src_ip") & (op == "in_cidr"), no).alias("source_range"),
        marks.alias("marks"),
    )


RANGES = "array<struct<lo:string,hi:string,prefix:int>>"


def packed_items(watchlist: Watchlist, slots: dict[str, int]) -> DataFrame:
    """One row per item with its hints and groups as arrays (bounded by what one item holds)."""
    hints = watchlist.hints.select("item_seq", "group_seq", "kind", packed_hint(slots).alias("hint"))
    ordered = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("hint"))), _by_hint_seq)
    plain = hints.filter(F.col("group_seq") < 0).groupBy("item_seq").agg(
        ordered(F.col("kind") == "detection").alias("detection"), ordered(F.col("kind") == "benign").alias("benign")
    )
    members = hints.filter(F.col("group_seq") >= 0).groupBy("item_seq", "group_seq").agg(
        ordered(F.col("kind") == "required").alias("required"), ordered(F.col("kind") == "supporting").alias("supporting")
    )
    groups = (
        watchlist.groups.join(members, ["item_seq", "group_seq"])
        .groupBy("item_seq")
        .agg(F.collect_list(F.struct("group_seq", "min_supporting", "required", "supporting")).alias("groups"))
        .withColumn("groups", F.array_sort("groups", lambda a, b: a["group_seq"] - b["group_seq"]))
    )
    packed = watchlist.items.join(plain, "item_seq", "left").join(groups, "item_seq", "left")
    kinds = {f.name: f.dataType for f in packed.schema.fields}
    return packed.withColumns({name: F.coalesce(name, F.from_json(F.lit("[]"), kinds[name])) for name in ("groups", "detection", "benign")})


def _by_hint_seq(a: Column, b: Column) -> Column:
    return a["hint_seq"] - b["hint_seq"]


UNKNOWN, MISS, HIT = 0, 1, 2


def _status(hints: Column) -> Column:
    """For each hint UNKNOWN (no such field, or no operator), MISS or HIT."""

    def matches(h: Column, v: Column) -> Column:
        truth = (h["yes"] | h["no"]) & F.when(H.to_bool(v["text"]), h["yes"]).otherwise(h["no"])
        equal = truth | F.when(v["num"].isNotNull(), F.array_contains(h["nums"], v["num"])).otherwise(
            F.coalesce(F.array_contains(h["texts"], v["text"]), F.lit(False))
        )
        inside = F.when(v["key"].isNotNull(), F.exists(h["ranges"], lambda r: v["key"].between(r["lo"], r["hi"]))).otherwise(False)
        return (
            F.when(h["test"] == "values", equal == h["wanted"])
            .when(h["test"] == "ranges", inside == h["wanted"])
            .when(h["test"] == "gte", v["num"] >= h["limit"])
            .when(h["test"] == "gt", v["num"] > h["limit"])
            .when(h["test"] == "lte", v["num"] <= h["limit"])
            .when(h["test"] == "lt", v["num"] < h["limit"])
        )

    def value(h: Column) -> Column:
        return F.when(h["slot"].isNotNull(), F.get("env", h["slot"])).otherwise(F.try_element_at("extra", h["name"]))

    graded = lambda h, v: F.when(v.isNull(), UNKNOWN).when(matches(h, v), HIT).otherwise(MISS)
    return F.zip_with(hints, F.transform(hints, value), graded)


def _conditions(hints: Column, status: Column, test=lambda h: F.lit(True), of: int = HIT) -> Column:
    """Texts of the hints with a status."""
    return F.transform(F.filter(hints, lambda h, at: (F.get(status, at) == of) & test(h)), lambda h: h["condition"])


def evaluate_hints(scoped: DataFrame) -> DataFrame:
    """Rows (flow env, item hints, scope_conditions) -> statuses, lists and the strength before groups.

    Ranks come from the bits of fired hints; the lists are columns of their own, which nothing else needs.
    """
    source_range = F.exists(
        "scope_conditions", lambda c: c.startswith("target_assets.cidr ") & c.endswith(" contains flow.src_ip")
    )
    hints, status = F.col("detection"), F.col("status")
    d = scoped.withColumns({"status": _status(hints), "source_range": source_range})
    scope_only = lambda h: h["source_range"] & F.col("source_range")
    other = lambda h: ~scope_only(h)
    marks = F.zip_with(hints, status, lambda h, s: F.when((s == HIT) & ~scope_only(h), h["marks"]).otherwise(0))
    d = d.withColumns(
        {
            "marks": F.aggregate(marks, F.lit(0), lambda acc, m: acc.bitwiseOR(m)),
            "recognized": F.exists(status, lambda s: s != UNKNOWN),
            "matched_list": F.concat("scope_conditions", _conditions(hints, status)),
            "scope_list": F.array_distinct(F.concat("scope_conditions", _conditions(hints, status, scope_only))),
            "trigger_list": F.array_distinct(_conditions(hints, status, other)),
            "unmatched_list": F.array_distinct(_conditions(hints, status, other, MISS)),
            "benign_list": F.array_distinct(_conditions(F.col("benign"), _status(F.col("benign")))),
        }
    )
    return d.withColumn("combined_rank", combined_strength())


def combined_strength() -> Column:
    """Strength rank of the fired hints (bits ``marks``) under the scope conditions."""
    has = lambda bit: F.col("marks").bitwiseAND(bit) != 0
    strength = lambda name: has(_strength_bit(name))
    flag = lambda name: has(FLAGS[name])
    R = K.STRENGTH_RANK
    strongest = None
    for name in sorted(R, key=lambda n: -R[n]):
        if R[name] > R["asset_only"]:
            strongest = F.when(strength(name), R[name]) if strongest is None else strongest.when(strength(name), R[name])
    strongest = strongest.otherwise(R["asset_only"])
    service, review = strength("asset_service"), strength("review_candidate")
    egress = flag("outside_dst") & flag("egress_port") & F.exists("scope_conditions", lambda c: c.contains("flow.src_ip"))
    return (
        F.when(F.col("marks") == 0, R["asset_only"])
        .when(flag("metadata_dst") & flag("port_80"), R["critical_forbidden"])
        .when(strongest >= R["behavior"], strongest)
        .when(review & service & egress, R["behavioral_review"])
        .when(review & service, R["review_candidate"])
        .when(strength("behavioral_review"), F.when(service, R["behavioral_review"]).otherwise(R["asset_only"]))
        .when(review, F.when(service, R["asset_service"]).otherwise(R["asset_only"]))
        .otherwise(strongest)
    )


def trigger_groups(rows: DataFrame) -> DataFrame:
    """Adds ``g``: the first complete group, or the joint lists when none is complete, or null without groups.

    ``grouped``, ``group_done``, ``group_supported`` and ``group_touched`` say the same without the lists.
    """
    none = F.array().cast("array<string>")

    def missed(hints: Column, status: Column) -> Column:
        lost = lambda h: F.concat(F.lit("unrecognized trigger hint: "), h["field"])
        texts = F.zip_with(hints, status, lambda h, s: F.struct(s.alias("s"), F.when(s == UNKNOWN, lost(h)).otherwise(h["condition"]).alias("text")))
        return F.transform(F.filter(texts, lambda x: x["s"] != HIT), lambda x: x["text"])

    def short(group: Column, s: Column) -> Column:
        hit = lambda status: F.exists(status, lambda x: x == HIT)
        support = F.size(F.array_distinct(_conditions(group["supporting"], s["supporting"])))
        complete = (F.size(group["required"]) > 0) & F.forall(s["required"], lambda x: x == HIT) & (support >= group["min_supporting"])
        return F.struct(
            complete.alias("complete"), (support > 0).alias("supported"), (hit(s["required"]) | hit(s["supporting"])).alias("touched")
        )

    def spelled(group: Column, s: Column) -> Column:
        matched_support = F.array_distinct(_conditions(group["supporting"], s["supporting"]))
        missing_support = F.array_distinct(missed(group["supporting"], s["supporting"]))
        return F.struct(
            F.array_distinct(F.concat(_conditions(group["required"], s["required"]), matched_support)).alias("matched"),
            missing_support.alias("missing_support"),
            F.array_distinct(F.concat(missed(group["required"], s["required"]), missing_support)).alias("missing"),
        )

    statuses = F.transform(
        "groups", lambda g: F.struct(_status(g["required"]).alias("required"), _status(g["supporting"]).alias("supporting"))
    )
    graded = rows.withColumn("group_status", statuses)
    graded = graded.withColumn("gs", F.zip_with("groups", "group_status", short))
    graded = graded.withColumns(
        {
            "grouped": F.exists("groups", lambda g: F.size(g["required"]) + F.size(g["supporting"]) > 0),
            "group_done": F.exists("gs", lambda g: g["complete"]),
            "group_supported": F.coalesce(F.get(F.filter("gs", lambda g: g["complete"]), 0)["supported"], F.lit(False)),
            "group_touched": F.exists("gs", lambda g: g["touched"]),
            "lists": F.zip_with("groups", "group_status", spelled),
        }
    )
    first = F.get(F.filter("lists", lambda _, at: F.get("gs", at)["complete"]), 0)
    joint = lambda name: F.coalesce(F.array_distinct(F.flatten(F.transform("lists", lambda g: g[name]))), none)
    done = F.col("group_done")
    g = F.struct(
        done.alias("complete"), F.col("group_supported").alias("supported"),
        F.when(done, first["matched"]).otherwise(joint("matched")).alias("matched"),
        F.when(done, first["missing_support"]).otherwise(joint("missing")).alias("missing"),
    )
    return graded.withColumn("g", F.when(F.col("grouped"), g)).drop("gs", "lists", "group_status")


def grade_items(rows: DataFrame) -> DataFrame:
    """Final strength rank, completeness and lists of every (flow, item) row."""
    R = K.STRENGTH_RANK
    rows = trigger_groups(evaluate_hints(rows))
    live, done = F.col("recognized") & F.col("grouped"), F.col("group_done")
    touched = (F.col("marks") != 0) | (live & F.col("group_touched"))
    rank = (
        F.when(~F.col("recognized"), R["asset_only"])
        .when(live & ~done, F.when(touched, R["asset_service"]).otherwise(R["asset_only"]))
        .otherwise(F.col("combined_rank"))
    )
    completeness = (
        F.when(~F.col("recognized"), "scope_only")
        .when(live & done, F.when(F.col("group_supported"), "strong").otherwise("required_met"))
        .when(live, F.when(touched, "partial").otherwise("scope_only"))
        .when(~touched, "scope_only")
        .when(F.col("combined_rank") >= R["behavior"], "strong")
        .when(F.col("combined_rank") >= R["review_candidate"], "required_met")
        .otherwise("partial")
    )
    return rows.withColumns(
        {
            "trigger_list": F.when(live, F.array_union("trigger_list", "g.matched")).otherwise(F.col("trigger_list")),
            "unmatched_list": F.when(live, F.array_union("unmatched_list", "g.missing")).otherwise(F.col("unmatched_list")),
            "matched_list": F.when(live, F.concat("matched_list", F.array_except("g.matched", "matched_list"))).otherwise(F.col("matched_list")),
            "rank": rank,
            "completeness": completeness,
        }
    )


def _hint_flows(flows: DataFrame, activity: bool) -> DataFrame:
    """The flows with what hints may ask of them, parsed. Stored: they are read several times, and each reading would count the activity again.

    Few bytes can mean much grading, so they are dealt to every core, however small they are.
    """
    spark = flows.sparkSession
    slots = H.hint_slots(activity=activity, ml_prob="ml_prob" in flows.columns)
    asked = dict.fromkeys(["flow_id", *slots.values(), *(c for c in flows.columns if c == "features")])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = flows.select(*asked).repartition(parts, "flow_id", *ENDS)
    return settle(dealt.select("flow_id", *ENDS, *H.hint_values(dealt, slots)), run_folder(spark, "hint-flows"))


def _stored_items(flows: DataFrame, watchlist: Watchlist, activity: bool) -> DataFrame:
    slots = H.hint_slots(activity=activity, ml_prob="ml_prob" in flows.columns)
    return settle(packed_items(watchlist, {name: at for at, name in enumerate(slots)}), run_folder(flows.sparkSession, "packed-items"))


def _with_items(scoped: DataFrame, items: DataFrame) -> DataFrame:
    # Items come last: rows do not move once they carry one.
    return grade_items(scoped.drop(*ENDS).join(_maybe_broadcast(items), "item_seq"))


def item_rows(flows: DataFrame, watchlist: Watchlist, *, activity: bool = True) -> DataFrame:
    """Graded (flow, item) rows for every item in scope."""
    stored, items = _hint_flows(flows, activity), _stored_items(flows, watchlist, activity)
    return _with_items(in_scope(stored, flow_scopes(stored, watchlist.targets)), items)


COMPLETENESS = ["scope_only", "partial", "required_met", "strong"]


def _order() -> Column:
    """Strength, priority, earlier item, as one number."""
    weight = F.when(F.col("priority") == "priority_1", 3).when(F.col("priority") == "priority_2", 2).otherwise(1)
    return (F.col("rank") * 4 + weight).cast("bigint") * SEQ_SPACE + (SEQ_SPACE - 1 - F.col("item_seq"))


def best_match(graded: DataFrame) -> DataFrame:
    """The best item per flow: strength, priority, earlier item; partial aggregation before the shuffle.

    One number holds the order, the strength and the completeness. Each other part of the record is taken by itself, and the
    record is made last, so that parts nobody reads are neither made nor moved.
    """
    names = F.array(*[F.lit(n) for n in K.STRENGTH_RANK])
    stages = F.array(*[F.lit(n) for n in COMPLETENESS])
    parts = {
        "priority": "priority", "item_id": "item_id", "reason": "reason", "matched_conditions": "matched_list", "scope_conditions": "scope_list",
        "matched_trigger_hints": "trigger_list", "unmatched_trigger_hints": "unmatched_list", "matched_benign_hints": "benign_list",
        "trigger_completeness": None, "alert_when": "alert_when", "likely_benign_when": "likely_benign_when", "match_strength": None,
        "context_only": "context_only", "linter_warnings": "linter_warnings", "escalation_hint": "escalation_rule", "routing_policy": "routing_policy",
    }
    stage = F.array_position(stages, F.col("completeness")) - 1
    ordered = graded.withColumn("_order", _order() * len(COMPLETENESS) + stage)
    taken = [F.max_by(F.col(column), "_order").alias(name) for name, column in parts.items() if column]
    best = F.max("_order")
    told = [
        F.element_at(stages, (best % len(COMPLETENESS) + 1).cast("int")).alias("trigger_completeness"),
        F.element_at(names, (F.call_function("div", best, F.lit(4 * SEQ_SPACE * len(COMPLETENESS))) + 1).cast("int")).alias("match_strength"),
    ]
    # The filter drops nothing: it keeps the record apart from the aggregate, so that unread parts are not taken.
    best = ordered.groupBy("flow_id").agg(best.alias("_best"), *told, *taken).filter(F.col("_best").isNotNull())
    return best.select("flow_id", F.struct(*parts).alias("match"))


def match_watchlist(flows: DataFrame, watchlist: Watchlist, *, activity: bool = True) -> DataFrame:
    """(flow_id, match) for flows with at least one item in scope."""
    stored, items = _hint_flows(flows, activity), _stored_items(flows, watchlist, activity)
    scopes = flow_scopes(stored, watchlist.targets)
    # The order of ``best_match``, whose largest value is kept without sorting rows.
    best = _with_items(in_scope(stored, scopes), items).groupBy("flow_id").agg(F.max(_order()).alias("best"))
    chosen = best.select("flow_id", (SEQ_SPACE - 1 - F.col("best") % SEQ_SPACE).alias("item_seq"))
    return best_match(_with_items(in_scope(stored.join(chosen, "flow_id"), scopes), items))
