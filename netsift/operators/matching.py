"""Watchlist matching compiled into the projection.

A small watchlist (checked size) becomes plain column expressions: no join, no
shuffle, no per-flow rows beyond the flow itself. Step one scores every item in
scope and keeps the best; step two spells out only the chosen item's lists.
Bigger watchlists go through ``matching_tables``, which joins; ``match`` chooses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import net
from netsift.functions.hints import TRUE_WORDS
from netsift.functions.scalars import NUMBER_PATTERN, number
from netsift.operators.watchlist import Watchlist

MAX_ITEMS = 64
MAX_HINTS = 512
SEQ_SPACE = 10**14
RANK = K.STRENGTH_RANK
STRONG = ["behavior", "threat_source", "policy_violation", "critical_forbidden"]

MATCH_SCHEMA = (
    "matched boolean, priority string, item_id string, reason string, matched_conditions array<string>, "
    "scope_conditions array<string>, matched_trigger_hints array<string>, unmatched_trigger_hints array<string>, "
    "matched_benign_hints array<string>, trigger_completeness string, alert_when array<string>, "
    "likely_benign_when array<string>, match_strength string, scope_matched boolean, trigger_matched boolean, "
    "context_only boolean, linter_warnings array<string>, escalation_hint string, "
    "routing_policy struct<review_threshold:double,max_threshold_drop:double,action:string,reason:string>"
)
MATCH_STRUCT = "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", MATCH_SCHEMA) + ">"


@dataclass
class Rule:
    """One watchlist item as plain values, ready to be turned into columns."""

    seq: int
    priority: str
    info: dict
    targets: list = field(default_factory=list)
    detection: list = field(default_factory=list)
    benign: list = field(default_factory=list)
    groups: list = field(default_factory=list)


class WatchlistTooLarge(ValueError):
    """The watchlist does not fit the compiled form; use the table form."""


def collect_rules(watchlist: Watchlist) -> list[Rule]:
    """Reads a small watchlist; raises when it is above the compiled size."""
    items = watchlist.items.orderBy("item_seq").limit(MAX_ITEMS + 1).collect()
    hints = watchlist.hints.limit(MAX_HINTS + 1).collect()
    targets = watchlist.targets.limit(MAX_HINTS + 1).collect()
    groups = watchlist.groups.limit(MAX_HINTS + 1).collect()
    if len(items) > MAX_ITEMS or max(len(hints), len(targets), len(groups)) > MAX_HINTS:
        raise WatchlistTooLarge(f"more than {MAX_ITEMS} items or {MAX_HINTS} hints")
    rules = {r["item_seq"]: Rule(r["item_seq"], r["priority"], r.asDict(recursive=True)) for r in items}
    for t in sorted(targets, key=lambda t: t["target_seq"]):
        rules[t["item_seq"]].targets.append(t)
    for g in sorted(groups, key=lambda g: g["group_seq"]):
        rules[g["item_seq"]].groups.append({"seq": g["group_seq"], "min": g["min_supporting"], "required": [], "supporting": []})
    for h in sorted(hints, key=lambda h: h["hint_seq"]):
        rule = rules[h["item_seq"]]
        if h["kind"] in ("detection", "benign"):
            getattr(rule, h["kind"]).append(h)
        else:
            next(g for g in rule.groups if g["seq"] == h["group_seq"])[h["kind"]].append(h)
    return [rules[seq] for seq in sorted(rules)]


# --- one hint -> columns ------------------------------------------------------


@dataclass
class Actual:
    text: Column
    num: Column
    known: Column


def _actual(name: str, *, activity: bool, ml_prob: bool) -> Actual:
    name = K.FIELD_ALIASES.get(name, name)
    yes = F.lit(True)
    if name in ("src_ip", "dst_ip"):
        return Actual(F.col(name), F.lit(None).cast("double"), yes)
    if name in ("src_port", "dst_port"):
        return Actual(F.col(name).cast("string"), F.col(name).cast("double"), yes)
    if name == "protocol":
        return Actual(F.col(name), number(F.col(name)), yes)
    if name == "ml_prob":
        column = F.col("ml_prob")
        return Actual(column.cast("string"), column, yes if ml_prob else F.lit(False))
    if activity and name in K.ACTIVITY_FIELDS:
        column = F.col(K.ACTIVITY_FIELDS[name])
        return Actual(column.cast("string"), column.cast("double"), yes)
    value = F.try_element_at("features", F.lit(name))
    return Actual(value, number(value), F.coalesce(F.map_contains_key("features", name), F.lit(False)))


def _equal(actual: Actual, value: str | None) -> Column:
    if value is None:
        return F.lit(False)
    if value in ("true", "false"):
        truth = F.coalesce(F.lower(F.trim(actual.text)).isin(TRUE_WORDS), F.lit(False))
        return truth == (value == "true")
    if re.match(NUMBER_PATTERN, value):
        return F.coalesce(
            F.when(actual.num.isNotNull(), actual.num == float(value)).otherwise(actual.text == value), F.lit(False)
        )
    return F.coalesce(actual.text == value, F.lit(False))


def _test(hint, actual: Actual) -> Column:
    op, values, listed = hint["operator"], hint["vals"] or [], hint["is_list"]
    if listed and op in ("in", "not_in", "nin"):
        found = F.lit(False)
        for value in values:
            found = found | _equal(actual, value)
        return found if op == "in" else ~found
    if listed and op in ("in_cidr", "not_in_cidr"):
        name = K.FIELD_ALIASES.get(hint["field"], hint["field"])
        known = F.col(f"_{name}_int") if name in ("src_ip", "dst_ip") else None
        found = net.in_cidrs(actual.text, values, known)
        return found if op == "in_cidr" else ~found
    if listed:
        return F.lit(False)
    scalar = values[0] if values else None
    if op == "eq":
        return _equal(actual, scalar)
    if op in ("gt", "gte", "lt", "lte") and scalar is not None and re.match(NUMBER_PATTERN, scalar):
        bound = float(scalar)
        test = {"gt": actual.num > bound, "gte": actual.num >= bound, "lt": actual.num < bound, "lte": actual.num <= bound}
        return F.coalesce(test[op], F.lit(False))
    return F.lit(False)


def _bits(tests: list[Column]) -> Column:
    """Booleans packed into one BIGINT, so that later tests are plain integer masks."""
    packed = F.lit(0).cast("bigint")
    for index, test in enumerate(tests):
        packed = packed + F.when(test, F.lit(1 << index).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return packed


def _any_bit(word: str, mask: int) -> Column:
    """Is any bit of the mask set? ``word`` is the SQL text of a BIGINT (one parse, not a chain of calls)."""
    return F.expr(f"({word} & {mask}L) != 0") if mask else F.lit(False)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chosen(word: str, pairs: list[tuple[int, str]]) -> str:
    """SQL text: the texts whose bit is set, in order."""
    if not pairs:
        return "CAST(array() AS ARRAY<STRING>)"
    cases = ", ".join(f"CASE WHEN ({word} & {1 << bit}L) != 0 THEN {_quoted(text)} END" for bit, text in pairs)
    return f"array_compact(array({cases}))"


# --- one item -> columns ------------------------------------------------------

MAX_ITEM_BITS = 62


class CompiledItem:
    """Scope, strength, completeness and lists of one item.

    Three packed columns hold what is true for a flow: scope conditions, hints
    that hit, hints whose field is missing. All grading works on those bits.
    """

    def __init__(self, rule: Rule, name: str, *, activity: bool, ml_prob: bool):
        self.rule, self.name = rule, name
        self.env = {"activity": activity, "ml_prob": ml_prob}
        self.slots = [*rule.detection, *rule.benign, *[h for g in rule.groups for h in (*g["required"], *g["supporting"])]]
        self.scope_tests = self._scope(rule)
        if max(len(self.slots), len(self.scope_tests)) > MAX_ITEM_BITS:
            raise WatchlistTooLarge(f"item {rule.seq} holds more than {MAX_ITEM_BITS} hints or conditions")
        self.scope, self.hit, self.lost = (f"_{name}_{part}" for part in ("scope", "hit", "lost"))

    def packed(self) -> dict[str, Column]:
        """The three columns to add before grading."""
        hits, losts = [], []
        for hint in self.slots:
            if not hint["operator"]:
                hits.append(F.lit(False))
                losts.append(F.lit(True))
                continue
            actual = _actual(hint["field"], **self.env)
            hits.append(actual.known & _test(hint, actual))
            losts.append(~actual.known)
        return {
            f"_{self.name}_scope": _bits([F.coalesce(test, F.lit(False)) for test, _ in self.scope_tests]),
            f"_{self.name}_hit": _bits(hits),
            f"_{self.name}_lost": _bits(losts),
        }

    @staticmethod
    def _scope(rule: Rule) -> list[tuple[Column, str]]:
        conditions = []
        for target in rule.targets:
            for name in ("dst", "src"):
                if target["ip"] and target["side"] in (name, "either"):
                    conditions.append((F.col(f"{name}_ip") == target["ip"], f"target_assets.ip == flow.{name}_ip"))
            for name in ("dst", "src"):
                if target["cidr"] and target["side"] in (name, "either"):
                    inside = net.in_cidrs(F.col(f"{name}_ip"), [target["cidr"]], F.col(f"_{name}_ip_int"))
                    conditions.append((inside, f"target_assets.cidr {target['cidr']} contains flow.{name}_ip"))
        return conditions

    # -- masks

    def _scope_mask(self, test) -> int:
        return sum(1 << i for i, (_, text) in enumerate(self.scope_tests) if test(text))

    def _mask(self, test) -> int:
        return sum(1 << i for i, hint in enumerate(self.rule.detection) if test(hint))

    def _slot_range(self, group_index: int, kind: str) -> list[int]:
        start = len(self.rule.detection) + len(self.rule.benign)
        for index, group in enumerate(self.rule.groups):
            for part in ("required", "supporting"):
                size = len(group[part])
                if (index, part) == (group_index, kind):
                    return list(range(start, start + size))
                start += size
        return []

    def _pairs(self, slots: list[int]) -> list[tuple[int, str]]:
        return [(i, self.slots[i]["condition"]) for i in slots]

    def _missed(self, slots: list[int], lost_texts: bool) -> str:
        """SQL text: conditions that did not hit; missing fields by name or not at all."""
        cases = []
        for i in slots:
            bit = f"{1 << i}L"
            lost = f"WHEN ({self.lost} & {bit}) != 0 THEN "
            lost += _quoted(f"unrecognized trigger hint: {self.slots[i]['field']}") if lost_texts else "NULL"
            miss = f"WHEN ({self.hit} & {bit}) = 0 THEN {_quoted(self.slots[i]['condition'])}"
            cases.append(f"CASE {lost} {miss} END")
        return f"array_compact(array({', '.join(cases)}))" if cases else "CAST(array() AS ARRAY<STRING>)"

    # -- grading

    @property
    def in_scope(self) -> Column:
        return F.expr(f"{self.scope} != 0")

    @property
    def _source_range(self) -> str:
        mask = self._scope_mask(lambda t: t.startswith("target_assets.cidr ") and t.endswith(" contains flow.src_ip"))
        return f"({self.scope} & {mask}L) != 0"

    def _scoped_only(self) -> int:
        return self._mask(lambda h: h["field"] == "src_ip" and h["operator"] == "in_cidr")

    @property
    def fired(self) -> str:
        """Detection hits that count as triggers; a source-range hint under a source-range scope does not."""
        every, scoped = self._mask(lambda h: True), self._scoped_only()
        if scoped:
            return f"({self.hit} & CASE WHEN {self._source_range} THEN {every & ~scoped}L ELSE {every}L END)"
        return f"({self.hit} & {every}L)"

    @property
    def _silent(self) -> Column:
        return F.expr(f"{self.fired} = 0")

    def _combined(self) -> Column:
        """Strength rank from the hints that fired, before trigger groups."""
        fired = self.fired
        on = lambda test: _any_bit(fired, self._mask(test))
        metadata = on(lambda h: h["metadata_dst"]) & on(lambda h: h["port_80"])
        service = on(lambda h: h["strength"] == "asset_service")
        review = on(lambda h: h["strength"] == "review_candidate")
        egress = (
            _any_bit(self.scope, self._scope_mask(lambda t: "flow.src_ip" in t))
            & on(lambda h: h["outside_dst"])
            & on(lambda h: h["egress_port"])
        )
        graded = F.when(metadata, RANK["critical_forbidden"])
        for name in reversed(STRONG):
            graded = graded.when(on(lambda h, name=name: h["strength"] == name), RANK[name])
        return (
            graded.when(review & service & egress, RANK["behavioral_review"])
            .when(review & service, RANK["review_candidate"])
            .when(
                on(lambda h: h["strength"] == "behavioral_review"),
                F.when(service, RANK["behavioral_review"]).otherwise(RANK["asset_only"]),
            )
            .when(service, RANK["asset_service"])
            .otherwise(RANK["asset_only"])
        )

    def _groups_done(self) -> tuple[Column, Column, Column]:
        """(index of the first complete group or -1, whether it has support, whether any group hint hit)."""
        first = supported = None
        touched = F.lit(False)
        for index, group in enumerate(self.rule.groups):
            required, supporting = self._slot_range(index, "required"), self._slot_range(index, "supporting")
            need = sum(1 << i for i in required)
            found = F.expr(f"size(array_distinct({_chosen(self.hit, self._pairs(supporting))}))")
            complete = F.lit(False)
            if required:
                complete = F.expr(f"({self.hit} & {need}L) = {need}L") & (found >= group["min"])
            first = F.when(complete, index) if first is None else first.when(complete, index)
            has = found > 0
            supported = F.when(complete, has) if supported is None else supported.when(complete, has)
            touched = touched | _any_bit(self.hit, sum(1 << i for i in required + supporting))
        return first.otherwise(-1), supported.otherwise(False), touched

    @property
    def _has_groups(self) -> bool:
        return any(g["required"] or g["supporting"] for g in self.rule.groups)

    @property
    def recognized(self) -> Column:
        every = self._mask(lambda h: True)
        return F.expr(f"({self.lost} & {every}L) != {every}L")

    def rank(self) -> Column:
        if not self.rule.detection:
            return F.lit(RANK["asset_only"])
        rank = self._combined()
        if self._has_groups:
            first, _, touched = self._groups_done()
            partial = F.when(~self._silent | touched, RANK["asset_service"]).otherwise(RANK["asset_only"])
            rank = F.when(first >= 0, rank).otherwise(partial)
        return F.when(self.recognized, rank).otherwise(RANK["asset_only"])

    def completeness(self) -> Column:
        if not self.rule.detection:
            return F.lit("scope_only")
        if self._has_groups:
            first, supported, touched = self._groups_done()
            level = (
                F.when(first >= 0, F.when(supported, "strong").otherwise("required_met"))
                .when(~self._silent | touched, "partial")
                .otherwise("scope_only")
            )
        else:
            rank = self._combined()
            level = (
                F.when(self._silent, "scope_only")
                .when(rank >= RANK["behavior"], "strong")
                .when(rank >= RANK["review_candidate"], "required_met")
                .otherwise("partial")
            )
        return F.when(self.recognized, level).otherwise("scope_only")

    def key(self) -> Column:
        """Packed order: strength, then priority, then earlier item; null outside the scope."""
        weight = 3 - K.PRIORITIES.index(self.rule.priority)
        tail = weight * SEQ_SPACE + (SEQ_SPACE - 1 - self.rule.seq)
        return F.when(self.in_scope, self.rank().cast("bigint") * (10 * SEQ_SPACE) + tail)

    # -- lists

    def _group_lists(self) -> tuple[Column, Column]:
        """Conditions added by trigger groups: those of the first complete group, else of all."""
        distinct = lambda text: F.expr(f"array_distinct({text})")
        first, _, _ = self._groups_done()
        slots: list[int] = []
        chosen_hit = chosen_missed = None
        for index in range(len(self.rule.groups)):
            required, supporting = self._slot_range(index, "required"), self._slot_range(index, "supporting")
            slots += required + supporting
            test = first == index
            mine = distinct(_chosen(self.hit, self._pairs(required + supporting)))
            rest = distinct(self._missed(supporting, True))
            chosen_hit = F.when(test, mine) if chosen_hit is None else chosen_hit.when(test, mine)
            chosen_missed = F.when(test, rest) if chosen_missed is None else chosen_missed.when(test, rest)
        return (
            chosen_hit.otherwise(distinct(_chosen(self.hit, self._pairs(slots)))),
            chosen_missed.otherwise(distinct(self._missed(slots, True))),
        )

    def lists(self) -> dict[str, Column]:
        detection = list(range(len(self.rule.detection)))
        scoped = [i for i in detection if self._scoped_only() & (1 << i)]
        base = _chosen(self.scope, [(i, text) for i, (_, text) in enumerate(self.scope_tests)])
        matched = F.expr(f"concat({base}, {_chosen(self.hit, self._pairs(detection))})")
        scope = F.expr(base)
        if scoped:
            under_range = f"CASE WHEN {self._source_range} THEN {self.hit} ELSE 0L END"
            scope = F.expr(f"array_union({base}, {_chosen(f'({under_range})', self._pairs(scoped))})")
        fired = F.expr(f"array_distinct({_chosen(self.fired, self._pairs(detection))})")
        missed = f"array_distinct({self._missed(detection, False)})"
        if scoped:
            open_slots = [i for i in detection if i not in scoped]
            missed = f"CASE WHEN {self._source_range} THEN array_distinct({self._missed(open_slots, False)}) ELSE {missed} END"
        missed = F.expr(missed)
        if self._has_groups and self.rule.detection:
            extra_hit, extra_missed = self._group_lists()
            new = F.array_except(extra_hit, matched)
            matched = F.when(self.recognized, F.concat(matched, new)).otherwise(matched)
            fired = F.when(self.recognized, F.array_union(fired, extra_hit)).otherwise(fired)
            missed = F.when(self.recognized, F.array_union(missed, extra_missed)).otherwise(missed)
        start = len(self.rule.detection)
        benign = list(range(start, start + len(self.rule.benign)))
        return {
            "matched_conditions": matched,
            "scope_conditions": scope,
            "matched_trigger_hints": fired,
            "unmatched_trigger_hints": missed,
            "matched_benign_hints": F.expr(f"array_distinct({_chosen(self.hit, self._pairs(benign))})"),
        }

    def result(self) -> Column:
        """The full match record of this item."""
        info = self.rule.info
        lists = self.lists()
        policy = info["routing_policy"]
        texts = lambda values: F.array(*[F.lit(v) for v in values or []]).cast("array<string>")
        policy_column = (
            F.struct(
                F.lit(policy["review_threshold"]).cast("double").alias("review_threshold"),
                F.lit(policy["max_threshold_drop"]).cast("double").alias("max_threshold_drop"),
                F.lit(policy["action"]).alias("action"),
                F.lit(policy["reason"]).cast("string").alias("reason"),
            )
            if policy
            else F.lit(None)
        )
        rank, completeness = self.rank(), self.completeness()
        names = F.array(*[F.lit(name) for name in RANK])
        return F.struct(
            F.lit(True).alias("matched"),
            F.lit(self.rule.priority).alias("priority"),
            F.lit(info["item_id"]).cast("string").alias("item_id"),
            F.lit(info["reason"]).cast("string").alias("reason"),
            *[lists[name].alias(name) for name in (
                "matched_conditions", "scope_conditions", "matched_trigger_hints", "unmatched_trigger_hints",
                "matched_benign_hints",
            )],
            completeness.alias("trigger_completeness"),
            texts(info["alert_when"]).alias("alert_when"),
            texts(info["likely_benign_when"]).alias("likely_benign_when"),
            F.element_at(names, rank + 1).alias("match_strength"),
            F.lit(True).alias("scope_matched"),
            ((rank >= RANK["review_candidate"]) & completeness.isin("required_met", "strong")).alias("trigger_matched"),
            F.lit(bool(info["context_only"])).alias("context_only"),
            texts(info["linter_warnings"]).alias("linter_warnings"),
            F.lit(info["escalation_rule"]).cast("string").alias("escalation_hint"),
            policy_column.alias("routing_policy"),
        ).cast(MATCH_STRUCT)


def no_match() -> Column:
    none = F.array().cast("array<string>")
    text = F.lit(None).cast("string")
    off = F.lit(False)
    policy = F.lit(None).cast("struct<review_threshold:double,max_threshold_drop:double,action:string,reason:string>")
    return F.struct(
        off, text, text, text, none, none, none, none, none, F.lit("none"), none, none, F.lit("none"),
        off, off, off, none, text, policy,
    ).cast(MATCH_STRUCT)


def _prepared(flows: DataFrame) -> DataFrame:
    if "features" not in flows.columns:
        flows = flows.withColumn("features", F.create_map().cast("map<string,string>"))
    return flows.withColumns(
        {"_src_ip_int": net.ip_to_int(F.col("src_ip")), "_dst_ip_int": net.ip_to_int(F.col("dst_ip"))}
    )


def _compile(rules: list[Rule], flows: DataFrame, activity: bool) -> tuple[list[CompiledItem], DataFrame]:
    ml_prob = "ml_prob" in flows.columns
    items = [CompiledItem(rule, f"w{i}", activity=activity, ml_prob=ml_prob) for i, rule in enumerate(rules)]
    packed: dict[str, Column] = {}
    for item in items:
        packed.update(item.packed())
    return items, flows.withColumns(packed) if packed else flows


def match_watchlist(flows: DataFrame, rules: list[Rule], *, activity: bool = True) -> DataFrame:
    """Adds ``match``: the best watchlist item of each flow, or the empty match.

    With ``activity=False`` the recent-activity hints count as unrecognised, as
    when stored events are matched again without their history.
    """
    items, prepared = _compile(rules, _prepared(flows), activity)
    if not items:
        return flows.withColumn("match", no_match())
    keys = [item.key() for item in items]
    scored = prepared.withColumn("_best", F.greatest(*keys) if len(keys) > 1 else keys[0])
    seq = SEQ_SPACE - 1 - F.pmod(F.col("_best"), F.lit(SEQ_SPACE))
    chosen = F.when(F.col("_best").isNull(), no_match())
    for item in items:
        chosen = chosen.when(seq == item.rule.seq, item.result())
    return scored.withColumn("_match", chosen).select(*flows.columns, "_match").transform(_settle)


def _settle(matched: DataFrame) -> DataFrame:
    """Keeps later filters above the match.

    Catalyst pushes a filter through projections by copying their expressions
    into it; with a whole watchlist inside that copies far too much. A
    one-element generator keeps the match computed once, inside codegen.
    """
    others = [c for c in matched.columns if c != "_match"]
    return matched.select(*others, F.explode(F.array("_match")).alias("match"))


def item_matches(flows: DataFrame, rules: list[Rule], *, activity: bool = True) -> DataFrame:
    """One row per flow and item in scope, with the item's full result (before the best is taken)."""
    items, prepared = _compile(rules, _prepared(flows), activity)
    results = F.array(*[
        F.when(
            item.in_scope,
            F.struct(F.lit(item.rule.seq).cast("bigint").alias("item_seq"), item.key().alias("key"), item.result().alias("match")),
        )
        for item in items
    ])
    return (
        prepared.select("flow_id", F.explode(F.array_compact(results)).alias("r"))
        .select("flow_id", "r.item_seq", "r.key", "r.match")
    )
