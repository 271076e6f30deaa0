"""The watchlist as tables: document -> rows, normalisation, lint.

Four tables hold a watchlist: ``items``, ``targets``, ``hints`` and ``groups``,
all keyed by ``item_seq`` (the order items are tried in).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import hints as H
from netsift.functions import net
from netsift.functions.scalars import blank_to_null, contains_any, number

ITEM_SCHEMA = (
    "struct<id:string,target_assets:array<struct<ip:string,cidr:string,role:string,match:string>>,"
    "reason:string,detection_hints:array<string>,benign_hints:array<string>,"
    "trigger_groups:array<struct<name:string,required:array<string>,supporting:array<string>,min_supporting:string>>,"
    "alert_when:array<string>,likely_benign_when:array<string>,escalation_rule:string,"
    "routing_policy:struct<review_threshold:string,max_threshold_drop:string,action:string,reason:string>,"
    "context_only:boolean>"
)
HINT_SCHEMA = "struct<field:string,operator:string,value:string>"
POLICY_SCHEMA = "struct<review_threshold:double,max_threshold_drop:double,action:string,reason:string>"
ITEM_SPACING = 10**12


@dataclass
class Watchlist:
    """The four tables of one watchlist."""

    items: DataFrame
    targets: DataFrame
    hints: DataFrame
    groups: DataFrame


def document_frame(spark: SparkSession, document: dict | str) -> DataFrame:
    """A one-row frame holding the JSON text of a watchlist document."""
    text = document if isinstance(document, str) else json.dumps(document, ensure_ascii=False)
    return spark.range(0, 1, 1, 1).select(F.lit(text).alias("document"))


def raw_items(documents: DataFrame) -> DataFrame:
    """JSON documents -> one row per item. Broken documents and non-list priorities give no rows."""
    schema = "struct<" + ",".join(f"{p}:array<string>" for p in K.PRIORITIES) + ">"
    doc = documents.select(F.from_json("document", schema).alias("d"))
    parts = []
    for rank, priority in enumerate(K.PRIORITIES):
        rows = doc.select(F.posexplode(f"d.{priority}").alias("pos", "item_json"))
        parts.append(
            rows.select(
                F.lit(priority).alias("priority"),
                (F.lit(rank) * ITEM_SPACING + F.col("pos")).cast("bigint").alias("item_seq"),
                F.from_json("item_json", ITEM_SCHEMA).alias("item"),
            ).filter(F.col("item").isNotNull())
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _hint_rows(rows: DataFrame) -> DataFrame:
    """Rows (item_seq, kind, group_seq, hint_seq, raw) -> typed hint rows."""
    parsed = F.from_json("raw", HINT_SCHEMA)
    is_object = F.coalesce(F.ltrim(F.col("raw")).startswith("{"), F.lit(False))
    ports = H.string_port_values(F.col("raw"))
    value = F.when(is_object, F.col("h.value"))
    is_list = F.coalesce(value.startswith("["), F.lit(False))
    values = (
        F.when(is_list, F.from_json(value, "array<string>"))
        .when(is_object, F.array(value))
        .otherwise(F.coalesce(ports, F.array().cast("array<string>")))
    )
    typed = rows.withColumn("h", F.when(is_object, parsed)).select(
        "item_seq", "kind", "group_seq", "hint_seq",
        F.when(is_object, F.coalesce(F.trim("h.field"), F.lit("")))
        .when(ports.isNotNull(), "dst_port").otherwise("").alias("field"),
        F.when(is_object, F.coalesce(F.trim("h.operator"), F.lit("")))
        .when(ports.isNotNull(), "in").otherwise("").alias("operator"),
        F.when(~is_object, F.col("raw")).alias("legacy_text"),
        (is_list | (~is_object & ports.isNotNull())).alias("is_list"),
        values.alias("vals"),
        value.alias("value_text"),
    )
    return describe_hints(typed)


def describe_hints(hints: DataFrame) -> DataFrame:
    """Adds the static parts of a hint: condition text, strength, ranges, special flags."""
    field, op, vals = F.col("field"), F.col("operator"), F.col("vals")
    strength = F.when(F.col("legacy_text").isNotNull() & (field == "dst_port"), "asset_service").otherwise(
        H.hint_strength(field, op, vals)
    )
    has = lambda expected: F.exists(vals, lambda v: H.hint_eq(v, F.lit(expected)))
    egress = F.lit(False)
    for port in K.EGRESS_PORTS:
        egress = egress | has(str(port))
    return (
        hints.withColumn(
            "condition",
            F.coalesce(
                "legacy_text", H.condition_text(field, op, H.printable(F.col("value_text"), F.col("is_list")))
            ),
        )
        .withColumn("strength", strength)
        .withColumn("rank", H.strength_rank(F.col("strength")))
        .withColumn("ranges", F.when(op.isin("in_cidr", "not_in_cidr"), F.transform(vals, net.cidr_bounds)))
        .withColumn("metadata_dst", (field == "dst_ip") & op.isin("eq", "in") & has(K.METADATA_IP))
        .withColumn("port_80", (field == "dst_port") & has("80"))
        .withColumn("egress_port", (field == "dst_port") & egress)
        .withColumn("outside_dst", (field == "dst_ip") & op.isin("not_in", "nin", "not_in_cidr"))
    )


def _valid_hint(raw: Column) -> Column:
    """Kept by normalisation: text hints, known operators, list operators with a list."""
    parsed = F.from_json(raw, HINT_SCHEMA)
    is_object = F.ltrim(raw).startswith("{")
    field, op = F.trim(parsed["field"]), F.trim(parsed["operator"])
    listed = parsed["value"].startswith("[")
    has_value = raw.rlike(r'"value"\s*:')
    ok = (
        (F.coalesce(field, F.lit("")) != "")
        & ((op.isin(H.LIST_OPERATORS) & listed) | (op.isin("eq", "gte", "lte", "gt", "lt") & has_value))
    )
    return F.coalesce(~is_object | ok, F.lit(False))


def _texts(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")


def normalize_items(raw: DataFrame, cycle_id: str) -> DataFrame:
    """Model output -> clean items: targets required, default ids and texts, valid hints only."""
    item = F.col("item")
    targets = F.filter(
        F.coalesce(item["target_assets"], F.array().cast("array<struct<ip:string,cidr:string,role:string,match:string>>")),
        lambda t: (F.coalesce(t["ip"], F.lit("")) != "") | (F.coalesce(t["cidr"], F.lit("")) != ""),
    )
    label = F.regexp_replace("priority", "priority_", "P")
    number_text = (F.col("item_seq") % ITEM_SPACING + 1).cast("string")
    default_id = F.concat(
        label, F.lit(f"-{cycle_id.replace('-', '')}-"),
        F.lpad(number_text, F.greatest(F.lit(3), F.length(number_text)), F.lit("0")),
    )
    fill = lambda name, text: F.coalesce(blank_to_null(item[name]), text)
    return raw.withColumn("targets_kept", targets).filter(F.size("targets_kept") > 0).select(
        "priority",
        "item_seq",
        F.struct(
            fill("id", default_id).alias("id"),
            F.col("targets_kept").alias("target_assets"),
            fill("reason", F.lit(K.DEFAULT_ITEM_REASON)).alias("reason"),
            F.filter(F.coalesce(item["detection_hints"], F.array().cast("array<string>")), _valid_hint).alias("detection_hints"),
            F.array().cast("array<string>").alias("benign_hints"),
            F.array().cast("array<struct<name:string,required:array<string>,supporting:array<string>,min_supporting:string>>").alias("trigger_groups"),
            _texts(item["alert_when"]).alias("alert_when"),
            _texts(item["likely_benign_when"]).alias("likely_benign_when"),
            fill("escalation_rule", F.lit(K.DEFAULT_ESCALATION)).alias("escalation_rule"),
            item["routing_policy"].alias("routing_policy"),
            F.lit(None).cast("boolean").alias("context_only"),
        ).alias("item"),
    )


def to_tables(raw: DataFrame) -> Watchlist:
    """Item rows -> the four tables (no lint)."""
    none = F.array().cast("array<string>")
    items = raw.select(
        "item_seq", "priority", F.col("item.id").alias("item_id"), F.col("item.reason").alias("reason"),
        F.col("item.escalation_rule").alias("escalation_rule"),
        F.filter(F.coalesce("item.alert_when", none), lambda t: t.isNotNull()).alias("alert_when"),
        F.filter(F.coalesce("item.likely_benign_when", none), lambda t: t.isNotNull()).alias("likely_benign_when"),
        F.col("item.routing_policy").alias("raw_policy"),
        F.coalesce("item.context_only", F.lit(False)).alias("context_only"),
    )
    side = F.lower(F.trim(F.coalesce(F.col("t.match"), F.lit("either"))))
    targets = raw.select("item_seq", F.posexplode("item.target_assets").alias("target_seq", "t")).select(
        "item_seq", "target_seq",
        F.trim(F.coalesce("t.ip", F.lit(""))).alias("ip"), F.trim(F.coalesce("t.cidr", F.lit(""))).alias("cidr"),
        F.when(side.isin("src", "dst", "either"), side).otherwise("either").alias("side"),
        F.col("t.role").alias("role"),
    )
    targets = targets.withColumn("bounds", net.cidr_bounds(F.col("cidr")))
    plain = lambda name, kind: raw.select(
        "item_seq", F.lit(kind).alias("kind"), F.lit(-1).alias("group_seq"),
        F.posexplode(f"item.{name}").alias("hint_seq", "raw"),
    )
    grouped = raw.select("item_seq", F.posexplode("item.trigger_groups").alias("group_seq", "g"))
    member = lambda name: grouped.select(
        "item_seq", F.lit(name).alias("kind"), "group_seq", F.posexplode(f"g.{name}").alias("hint_seq", "raw")
    )
    hints = _hint_rows(
        plain("detection_hints", "detection")
        .unionByName(plain("benign_hints", "benign"))
        .unionByName(member("required"))
        .unionByName(member("supporting"))
    )
    groups = grouped.select(
        "item_seq", "group_seq", F.col("g.name").alias("name"),
        F.greatest(F.lit(0), F.coalesce(number(F.col("g.min_supporting")).cast("int"), F.lit(0))).alias("min_supporting"),
    )
    return Watchlist(items, targets, hints, groups)


def hint_summary(hints: DataFrame) -> DataFrame:
    """Per item what lint needs to know about its detection hints (partial aggregation)."""
    known = (F.col("field") != "") & (F.col("operator") != "")
    strong = F.col("strength").isin("behavior", "threat_source", "policy_violation", "critical_forbidden")
    review = F.col("strength").isin("review_candidate", "behavioral_review")
    label = F.when(F.col("legacy_text").isNotNull(), F.substring("legacy_text", 1, 40)).otherwise(F.col("field"))
    label = F.coalesce(blank_to_null(label), F.lit("<missing>"))
    text_of = F.col("value_text")
    return hints.filter(F.col("kind") == "detection").groupBy("item_seq").agg(
        F.bool_or(known & strong).alias("has_strong"),
        F.bool_or(known & review).alias("has_review"),
        F.bool_or(known & (F.col("strength") == "asset_service")).alias("has_service"),
        F.array_sort(F.collect_set(F.when(~known, label))).alias("unrecognized"),
        F.bool_or(F.col("field").isin("src_ip", "known_bad_source")).alias("has_source_hint"),
        F.bool_or(
            (F.col("field") == "dst_ip")
            & (
                ((F.col("operator") == "eq") & (text_of == K.METADATA_IP))
                | ((F.col("operator") == "in") & F.col("is_list") & F.array_contains("vals", K.METADATA_IP))
            )
        ).alias("has_metadata_hint"),
    )


def lint_policy(policy: Column) -> Column:
    """Raw policy -> struct(policy, warnings); an invalid one gives a null policy and a warning."""
    action = F.trim(F.coalesce(blank_to_null(policy["action"]), F.lit("tier1_llm")))
    threshold = number(policy["review_threshold"])
    drop = number(policy["max_threshold_drop"])
    problem = (
        F.when(action != "tier1_llm", K.LINT_ACTION)
        .when(threshold.isNull(), K.LINT_NUMBER)
        .when(threshold < K.MIN_REVIEW_THRESHOLD, K.LINT_BELOW)
        .when(threshold > K.MAX_REVIEW_THRESHOLD, K.LINT_ABOVE)
    )
    bad_drop = problem.isNull() & policy["max_threshold_drop"].isNotNull() & drop.isNull()
    kept = F.struct(
        threshold.alias("review_threshold"), drop.alias("max_threshold_drop"),
        F.lit("tier1_llm").alias("action"), blank_to_null(policy["reason"]).alias("reason"),
    )
    warnings = F.array_compact(F.array(problem, F.when(bad_drop, F.lit(K.LINT_DROP))))
    return F.struct(
        F.when(policy.isNotNull() & problem.isNull(), kept).alias("policy"),
        F.when(policy.isNotNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def mention_flags(reason: Column, rule: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(reason, F.lit("")), F.lit(" "), F.coalesce(rule, F.lit(""))))
    return F.struct(
        contains_any(text, K.KNOWN_BAD_TOKENS).alias("known_bad"),
        contains_any(text, K.IMDS_TOKENS).alias("imds"),
    )


def lint_watchlist(watchlist: Watchlist) -> Watchlist:
    """Flags items that cannot trigger a review and drops policies that may not apply."""
    no = F.lit(False)
    items = watchlist.items.join(hint_summary(watchlist.hints), "item_seq", "left")
    routable = F.coalesce("has_strong", no) | (F.coalesce("has_review", no) & F.coalesce("has_service", no))
    p1 = F.col("priority") == "priority_1"
    items = (
        items.withColumn("routable", routable)
        .withColumn("checked", lint_policy(F.col("raw_policy")))
        .withColumn("context_only", F.col("context_only") | (p1 & ~F.col("routable")))
        .withColumn("mentions", mention_flags(F.col("reason"), F.col("escalation_rule")))
    )
    has_policy = F.col("checked.policy").isNotNull()
    unrecognized = F.coalesce("unrecognized", F.array().cast("array<string>"))
    warnings = F.concat(
        F.col("checked.warnings"),
        F.array_compact(
            F.array(
                F.when(p1 & ~F.col("routable"), K.LINT_NO_TRIGGER),
                F.when(has_policy & ~p1, K.LINT_POLICY_NOT_P1).when(
                    has_policy & F.col("context_only"), K.LINT_POLICY_CONTEXT
                ),
                F.when(F.size(unrecognized) > 0, F.concat(F.lit(K.LINT_UNRECOGNIZED), F.array_join(unrecognized, ", "))),
                F.when(F.col("mentions.known_bad") & ~F.coalesce("has_source_hint", no), K.LINT_KNOWN_BAD),
                F.when(F.col("mentions.imds") & ~F.coalesce("has_metadata_hint", no), K.LINT_IMDS),
            )
        ),
    )
    items = items.select(
        "item_seq", "priority", "item_id", "reason", "escalation_rule", "alert_when", "likely_benign_when",
        "context_only", "routable",
        F.when(p1 & ~F.col("context_only"), F.col("checked.policy")).alias("routing_policy"),
        warnings.alias("linter_warnings"),
    )
    return Watchlist(items, watchlist.targets, watchlist.hints, watchlist.groups)


def load_watchlist(documents: DataFrame) -> Watchlist:
    """A stored watchlist document: rows, then lint."""
    return lint_watchlist(to_tables(raw_items(documents)))


def normalize_watchlist(documents: DataFrame, cycle_id: str) -> Watchlist:
    """A freshly generated document: normalise, rows, lint."""
    return lint_watchlist(to_tables(normalize_items(raw_items(documents), cycle_id)))
