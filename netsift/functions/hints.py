"""The hint language as columns: one row holds an actual value and one hint.

Hints are data here (operator, values, ranges come from columns). The compiled
matcher in ``operators.matching`` specialises the same rules per hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import net
from netsift.functions.scalars import literal_map, number

TRUE_WORDS = ["1", "true", "yes", "y"]
LIST_OPERATORS = ["in", "not_in", "nin", "in_cidr", "not_in_cidr"]
PORT_TEXT = r"(?:dst_port|L4_DST_PORT)\s+in\s+\[([^\]]+)\]"


def hint_env(*, activity: bool = True, ml_prob: bool = True, features: bool = True) -> Column:
    """All values a hint may name, as one MAP<STRING,STRING>; absent key = missing.

    Feature names come last, so core columns and counters win over them.
    """
    core = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    pairs = [(name, F.col(name)) for name in core]
    pairs += [(alias, F.col(name)) for alias, name in K.FIELD_ALIASES.items()]
    if ml_prob:
        pairs.append(("ml_prob", F.col("ml_prob")))
    if activity:
        pairs += [(name, F.col(column)) for name, column in K.ACTIVITY_FIELDS.items()]
    known = F.create_map(*[part for name, value in pairs for part in (F.lit(name), value.cast("string"))])
    if not features:
        return known
    taken = [name for name, _ in pairs]
    extra = F.map_filter(
        F.coalesce("features", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(taken)
    )
    return F.map_concat(known, extra)


def hint_slots(*, activity: bool = True, ml_prob: bool = True) -> dict[str, str]:
    """The fields that every flow has, each with its column, in the order of ``env``."""
    core = {name: name for name in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")}
    return core | ({"ml_prob": "ml_prob"} if ml_prob else {}) | (K.ACTIVITY_FIELDS if activity else {})


def hint_values(flows: DataFrame, slots: dict[str, str]) -> list[Column]:
    """``env``, the values of the slots, and ``extra``, those of other features by name: text, number and address key.

    Numbers and keys are read once per flow, not once per hint. Core names and their aliases win over features.
    """
    kinds = dict(flows.dtypes)

    def given(column: str) -> Column:
        text = F.col(column).cast("string")
        whole = kinds[column] in ("tinyint", "smallint", "int", "bigint")
        num = F.col(column).cast("double") if whole else number(text)
        return F.struct(text.alias("text"), num.alias("num"), F.lit(kinds[column] == "string").alias("open"))

    def parsed(text: Column, num: Column, is_text: Column) -> Column:
        key = F.when(is_text & (text.contains(".") | text.contains(":")), net.ip_key(text))
        return F.struct(text.alias("text"), num.alias("num"), key.alias("key"))

    env = F.transform(F.array(*[given(c) for c in slots.values()]), lambda v: parsed(v["text"], v["num"], v["open"]))
    features = F.col("features") if "features" in kinds else F.create_map()
    taken = [*slots, *K.FIELD_ALIASES]
    none = F.create_map().cast("map<string,string>")
    others = F.map_filter(F.coalesce(features.cast("map<string,string>"), none), lambda k, _: ~k.isin(taken))
    return [env.alias("env"), F.transform_values(others, lambda _, v: parsed(v, number(v), F.lit(True))).alias("extra")]


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_WORDS), F.lit(False))


def hint_eq(actual: Column, expected: Column) -> Column:
    """Bool-aware, then numeric, then text equality; never null."""
    a, e = number(actual), number(expected)
    return F.coalesce(
        F.when(expected.isin("true", "false"), to_bool(actual) == (expected == "true"))
        .when(a.isNotNull() & e.isNotNull(), a == e)
        .otherwise(actual == expected),
        F.lit(False),
    )


def hint_in(actual: Column, values: Column) -> Column:
    return F.exists(values, lambda v: hint_eq(actual, v))


def hint_in_cidr(actual: Column, ranges: Column) -> Column:
    """``ranges`` is ARRAY<STRUCT<lo,hi,prefix>> of address keys; null entries are invalid ranges and skipped."""
    inside = lambda key: F.exists(ranges, lambda r: F.coalesce(key.between(r["lo"], r["hi"]), F.lit(False)))
    return F.coalesce(net.let(net.ip_key(actual), inside), F.lit(False))


def hint_compare(actual: Column, operator: Column, expected: Column) -> Column:
    a, e = number(actual), number(expected)
    test = (
        F.when(operator == "gt", a > e)
        .when(operator == "gte", a >= e)
        .when(operator == "lt", a < e)
        .when(operator == "lte", a <= e)
    )
    return F.coalesce(test, F.lit(False))


def hint_matches(actual: Column, operator: Column, is_list: Column, values: Column, ranges: Column) -> Column:
    """One hint on one value. Unknown operators and list operators without a list are false."""
    scalar = F.get(values, 0)
    return (
        F.when((operator == "in") & is_list, hint_in(actual, values))
        .when(operator.isin("not_in", "nin") & is_list, ~hint_in(actual, values))
        .when(operator.isin("in_cidr", "not_in_cidr") & is_list, hint_in_cidr(actual, ranges) == (operator == "in_cidr"))
        .when((operator == "eq") & ~is_list, hint_eq(actual, scalar))
        .when(operator.isin("gt", "gte", "lt", "lte") & ~is_list, hint_compare(actual, operator, scalar))
        .otherwise(F.lit(False))
    )


def hint_status(env: Column, field: Column, operator: Column, is_list: Column, values: Column, ranges: Column) -> Column:
    known = F.map_contains_key(env, field) & (operator != "")
    return (
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unrecognized"))
        .when(hint_matches(F.try_element_at(env, field), operator, is_list, values, ranges), F.lit("match"))
        .otherwise(F.lit("no_match"))
    )


def hint_strength(field: Column, operator: Column, values: Column) -> Column:
    """Static strength of a hint; computed once per hint, never per flow."""
    name = F.when(field == "L4_DST_PORT", "dst_port").when(field == "PROTOCOL", "protocol").otherwise(field)
    negated = operator.isin("not_in", "nin", "not_in_cidr")
    metadata = F.exists(values, lambda v: hint_eq(v, F.lit(K.METADATA_IP)))
    return (
        F.when(name.isin("dst_port", "protocol", "src_port"), "asset_service")
        .when((name == "dst_ip") & metadata & operator.isin("eq", "in"), "review_candidate")
        .when((name == "dst_ip") & negated, "review_candidate")
        .when(name == "dst_ip", "asset_service")
        .when((name == "src_ip") & negated, "policy_violation")
        .when((name == "src_ip") & (operator == "in"), "threat_source")
        .when(name == "src_ip", "review_candidate")
        .when(name == "known_bad_source", "threat_source")
        .when(name.isin(K.POLICY_FIELDS), "policy_violation")
        .when(name.isin(K.EXTERNAL_FIELDS), "behavioral_review")
        .when(name.startswith("recent_source_") | name.isin(K.BEHAVIOR_FIELDS), "behavior")
        .otherwise("none")
    )


def strength_rank(strength: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.STRENGTH_RANK), strength), F.lit(0))


def printable(value_json: Column, is_list: Column) -> Column:
    """JSON value text as it is printed in conditions: lists with quotes and spaces."""
    listed = F.regexp_replace(F.regexp_replace(value_json, '"', "'"), r",\s*", ", ")
    return F.when(is_list, listed).otherwise(value_json)


def condition_text(field: Column, operator: Column, value: Column) -> Column:
    word = (
        F.when(operator == "eq", F.lit("=="))
        .when(operator.isin("in", "in_cidr"), F.lit("in"))
        .when(operator.isin("not_in", "nin", "not_in_cidr"), F.lit("not in"))
        .otherwise(operator)
    )
    return F.concat_ws(" ", field, word, value)


def string_port_values(text: Column) -> Column:
    """Legacy text hint 'dst_port in [80, 443]' -> ARRAY<STRING> of ports, else null."""
    inner = F.regexp_extract(text, PORT_TEXT, 1)
    return F.when(inner != "", F.transform(F.split(inner, ","), lambda t: F.trim(t)))
