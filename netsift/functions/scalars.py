"""Scalar projections: coercions, names, bands, labels, ids, JSON columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift import constants as K

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def number(text: Column) -> Column:
    """Text -> DOUBLE; null for anything that is not a plain finite number."""
    return F.when(text.cast("string").rlike(NUMBER_PATTERN), text.try_cast("double"))


def coerce_int(text: Column, default: int | None = 0) -> Column:
    """Integer via float ('80.0' -> 80, truncation toward zero); empty -> default."""
    blank = text.isNull() | (text.cast("string") == "")
    value = text.try_cast("double").cast("bigint")
    return F.when(blank, F.lit(default).cast("bigint")).otherwise(value)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def countable(text: Column) -> Column:
    return F.coalesce(blank_to_null(text), F.lit("unknown"))


def protocol_name(protocol: Column) -> Column:
    value = F.lower(F.trim(protocol))
    return (
        F.when(value.isin("6", "tcp"), F.lit("tcp"))
        .when(value.isin("17", "udp"), F.lit("udp"))
        .when(value == "", F.lit("unknown"))
        .otherwise(value)
    )


def service_guess(port: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.SERVICE_BY_PORT), port.cast("int")), F.lit("unknown"))


def service_ports(services: Column) -> Column:
    """Service names -> sorted distinct known ports."""
    lookup = literal_map(K.PORT_BY_SERVICE)
    ports = F.transform(services, lambda s: F.try_element_at(lookup, F.lower(F.trim(s))))
    return F.array_sort(F.array_distinct(F.filter(ports, lambda p: p.isNotNull())))


def contains_any(text: Column, tokens: list[str]) -> Column:
    test = F.lit(False)
    for token in tokens:
        test = test | text.contains(token)
    return test


def classify_group(text: Column) -> Column:
    value = F.lower(text)
    result = None
    for group, tokens in K.GROUP_RULES:
        test = contains_any(value, tokens)
        result = F.when(test, F.lit(group)) if result is None else result.when(test, F.lit(group))
    return result.otherwise(F.lit("other"))


def attack_family(raw_attack: Column) -> Column:
    return F.try_element_at(literal_map(K.ATTACK_FAMILY), raw_attack)


def mock_score(features: Column, name: str = "mock_prob") -> Column:
    """clamp01(value or 0.5): missing, empty -> 0.5; text values keep an explicit zero."""
    raw = blank_to_null(F.try_element_at(features, F.lit(name)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.5))))


def mock_score_number(value: Column) -> Column:
    """Numeric form: a numeric zero is falsy, so it reads as 0.5."""
    kept = F.when(value == 0, F.lit(None)).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(kept, F.lit(0.5))))


def projection_reason(src_port: Column, out_port: Column, src_proto: Column, out_proto: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(~src_port.eqNullSafe(out_port), F.lit("service port projected to regional-care topology")),
        F.when(~src_proto.eqNullSafe(out_proto), F.lit("protocol projected to regional-care topology")),
    )


def has_features(columns: list[str]) -> Column:
    """Every feature present, numeric and finite."""
    test = F.lit(True)
    for name in columns:
        value = F.col(name).cast("string").try_cast("double")
        test = test & F.coalesce(
            value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False)
        )
    return test


def prob_band(prob: Column) -> Column:
    (first, label), *rest = K.PROB_BANDS
    bands = F.when(prob < first, F.lit(label))
    for upper, label in rest:
        bands = bands.when(prob < upper, F.lit(label))
    return bands.otherwise(F.lit(K.PROB_BAND_TOP))


def day_of_id(flow_id: Column) -> Column:
    parts = F.split(flow_id, "-")
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("unknown"))


def family_of_id(flow_id: Column) -> Column:
    """Text between the first '-benign-' and the last dash; 'unknown' without it."""
    rest = F.regexp_extract(flow_id, r"^.*?-benign-(.*)$", 1)
    return F.when(flow_id.contains("-benign-"), F.regexp_replace(rest, r"-[^-]*$", "")).otherwise(
        F.lit("unknown")
    )


def day_token(day: int) -> str:
    return f"d{int(day):02d}"


def processing_state(verdict: Column, route: Column) -> Column:
    return (
        F.when(verdict.isNotNull(), F.lit("complete"))
        .when(route == "tier1_llm", F.lit("tier1_processing"))
        .when(F.coalesce(route, F.lit("")) != "", F.lit("route_processing"))
        .otherwise(F.lit("ingested"))
    )


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def alert_event(verdict: Column, route: Column, severity: Column) -> Column:
    return (
        (_lower(verdict) == "alert")
        | (_lower(route) == "auto_alert")
        | _lower(severity).isin("high", "critical")
    )


def benign_event(verdict: Column, route: Column, severity: Column) -> Column:
    return (
        (_lower(verdict) == "benign")
        | (_lower(route) == "auto_dismiss")
        | (_lower(severity) == "low")
    )


def trend_series(verdict: Column, route: Column) -> Column:
    v, r = _lower(verdict), _lower(route)
    return (
        F.when((v == "alert") | (r == "auto_alert"), F.lit("alert"))
        .when(v == "uncertain", F.lit("uncertain"))
        .when((v == "benign") | (r == "auto_dismiss"), F.lit("dismiss"))
    )


def watchlist_hit(matched: Column) -> Column:
    """A null or empty id is a miss."""
    return F.coalesce(matched != "", F.lit(False))


def safe_id(text: Column, size: int = 48, default: str = "PATTERN") -> Column:
    """Upper-case alphanumeric runs joined by single dashes (Unicode letters kept)."""
    dashed = F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, r"^-|-$", "")
    return F.coalesce(blank_to_null(F.substring(trimmed, 1, size)), F.lit(default))


def node_id(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(text), r"[^0-9A-Za-z_]+", "_")
    cleaned = F.lower(F.regexp_replace(cleaned, r"^_+|_+$", ""))
    return (
        F.when(cleaned == "", F.lit("node"))
        .when(cleaned.rlike("^[0-9]"), F.concat(F.lit("n_"), cleaned))
        .otherwise(cleaned)
    )


def truncate_text(text: Column, size: int, marker: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.substring(text, 1, size), F.lit(marker))
    )


def two_decimals(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.00"))


def split_list(text: Column) -> Column:
    """Comma text -> trimmed, non-empty parts; null when nothing is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def append_unique(values: Column, more: Column) -> Column:
    """Ordered union: first occurrences kept, empty texts skipped."""
    joined = F.array_distinct(F.concat(values, F.filter(more, lambda x: F.coalesce(x != "", F.lit(False)))))
    return joined


def features_to_json(features: Column) -> Column:
    """Map -> JSON text with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(features))))


def features_from_json(text: Column) -> Column:
    """JSON text -> map; null, empty or broken text -> empty map."""
    parsed = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


def case_of(value: Column, mapping: dict, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(mapping), value), F.lit(default))
