"""Verdicts: automatic, rule judge, pluggable judge, validation, guard, floor, budget."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from netsift import constants as K
from netsift.functions.scalars import blank_to_null, two_decimals
from netsift.operators.ranks import range_rank

VERDICT_COLUMNS = [
    "verdict", "severity", "rationale", "recommended_action", "verdict_watchlist", "confidence",
    "fallback_source", "fallback_reason",
]


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def verdict_columns(verdict, severity, rationale, action, confidence, matched=None, source=None, reason=None) -> dict[str, Column]:
    """The eight flat verdict columns."""
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    values = [_text(verdict), _text(severity), _text(rationale), _text(action), _text(matched), confidence, _text(source), _text(reason)]
    return dict(zip(VERDICT_COLUMNS, values, strict=True))


def choose(cases: list[tuple[Column, dict[str, Column]]], default: dict[str, Column]) -> dict[str, Column]:
    """Verdict columns by the first case that holds."""
    out = {}
    for name in VERDICT_COLUMNS:
        value = None
        for test, columns in cases:
            value = F.when(test, columns[name]) if value is None else value.when(test, columns[name])
        out[name] = value.otherwise(default[name]) if value is not None else default[name]
    return out


def auto_dismiss() -> dict[str, Column]:
    return verdict_columns("benign", "low", K.DISMISS_RATIONALE, K.DISMISS_ACTION, 0.8)


def auto_alert(hint: Column, confidence: Column) -> dict[str, Column]:
    lead, middle, tail = K.ALERT_HINT
    extra = F.when(
        (hint != "not_evaluated") & (confidence > 0),
        F.concat(F.lit(lead), hint, F.lit(middle), two_decimals(confidence), F.lit(tail)),
    ).otherwise("")
    return verdict_columns("alert", "high", F.concat(F.lit(K.ALERT_RATIONALE), extra), K.ALERT_ACTION, 0.8)


def rule_judge(rows: DataFrame) -> DataFrame:
    """Adds the verdict of the deterministic reviewer to routed, enriched rows."""
    match = F.col("match")
    prob = F.coalesce("ml_prob", F.lit(0.0))
    hint = F.lower(F.coalesce("category_hint", F.lit("")))
    strong = (
        match["matched"]
        & match["trigger_matched"]
        & match["match_strength"].isin("behavior", "threat_source", "policy_violation")
        & (prob >= 0.20)
        & (hint != "benign")
    )
    staged = rows.withColumn("_alert", F.coalesce((F.col("route") == "auto_alert") | (prob >= 0.95) | strong, F.lit(False)))
    staged = staged.withColumn("_benign", ~F.col("_alert") & (hint == "benign") & (prob < 0.35))
    alert, benign = F.col("_alert"), F.col("_benign")
    case = lambda *texts: verdict_columns(*texts, 0.6, match["item_id"])
    return staged.withColumns(
        choose(
            [
                (alert, case("alert", "high", K.JUDGE_ALERT_RATIONALE, K.JUDGE_ALERT_ACTION)),
                (benign, case("benign", "low", K.JUDGE_BENIGN_RATIONALE, K.JUDGE_BENIGN_ACTION)),
            ],
            case("uncertain", "medium", K.JUDGE_UNCERTAIN_RATIONALE, K.JUDGE_UNCERTAIN_ACTION),
        )
    ).drop("_alert", "_benign")


def fallback(reason: Column, matched: Column) -> dict[str, Column]:
    text = F.concat(F.lit(K.FALLBACK_RATIONALE), reason)
    return verdict_columns("uncertain", "medium", text, K.FALLBACK_ACTION, 0.5, matched, "llm", reason)


def queue_fallback(reason: Column, matched: Column) -> dict[str, Column]:
    text = F.concat(F.lit(K.QUEUE_RATIONALE), reason)
    return verdict_columns("uncertain", "medium", text, K.QUEUE_ACTION, 0.5, matched, "queue", reason)


def validate_verdicts(rows: DataFrame, response: str = "response", matched: str = "match.item_id") -> DataFrame:
    """Parsed responses (struct; null = unparsed) -> verdict columns, broken ones become fallbacks."""
    answer, item = F.col(response), F.col(matched)
    confidence = F.coalesce(F.nullif(answer["confidence"].try_cast("double"), F.lit(0.0)), F.lit(0.5))
    fill = lambda text, default: F.coalesce(blank_to_null(text), F.lit(default))
    quoted = lambda text: F.concat(F.lit("'"), text, F.lit("'."))
    staged = rows.withColumns(
        {
            "_v": F.trim(F.coalesce(answer["verdict"], F.lit(""))),
            "_s": F.trim(F.coalesce(answer["severity"], F.lit(""))),
        }
    )
    verdict, severity = F.col("_v"), F.col("_s")
    good = verdict_columns(
        verdict, severity, fill(answer["rationale"], K.RESPONSE_RATIONALE),
        fill(answer["recommended_action"], K.RESPONSE_ACTION),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), item,
    )
    cases = [
        (answer.isNull(), fallback(F.lit(K.PARSE_REASON), item)),
        (~verdict.isin(K.VERDICTS), fallback(F.concat(F.lit(K.BAD_VERDICT_REASON), quoted(verdict)), item)),
        (~severity.isin(K.SEVERITIES), fallback(F.concat(F.lit(K.BAD_SEVERITY_REASON), quoted(severity)), item)),
    ]
    return staged.withColumns(choose(cases, good)).drop("_v", "_s")


def watchlist_only_guard(rows: DataFrame) -> DataFrame:
    """An alert resting on weak or partial watchlist evidence below the band becomes uncertain."""
    match = F.col("match")
    weak = match["match_strength"].isin("asset_only", "asset_service") | (
        match["trigger_completeness"].isin("scope_only", "partial") & (F.size(match["matched_benign_hints"]) > 0)
    )
    applies = (
        (F.col("verdict") == "alert") & F.col("adjusted_by_watchlist") & (F.col("ml_prob") < F.col("threshold_low")) & weak
    )
    staged = rows.withColumn("_guard", F.coalesce(applies, F.lit(False)))
    guard = F.col("_guard")
    return staged.withColumns(
        {
            "verdict": F.when(guard, "uncertain").otherwise(F.col("verdict")),
            "severity": F.when(guard, "medium").otherwise(F.col("severity")),
            "rationale": F.when(guard, F.concat("rationale", F.lit(K.GUARD_SUFFIX))).otherwise(F.col("rationale")),
            "confidence": F.when(guard, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")),
        }
    ).drop("_guard")


def verdict_floor(rows: DataFrame) -> DataFrame:
    """A strong trigger without benign evidence may not stay at low severity."""
    match = F.col("match")
    applies = (
        (F.col("verdict") != "benign")
        & (F.lower("severity") == "low")
        & match["trigger_matched"]
        & match["match_strength"].isin(
            "behavioral_review", "behavior", "threat_source", "policy_violation", "critical_forbidden"
        )
        & (F.size(match["matched_benign_hints"]) == 0)
    )
    staged = rows.withColumn("_floor", F.coalesce(applies, F.lit(False)))
    return staged.withColumns(
        {
            "severity": F.when(F.col("_floor"), "medium").otherwise(F.col("severity")),
            "rationale": F.when(F.col("_floor"), F.concat("rationale", F.lit(K.FLOOR_SUFFIX))).otherwise(F.col("rationale")),
        }
    ).drop("_floor")


def automatic(rows: DataFrame) -> DataFrame:
    """Overwrites the verdict columns of dismissed and alerted rows with the automatic verdicts."""
    route = F.col("route")
    current = {name: F.col(name) for name in VERDICT_COLUMNS}
    alert = auto_alert(F.col("category_hint"), F.col("category_confidence"))
    return rows.withColumns(choose([(route == "auto_dismiss", auto_dismiss()), (route == "auto_alert", alert)], current))


def effective_watchlist_id() -> Column:
    """A scope-only match counts as a hit later, so it fills an empty verdict id."""
    return F.coalesce(blank_to_null(F.col("verdict_watchlist")), F.col("match.item_id"))


# --- order and budget ---------------------------------------------------------


def review_rank_key(match: Column) -> Column:
    """0 for reviewable priority-1 triggers, else 1."""
    first = (
        match["matched"]
        & (match["priority"] == "priority_1")
        & match["match_strength"].isin(K.REVIEWABLE)
        & match["trigger_matched"]
        & ~match["context_only"]
    )
    return F.when(F.coalesce(first, F.lit(False)), 0).otherwise(1)


def review_priority(routed: DataFrame, policy: str = "watchlist") -> DataFrame:
    """Reviewed flows with their global ``review_rank`` (1-based).

    Order: reviewable priority-1 first, then higher probability, then arrival;
    ``fifo`` keeps arrival only.
    """
    queue = routed.filter(F.col("route") == "tier1_llm")
    if policy == "fifo":
        queue = queue.withColumns({"k1": F.lit(0), "k2": F.lit(0.0)})
    else:
        queue = queue.withColumns({"k1": review_rank_key(F.col("match")), "k2": -F.col("ml_prob")})
    return range_rank(queue, ["k1", "k2", "arrival"], "review_rank").drop("k1", "k2")


def review_budget(routed: DataFrame, limit: int, policy: str = "watchlist") -> DataFrame:
    """Only the first ``limit`` reviews get a judge call; the rest take the queue fallback."""
    ranked = review_priority(routed, policy)
    reason = F.lit(f"Tier 1 max calls per run reached ({limit}).")
    ranked = ranked.withColumn("judged", F.col("review_rank") <= limit if limit > 0 else F.lit(True))
    pending = verdict_columns(None, None, None, None, F.lit(None).cast("double"))
    return ranked.withColumns(choose([(~F.col("judged"), queue_fallback(reason, F.col("match.item_id")))], pending))


# --- judge calls --------------------------------------------------------------


BRIEF_CHARS = 1200


def source_activity(window_minutes: int, ports: Column | None = None, recent: Column | None = None) -> Column:
    """The activity part of the evidence, from the counters of the flow."""
    none = F.array().cast("array<string>")
    said = F.format_string(K.ACTIVITY_SENTENCE, F.lit(window_minutes), F.col("flow_count"), F.col("distinct_dst_count"))
    return F.struct(
        F.lit(window_minutes).alias("window_minutes"), "flow_count", "distinct_dst_count",
        (F.array().cast("array<int>") if ports is None else ports).alias("top_dst_ports"), (none if recent is None else recent).alias("recent_verdicts"),
        F.col("same_dst_count").alias("same_src_same_dst_count"), F.col("same_dst_port_count").alias("same_src_same_dst_port_count"),
        "watchlist_hit_count", "recent_alert_count", said.alias("summary_ko"),
    )


def evidence(activity: Column, brief: str = "") -> Column:
    """The nested evidence record a judge sees, as JSON text; ``brief`` is cut to ``BRIEF_CHARS``."""
    from netsift.functions import net, scalars

    match = F.col("match")
    context = F.struct(
        scalars.protocol_name(F.col("protocol")).alias("protocol_name"),
        scalars.service_guess(F.col("dst_port")).alias("dst_service_guess"),
        net.flow_direction(F.col("src_ip"), F.col("dst_ip")).alias("direction"),
        net.is_internal(F.col("src_ip")).alias("src_is_internal"),
        net.is_internal(F.col("dst_ip")).alias("dst_is_internal"),
        (F.size(match["matched_benign_hints"]) > 0).alias("has_matched_benign_guidance"),
        (F.size(match["unmatched_trigger_hints"]) > 0).alias("has_unmatched_trigger_hints"),
        (F.col("ml_prob") < F.col("threshold_low")).alias("binary_ml_probability_is_below_review_band"),
    )
    return F.to_json(
        F.struct(
            F.struct("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("flow"),
            F.struct(
                F.col("ml_prob").alias("prob"), "category_hint", "category_confidence", F.col("attributions").alias("top_features")
            ).alias("ml"),
            activity.alias("source_activity"),
            context.alias("flow_context"),
            match.alias("watchlist_match"),
            F.lit(brief[:BRIEF_CHARS]).alias("brief_context_excerpt"),
            F.struct(
                "route", F.col("route_reason").alias("reason"), "effective_review_threshold",
                "dynamic_threshold_applied", "dynamic_threshold_reason",
            ).alias("route"),
        )
    )


def retryable(message: str) -> bool:
    text = message.lower()
    return "max_tokens" not in text and any(marker in text for marker in K.RETRY_MARKERS)


def model_judge(
    reviews: DataFrame,
    judge: Callable[[str], str],
    *,
    retries: int = 1,
    backoff_seconds: float = 2.0,
    parallel_calls: int | None = None,
) -> DataFrame:
    """Calls an injected judge on rows (flow_id, evidence); no network client is shipped.

    The rows are spread over the cluster; ``parallel_calls`` bounds the concurrent calls where a provider asks for it.
    Transient errors are retried with exponential backoff.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, errors = [], []
            for text in batch["evidence"]:
                content, error = None, None
                for attempt in range(retries + 1):
                    try:
                        content, error = judge(text), None
                        break
                    except Exception as exc:  # noqa: BLE001 - any judge failure becomes a fallback verdict
                        made = attempt + 1
                        error = (
                            f"LLM provider call failed after {made} attempts: {exc}"
                            if made > 1
                            else f"LLM provider call failed: {exc}"
                        )
                        transient = isinstance(exc, (TimeoutError, ConnectionError)) or retryable(f"{type(exc).__name__}: {exc}")
                        if made > retries or not transient or "max_tokens" in str(exc).lower():
                            break
                        time.sleep(backoff_seconds * 2**attempt)
                contents.append(content)
                errors.append(error)
            yield pd.DataFrame({"flow_id": batch["flow_id"], "content": contents, "error": errors})

    rows = reviews.select("flow_id", "evidence")
    spread = rows.repartition("flow_id") if parallel_calls is None else rows.repartition(parallel_calls, "flow_id")
    return spread.mapInPandas(call, "flow_id string, content string, error string")


RESPONSE = "struct<verdict:string,severity:string,confidence:string,rationale:string,recommended_action:string>"


def _last_valid_object(text: str, verdicts: set, severities: set) -> str | None:
    try:
        whole = json.loads(text)
        return json.dumps(whole) if isinstance(whole, dict) else None
    except json.JSONDecodeError:
        pass
    decoder = json.JSONDecoder()
    first = best = None
    start = text.find("{")
    while start != -1:
        try:
            found, _ = decoder.raw_decode(text, start)
        except json.JSONDecodeError:
            found = None
        if isinstance(found, dict):
            first = found if first is None else first
            if found.get("verdict") in verdicts and found.get("severity") in severities:
                best = found
        start = text.find("{", start + 1)
    chosen = best or first
    return None if chosen is None else json.dumps(chosen)


@F.pandas_udf(StringType())
def salvage_object(texts: pd.Series) -> pd.Series:
    """The last valid verdict object inside free text, else the first JSON object."""
    verdicts, severities = set(K.VERDICTS), set(K.SEVERITIES)
    return texts.map(lambda t: None if t is None else _last_valid_object(t, verdicts, severities))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds ``object_json``. A flat object as the whole text stays in the JVM, only the rest is salvaged."""
    text = F.col("content")
    flat = F.coalesce(text.rlike(r"^\s*\{[^{}]*\}\s*$") & F.try_parse_json(text).isNotNull(), F.lit(False))
    rest = F.when(~flat & text.contains("{"), text)
    return responses.withColumn("object_json", F.when(flat, text).otherwise(salvage_object(rest)))


def response_struct(object_json: Column) -> Column:
    renamed = F.from_json(
        object_json,
        "struct<verdict:string,severity:string,confidence:string,rationale_ko:string,recommended_action_ko:string>",
    )
    return F.when(
        object_json.isNotNull(),
        F.struct(
            renamed["verdict"].alias("verdict"), renamed["severity"].alias("severity"),
            renamed["confidence"].alias("confidence"), renamed["rationale_ko"].alias("rationale"),
            renamed["recommended_action_ko"].alias("recommended_action"),
        ),
    )
