"""Threshold routing: dismiss, review or alert, as one CASE per flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions.scalars import case_of, two_decimals
from netsift.session import run_folder
from netsift.sources.sinks import settle

MOCK_HINT = ("mock", 0.5)


def _flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def watchlist_may_lower(match: Column) -> Column:
    """A priority-1 reviewable trigger that is complete and not context only."""
    return _flag(
        match["matched"]
        & (match["priority"] == "priority_1")
        & match["match_strength"].isin(K.REVIEWABLE)
        & match["trigger_matched"]
        & match["trigger_completeness"].isin("none", "required_met", "strong")
        & ~match["context_only"]
    )


def with_effective_threshold(
    flows: DataFrame, low: float = K.THRESHOLD_LOW, default: float = K.PRIORITY_1_THRESHOLD
) -> DataFrame:
    """Adds ``may_lower``, ``review_threshold`` and ``threshold_reason``.

    Steps are separate columns on purpose: Catalyst keeps a shared column as
    one computation, while a nested expression would be copied into each use.
    """
    match = F.col("match")
    strength, policy = match["match_strength"], match["routing_policy"]
    wanted = policy["review_threshold"]
    staged = flows.withColumns(
        {
            "may_lower": watchlist_may_lower(match),
            "_base": F.greatest(
                F.lit(K.MIN_REVIEW_THRESHOLD),
                F.least(case_of(strength, K.DEFAULT_REVIEW_THRESHOLDS, float(default)), F.lit(float(low))),
            ),
            "_uses_policy": _flag(policy.isNotNull() & (policy["action"] == "tier1_llm") & wanted.isNotNull()),
        }
    )
    bounded = F.when(wanted.between(K.MIN_REVIEW_THRESHOLD, low), wanted).otherwise(F.col("_base"))
    staged = staged.withColumn("_bounded", bounded)
    too_far = _flag(F.lit(float(default)) - F.col("_bounded") > policy["max_threshold_drop"])
    staged = staged.withColumn(
        "_candidate", F.when(F.col("_uses_policy") & ~too_far, F.col("_bounded")).otherwise(F.col("_base"))
    )
    lowered = F.col("may_lower") & (F.col("_candidate") < default)
    policy_reason = F.coalesce(F.nullif(policy["reason"], F.lit("")), F.lit(K.REASON_POLICY_DEFAULT))
    strength_reason = F.concat(F.lit(K.REASON_STRENGTH_DEFAULT[0]), strength, F.lit(K.REASON_STRENGTH_DEFAULT[1]))
    return staged.withColumns(
        {
            "review_threshold": F.when(lowered, F.col("_candidate")).otherwise(float(default)),
            "threshold_reason": F.when(lowered, F.when(F.col("_uses_policy"), policy_reason).otherwise(strength_reason)),
        }
    ).drop("_base", "_uses_policy", "_bounded", "_candidate")


def route_flows(
    flows: DataFrame,
    *,
    low: float = K.THRESHOLD_LOW,
    high: float = K.THRESHOLD_HIGH,
    priority_1: float = K.PRIORITY_1_THRESHOLD,
) -> DataFrame:
    """Adds the route decision columns from ``ml_prob`` and ``match``."""
    prob, match = F.col("ml_prob"), F.col("match")
    staged = with_effective_threshold(flows, low, priority_1)
    above = prob > high
    no_benign = F.size(match["matched_benign_hints"]) == 0
    staged = staged.withColumn(
        "_forced",
        ~above & F.col("may_lower") & _flag((match["match_strength"] == "critical_forbidden") & no_benign),
    )
    forced = F.col("_forced")
    staged = staged.withColumn(
        "_lowered", ~above & ~forced & F.col("may_lower") & (prob >= F.col("review_threshold"))
    )
    lowered = F.col("_lowered")
    staged = staged.withColumn(
        "_dynamic", lowered & F.col("threshold_reason").isNotNull() & (prob < priority_1)
    )
    below = prob < low
    shown = two_decimals(prob)
    p1_reason = F.concat(
        F.lit(K.REASON_P1), two_decimals(F.col("review_threshold")), F.lit(" (match_strength="), match["match_strength"], F.lit(").")
    )
    return staged.withColumns(
        {
            "route": F.when(above, "auto_alert").when(forced | lowered, "tier1_llm").when(below, "auto_dismiss").otherwise("tier1_llm"),
            "route_reason": F.when(above, F.concat(F.lit(K.REASON_ALERT[0]), shown, F.lit(K.REASON_ALERT[1])))
            .when(forced, F.lit(K.REASON_FORCED))
            .when(lowered, p1_reason)
            .when(below, F.concat(F.lit(K.REASON_DISMISS[0]), shown, F.lit(K.REASON_DISMISS[1])))
            .otherwise(F.lit(K.REASON_BAND)),
            "threshold_low": F.lit(float(low)),
            "threshold_high": F.lit(float(high)),
            "adjusted_by_watchlist": forced | lowered,
            "effective_review_threshold": F.when(forced, F.lit(0.0)).otherwise(F.col("review_threshold")),
            "dynamic_threshold_applied": F.when(forced, prob < priority_1).otherwise(F.col("_dynamic")),
            "dynamic_threshold_reason": F.when(forced, F.lit(K.REASON_FORCED_DYNAMIC)).when(
                F.col("_dynamic"), F.col("threshold_reason")
            ),
        }
    ).drop("_forced", "_lowered", "_dynamic", "may_lower", "review_threshold", "threshold_reason")


def mock_hint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category_hint", F.lit(MOCK_HINT[0])).withColumn("category_confidence", F.lit(MOCK_HINT[1]))


def mock_attributions(rows: DataFrame) -> DataFrame:
    one = F.struct(
        F.lit("mock_prob").alias("feature"), F.col("ml_prob").alias("value"), F.lit(1.0).alias("contribution")
    )
    return rows.withColumn("attributions", F.array(one))


ATTRIBUTIONS = "array<struct<feature:string,value:double,contribution:double>>"


def enrich_after_route(
    routed: DataFrame,
    hint: Callable[[DataFrame], DataFrame] = mock_hint,
    explain: Callable[[DataFrame], DataFrame] = mock_attributions,
) -> DataFrame:
    """Runs the costly models only on survivors of routing.

    The frame is split by route before scoring, because a model inside a CASE may run on every row. It is
    stored first, so everything before the split is computed once; ``hint`` sees each survivor once.
    ``hint`` and ``explain`` are DataFrame functions that keep all columns.
    """
    none = F.array().cast(ATTRIBUTIONS)
    stored = settle(routed, run_folder(routed.sparkSession, "routed"))
    dismissed = stored.filter(F.col("route") == "auto_dismiss").select(
        "*", F.lit("not_evaluated").alias("category_hint"), F.lit(0.0).alias("category_confidence"), none.alias("attributions")
    )
    hinted = settle(hint(stored.filter(F.col("route") != "auto_dismiss")), run_folder(routed.sparkSession, "hinted"))
    alerted = hinted.filter(F.col("route") == "auto_alert").withColumn("attributions", none)
    reviewed = explain(hinted.filter(F.col("route") == "tier1_llm")).withColumn("attributions", F.col("attributions").cast(ATTRIBUTIONS))
    return dismissed.unionByName(alerted).unionByName(reviewed)


def enrich_inline(routed: DataFrame, hint: tuple[str, float] = MOCK_HINT) -> DataFrame:
    """The same with a constant hint: no model to protect, so one projection and one pass."""
    name = F.col("route")
    one = F.struct(F.lit("mock_prob").alias("feature"), F.col("ml_prob").alias("value"), F.lit(1.0).alias("contribution"))
    return routed.withColumns(
        {
            "category_hint": F.when(name == "auto_dismiss", "not_evaluated").otherwise(hint[0]),
            "category_confidence": F.when(name == "auto_dismiss", 0.0).otherwise(hint[1]),
            "attributions": F.when(name == "tier1_llm", F.array(one)).otherwise(F.array().cast(ATTRIBUTIONS)),
        }
    )


def top_attributions(values: Column, limit: int = 5) -> Column:
    """The features with the largest absolute contribution, order of entry on ties."""
    keyed = F.transform(
        values, lambda x, i: F.struct((-F.abs(x["contribution"])).alias("k"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda y: y["x"])
