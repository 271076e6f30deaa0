"""Detection quality: confusion, slices, windows, rollups, false-positive analysis, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions import scalars as S
from netsift.operators import events

COUNTS = ["tp", "fp", "tn", "fn"]


def truth() -> Column:
    return F.coalesce(F.col("raw_label") == "Malicious", F.lit(False))


PREDICTIONS = {
    "alert": lambda: F.coalesce(F.col("verdict") == "alert", F.lit(False)),
    "review": lambda: F.coalesce(F.col("verdict") != "benign", F.lit(True)),
}


def confusion_counts(rows: DataFrame, predictions: dict[str, Column], *by: str) -> DataFrame:
    """tp/fp/tn/fn per prediction (column ``metric``) and group; one pass, counters only in the shuffle."""
    marks = F.array(*[F.struct(F.lit(n).alias("metric"), p.alias("hit")) for n, p in predictions.items()])
    actual, hit = F.col("actual"), F.col("m.hit")
    return (
        rows.select(*by, truth().alias("actual"), F.explode(marks).alias("m"))
        .groupBy(*by, F.col("m.metric").alias("metric"))
        .agg(
            F.count_if(actual & hit).alias("tp"), F.count_if(~actual & hit).alias("fp"),
            F.count_if(~actual & ~hit).alias("tn"), F.count_if(actual & ~hit).alias("fn"),
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1, false rates and accuracy from counts; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    counts = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return counts.withColumns(
        {
            "f1": _ratio(2 * p * r, p + r),
            "false_positive_rate": _ratio(fp, fp + tn),
            "false_negative_rate": _ratio(fn, fn + tp),
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        }
    )


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    return with_rates(confusion_counts(rows, {n: p() for n, p in PREDICTIONS.items()}, *by))


def baseline_confusion(rows: DataFrame, thresholds: list[float], *by: str) -> DataFrame:
    """The model alone at fixed thresholds."""
    prob = F.coalesce("ml_prob", F.lit(0.0))
    return with_rates(confusion_counts(rows, {f"ml>{t}": prob > t for t in thresholds}, *by))


def dynamic_threshold_metrics(rows: DataFrame, *by: str) -> DataFrame:
    applied = F.coalesce("dynamic_threshold_applied", F.lit(False))
    return rows.groupBy(*by).agg(
        F.count_if(applied).alias("applied"),
        F.count_if(applied & ~truth() & (F.col("verdict") == "alert")).alias("false_positives"),
        F.count_if(applied & truth() & (F.col("verdict") != "benign")).alias("recovered"),
    )


def context_attack_metrics(rows: DataFrame, *by: str, flow_id: str = "flow_id") -> DataFrame:
    """Malicious flows carrying the context-attack marker in their id."""
    kept = rows.filter(truth() & F.col(flow_id).contains("attack-context-"))
    counted = kept.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("verdict") == "alert").alias("alert_count"),
        F.count_if(F.col("verdict") != "benign").alias("review_count"),
    )
    return counted.withColumns(
        {
            "alert_rate": _ratio(F.col("alert_count"), F.col("total")),
            "review_rate": _ratio(F.col("review_count"), F.col("total")),
        }
    )


def usage_costs(calls: DataFrame, *by: str, input_usd: float = 0.0, output_usd: float = 0.0) -> DataFrame:
    """Tokens, latency and price per million tokens."""
    used = calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion"),
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("reported"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"),
    )
    both = F.col("prompt") + F.col("completion")
    return used.withColumns(
        {
            "total": F.when(F.col("reported") > 0, F.col("reported")).otherwise(both),
            "cost_usd": F.col("prompt") / 1e6 * input_usd + F.col("completion") / 1e6 * output_usd,
        }
    ).drop("reported")


def rollup_days(daily: DataFrame, *by: str) -> DataFrame:
    """Totals over days: counts are summed, rates derived again from the sums."""
    return with_rates(daily.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def merge_counters(daily: DataFrame, *keys: str) -> DataFrame:
    return daily.groupBy(*keys).agg(F.sum("n").alias("n"))


def change_window(day: Column) -> Column:
    return F.when(day <= 2, "pre_change").otherwise("post_change")


def manifest_join(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attaches scenario, cve and source attack; unknown where the manifest has no row."""
    facts = manifest.select("flow_id", "scenario", "cve_id", "source_attack")
    return rows.join(facts, "flow_id", "left").withColumns(
        {
            "scenario": S.countable(F.col("scenario")),
            "source_attack": S.countable(F.col("source_attack")),
        }
    )


def slices() -> Column:
    """Names of the (overlapping) slices a row belongs to."""
    named = {f"cve:{cve}": F.col("cve_id") == cve for cve in K.CVE_CONTROLS}
    named["low_ml_contextual"] = truth() & (F.coalesce("ml_prob", F.lit(0.0)) < 0.30)
    named["infilteration_family"] = F.col("raw_attack") == "Infilteration"
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named.items()]))


def slice_metrics(rows: DataFrame, *by: str) -> DataFrame:
    exploded = rows.withColumn("slice", F.explode(slices()))
    return with_rates(confusion_counts(exploded, {n: p() for n, p in PREDICTIONS.items()}, *by, "slice"))


def benign_control_fpr(rows: DataFrame) -> DataFrame:
    """Alert rate over benign flows of the control scenarios of each CVE."""
    tags = F.array_compact(F.array(*[
        F.when(F.col("scenario").isin(names), F.lit(cve)) for cve, names in K.CVE_CONTROLS.items()
    ]))
    kept = rows.filter(~truth()).withColumn("control_of", F.explode(tags))
    counted = kept.groupBy("control_of").agg(
        F.count("*").alias("controls"), F.count_if(F.col("verdict") == "alert").alias("alerts")
    )
    return counted.withColumn("alert_fpr", _ratio(F.col("alerts"), F.col("controls")))


def scenario_counts(rows: DataFrame) -> DataFrame:
    return events.count_by(
        rows, {"scenario": F.col("scenario"), "cve": F.col("cve_id"), "source_attack": F.col("source_attack")}
    )


def false_positives(rows: DataFrame) -> DataFrame:
    """Benign flows that ended as alerts, with the derived analysis columns."""
    prob = F.coalesce("ml_prob", F.lit(0.0))
    return rows.filter((F.col("raw_label") != "Malicious") & (F.col("verdict") == "alert")).withColumns(
        {
            "day": S.day_of_id(F.col("trace_id")),
            "flow_family": S.family_of_id(F.col("trace_id")),
            "ml_prob": prob,
            "ml_prob_band": S.prob_band(prob),
            "effective_review_threshold": F.round(F.coalesce("effective_review_threshold", F.lit(0.0)), 3),
        }
    )


FP_DIMENSIONS = [
    "day", "flow_family", "route", "dynamic_threshold_applied", "adjusted_by_watchlist", "match_strength",
    "watchlist_item", "severity", "ml_prob_band", "effective_review_threshold",
]


def fp_counts(fps: DataFrame, dimensions: list[str] = FP_DIMENSIONS) -> DataFrame:
    """One (dimension, value, n) table for all false-positive counters; null shows as None."""
    return events.count_by(fps, {d: F.coalesce(F.col(d).cast("string"), F.lit("None")) for d in dimensions})


def top_values(rows: DataFrame, column: str, limit: int, order: list[str]) -> DataFrame:
    """Most frequent values; ties go to the value seen first in ``order``."""
    return (
        rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value"))
        .agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
        .orderBy(F.desc("n"), "_first")
        .limit(limit)
        .drop("_first")
    )


def top_conditions(rows: DataFrame, limit: int, order: list[str], column: str = "matched_conditions") -> DataFrame:
    exploded = rows.select(*order, F.posexplode(column).alias("_pos", "condition"))
    return (
        exploded.groupBy("condition")
        .agg(F.count("*").alias("n"), F.min(F.struct(*order, "_pos")).alias("_first"))
        .orderBy(F.desc("n"), "_first")
        .limit(limit)
        .drop("_first")
    )


def fp_breakdown(fps: DataFrame) -> DataFrame:
    """Counts by strength, by item ('none' without one) and of adjusted rows."""
    return events.count_by(
        fps,
        {
            "strength": F.col("match_strength"),
            "item": F.col("watchlist_item"),
            "adjusted": F.when(F.coalesce("adjusted_by_watchlist", F.lit(False)), "all"),
        },
    )
