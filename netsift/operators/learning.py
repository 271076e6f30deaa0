"""Training frames: features, encodings, splits, and the metrics of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.functions.scalars import attack_family, literal_map
from netsift.operators.ranks import range_rank, range_sums

SPLITS = ["train", "validation", "test"]


# --- features ------------------------------------------------------------------


def feature_surface(flows: DataFrame) -> DataFrame:
    """Adds ``surface``: the feature map a model may see; flow columns win, excluded names are gone."""
    kept = F.map_filter("features", lambda k, _: ~k.isin(K.EXCLUDED_FEATURES + ["L4_DST_PORT", "PROTOCOL"]))
    own = F.create_map(F.lit("L4_DST_PORT"), F.col("dst_port").cast("string"), F.lit("PROTOCOL"), F.col("protocol").cast("string"))
    return flows.withColumn("surface", F.map_concat(kept, own))


def fit_categorical_maps(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, code): sorted distinct text values of each feature, from the train rows only.

    Values are pre-aggregated, so the ranking sees distinct values, not rows.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    values = train.select(F.explode(pairs).alias("p")).select("p.feature", "p.value").distinct()
    window = Window.partitionBy("feature").orderBy("value")
    return values.withColumn("code", F.row_number().over(window) - 1)


def collect_maps(codes: DataFrame, limit: int = 100_000) -> dict[str, dict[str, int]]:
    """Reads the code table for scoring; refuses one that is too large for a literal map."""
    rows = codes.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} category values; join the code table instead")
    maps: dict[str, dict[str, int]] = {}
    for row in rows:
        maps.setdefault(row["feature"], {})[row["value"]] = row["code"]
    return maps


def encode_features(rows: DataFrame, features: list[str], maps: dict[str, dict[str, int]]) -> DataFrame:
    """Adds ``x_<feature>`` doubles (unknown category -1) and ``encodable`` (all present and finite)."""
    columns: dict[str, Column] = {}
    for name in features:
        if name in maps:
            code = F.try_element_at(literal_map(maps[name]), F.col(name).cast("string"))
            columns[f"x_{name}"] = F.when(F.col(name).isNotNull(), F.coalesce(code, F.lit(-1)).cast("double"))
        else:
            columns[f"x_{name}"] = F.col(name).cast("string").try_cast("double")
    encoded = rows.withColumns(columns)
    finite = F.lit(True)
    for name in columns:
        finite = finite & F.coalesce(~F.isnan(name) & (F.abs(F.col(name)) != float("inf")), F.lit(False))
    return encoded.withColumn("encodable", finite)


def require_encodable(encoded: DataFrame) -> DataFrame:
    """Fails loudly when any row cannot be encoded; returns the frame otherwise."""
    bad = encoded.filter(~F.col("encodable")).limit(1).count()
    if bad:
        raise ValueError("missing or non-finite feature values")
    return encoded


def make_matrix(rows: DataFrame, features: list[str], maps: dict[str, dict[str, int]]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    encoded = encode_features(rows, features, maps)
    names = [f"x_{f}" for f in features]
    encoded = encoded.withColumns({n: F.col(n).cast("float").cast("double") for n in names})
    return VectorAssembler(inputCols=names, outputCol="x", handleInvalid="error").transform(encoded)


def validate_training_frame(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row: row count, label set check and the features holding null or non-finite values."""
    bad = {}
    for name in features:
        value = F.col(name).cast("string").try_cast("double")
        ok = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
        bad[name] = F.count_if(~ok)
    checked = rows.agg(
        F.count("*").alias("rows"),
        F.array_sort(F.collect_set(F.col("Label").cast("string"))).alias("labels"),
        *[c.alias(f"bad_{n}") for n, c in bad.items()],
    )
    listed = F.array_compact(F.array(*[F.when(F.col(f"bad_{n}") > 0, F.lit(n)) for n in features]))
    return checked.select(
        "rows", (F.col("labels") == F.array(F.lit("0"), F.lit("1"))).alias("labels_ok"), listed.alias("nonfinite")
    )


# --- splits ------------------------------------------------------------------------


def _hash_order(seed: int, key: str) -> Column:
    """A seeded, uniform position in [0, 2^62) that any re-run repeats."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 62))


def stratified_split(
    rows: DataFrame, stratum: str, key: str = "flow_id", val_size: float = 0.15, test_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """Adds ``split``: exact shares of each stratum, in seeded hash order; a stratum may hold most of the rows."""
    ranked = range_rank(rows.withColumn("_h", _hash_order(seed, key)), ["_h", key], "_rank", keys=[stratum], total="_n")
    n, rank = F.col("_n"), F.col("_rank")
    test = F.round(n * test_size)
    val = F.round(n * val_size)
    split = F.when(rank <= test, "test").when(rank <= test + val, "validation").otherwise("train")
    return ranked.withColumn("split", split).drop("_h", "_rank", "_n")


def time_split(rows: DataFrame, time: str, key: str = "flow_id", val_size: float = 0.15, test_size: float = 0.15) -> DataFrame:
    """Adds ``split`` by time order: first 70%, next 15%, last 15%."""
    ranked = range_rank(rows, [time, key], "_rank", total="_n")
    train_end = F.floor(F.col("_n") * (1.0 - val_size - test_size))
    val_end = F.floor(F.col("_n") * (1.0 - test_size))
    split = F.when(F.col("_rank") <= train_end, "train").when(F.col("_rank") <= val_end, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank", "_n")


def split_report(rows: DataFrame, time: str) -> DataFrame:
    """(split, dimension, value, n, time_min, time_max): rows, labels and attacks of every split."""
    tags = F.array(*[
        F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value"))
        for n, c in {"rows": F.lit("all"), "label": F.col("Label"), "attack": F.col("Attack")}.items()
    ])
    return (
        rows.select("split", F.col(time).alias("t"), F.explode(tags).alias("g"))
        .groupBy("split", F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value"))
        .agg(F.count("*").alias("n"), F.min("t").alias("time_min"), F.max("t").alias("time_max"))
    )


def category_diffs(rows: DataFrame, column: str = "Attack") -> DataFrame:
    """(kind, value): categories missing from a split, and those found in train or test only."""
    found = rows.select(F.col(column).alias("value"), "split").distinct()
    per_value = found.groupBy("value").agg(F.collect_set("split").alias("splits"))
    has = lambda s: F.array_contains("splits", s)
    kinds = F.array_compact(F.array(
        *[F.when(~has(s), F.lit(f"missing_in_{s}")) for s in SPLITS],
        F.when(has("train") & ~has("validation") & ~has("test"), "train_only"),
        F.when(has("test") & ~has("train") & ~has("validation"), "test_only"),
    ))
    return per_value.select(F.explode(kinds).alias("kind"), "value")


def downsample_benign(train: DataFrame, ratio: float, seed: int = 42, key: str = "flow_id") -> DataFrame:
    """All attacks and the first n_attack * ratio benign rows in seeded hash order."""
    attacks = train.filter(F.col("Label").cast("int") == 1)
    benign = train.filter(F.col("Label").cast("int") == 0).withColumn("_h", _hash_order(seed, key))
    target = attacks.agg(F.floor(F.count("*") * ratio).alias("_target"))
    ranked = range_rank(benign, ["_h", key], "_rank")
    kept = ranked.join(F.broadcast(target), how="cross").filter(F.col("_rank") <= F.col("_target"))  # one row
    return attacks.unionByName(kept.select(*attacks.columns))


def attack_frame(rows: DataFrame) -> DataFrame:
    """Attack rows with their family; an attack name without family raises inside the job."""
    attacks = rows.filter(F.col("Label").cast("int") == 1)
    family = attack_family(F.col("Attack"))
    problem = F.concat(F.lit("unmapped attack label: "), F.coalesce("Attack", F.lit("null")))
    return attacks.withColumn("family", F.coalesce(family, F.raise_error(problem).cast("string")))


# --- metrics ---------------------------------------------------------------------


def select_thresholds(
    scored: DataFrame, max_leak: float = 0.01, min_precision: float = 0.95, label: str = "Label", prob: str = "prob"
) -> DataFrame:
    """Low and high routing thresholds from fixed grids.

    Probabilities are counted once per grid cell; the cumulative sums then run
    over the cells (220 at most), never over rows times grid.
    """
    low_grid = [0.01 + i * (0.50 - 0.01) / 99 for i in range(100)]
    high_grid = [0.70 + i * (0.999 - 0.70) / 119 for i in range(120)]
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(low_grid + high_grid))])
    attack = F.col(label).cast("int") == 1
    cells = scored.select(
        F.size(F.filter(edges, lambda e: e <= F.col(prob))).alias("at_or_above"),
        F.size(F.filter(edges, lambda e: e < F.col(prob))).alias("above"),
        attack.alias("attack"),
    ).groupBy("at_or_above", "above").agg(F.count("*").alias("n"), F.count_if(F.col("attack")).alias("a"))
    grid = scored.sparkSession.createDataFrame(
        [("low", i, float(t)) for i, t in enumerate(low_grid)] + [("high", i, float(t)) for i, t in enumerate(high_grid)],
        "kind string, i int, t double",
    ).withColumn("pos", F.size(F.filter(edges, lambda e: e < F.col("t"))))
    # A row is below t when fewer edges are at or under it than t's own position + 1.
    joined = grid.join(F.broadcast(cells), how="cross").groupBy("kind", "i", "t").agg(  # grid x cells, both bounded
        F.sum(F.when(F.col("at_or_above") <= F.col("pos"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("at_or_above") <= F.col("pos"), F.col("a")).otherwise(0)).alias("below_attacks"),
        F.sum(F.when(F.col("above") > F.col("pos"), F.col("n")).otherwise(0)).alias("over"),
        F.sum(F.when(F.col("above") > F.col("pos"), F.col("a")).otherwise(0)).alias("over_attacks"),
        F.greatest(F.lit(1), F.sum("a")).alias("attacks"),
    )
    leak = F.col("below_attacks") / F.col("attacks")
    precision = F.when(F.col("over") > 0, F.col("over_attacks") / F.col("over"))
    picked = joined.agg(
        F.max_by(
            F.struct("t", "below", "below_attacks", leak.alias("leak")),
            F.when((F.col("kind") == "low") & (leak <= max_leak), F.col("i")),
        ).alias("low"),
        F.min_by(
            F.struct("t", "over", "over_attacks", precision.alias("precision")),
            F.when((F.col("kind") == "high") & (precision >= min_precision), F.col("i")),
        ).alias("high"),
    )
    return picked.select(
        F.coalesce("low.t", F.lit(0.0)).alias("low_threshold"), F.coalesce("high.t", F.lit(1.0)).alias("high_threshold"),
        F.col("low.below").alias("dismissed"), F.col("low.below_attacks").alias("dismissed_attacks"),
        F.col("low.leak").alias("attack_leak_rate"), F.col("high.over").alias("alerted"),
        F.col("high.over_attacks").alias("true_alerts"), F.col("high.precision").alias("alert_precision"),
    )


def routing_metrics(scored: DataFrame, low: float, high: float, label: str = "Label", prob: str = "prob") -> DataFrame:
    p, attack = F.col(prob), F.col(label).cast("int") == 1
    counts = scored.agg(
        F.count("*").alias("total"), F.count_if(attack).alias("attacks"),
        F.count_if(p < low).alias("auto_dismiss_count"), F.count_if(attack & (p < low)).alias("auto_dismiss_attack_count"),
        F.count_if(p > high).alias("auto_alert_count"), F.count_if(attack & (p > high)).alias("auto_alert_true_positive_count"),
    )
    total = F.col("total")
    review = total - F.col("auto_dismiss_count") - F.col("auto_alert_count")
    return counts.withColumns(
        {
            "auto_dismiss_rate": F.col("auto_dismiss_count") / total,
            "auto_dismiss_attack_leak_rate": F.col("auto_dismiss_attack_count") / F.greatest(F.lit(1), F.col("attacks")),
            "auto_alert_rate": F.col("auto_alert_count") / total,
            "auto_alert_false_positive_count": F.col("auto_alert_count") - F.col("auto_alert_true_positive_count"),
            "auto_alert_precision": F.when(
                F.col("auto_alert_count") > 0, F.col("auto_alert_true_positive_count") / F.col("auto_alert_count")
            ).otherwise(0.0),
            "review_count": review,
            "review_rate": review / total,
        }
    ).drop("total", "attacks")


def binary_metrics(scored: DataFrame, label: str = "Label", prob: str = "prob") -> DataFrame:
    """ROC-AUC, average precision, and precision / recall / f1 / confusion at 0.5.

    Scores are first reduced to counts per distinct value. Both areas are sums over distinct scores of terms that need
    the counts above, which are running sums from the highest score down.
    """
    attack = F.col(label).cast("int") == 1
    values = scored.groupBy(F.col(prob).alias("p")).agg(F.count_if(attack).alias("pos"), F.count_if(~attack).alias("neg"))
    curve = range_sums(values, [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("neg")})
    values = curve
    size = values.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    areas = curve.agg(
        # positives ranked above each negative, ties half
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"),
        F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") >= 0.5, F.col("neg")).otherwise(0)).alias("fp"),
    )
    joined = areas.join(size, how="cross")
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("P"), F.col("N")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(P > 0, tp / P).otherwise(0.0)
    out = joined.select(
        (F.col("wins") / (P * N)).alias("roc_auc"), (F.col("ap") / P).alias("pr_auc"),
        precision.alias("precision"), recall.alias("recall"), tp.alias("tp"), fp.alias("fp"), (P - tp).alias("fn"), (N - fp).alias("tn"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def multiclass_metrics(predicted: DataFrame, label: str = "family", guess: str = "predicted") -> DataFrame:
    """(class, precision, recall, f1, support) per class plus accuracy, macro and weighted rows."""
    pairs = predicted.groupBy(F.col(label).alias("y"), F.col(guess).alias("z")).agg(F.count("*").alias("n"))
    ends = F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"), F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("z").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")),
    )
    rows = pairs.select(F.explode(ends).alias("e")).groupBy("e.class").agg(
        F.sum("e.support").alias("support"), F.sum("e.called").alias("called"), F.sum("e.hit").alias("hit")
    )
    precision = F.when(F.col("called") > 0, F.col("hit") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    rows = rows.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    rows = rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    names = ("precision", "recall", "f1")
    accuracy = F.sum("hit") / F.sum("support")
    tail = [
        rows.agg(*[mean(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support"),
        rows.agg(*[weighted(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support"),
        rows.agg(*[accuracy.alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("accuracy").alias("class"), *names, "support"),
    ]
    result = rows.select("class", *names, "support")
    for part in tail:
        result = result.unionByName(part)
    return result


def confusion_matrix(predicted: DataFrame, label: str = "family", guess: str = "predicted") -> DataFrame:
    return predicted.groupBy(F.col(label).alias("actual")).pivot(guess, K.FAMILIES).agg(F.count(F.lit(1))).na.fill(0)
