"""Stored model versions: boosted trees with their metadata, the contract check, scores and exact contributions.

A version is one folder: ``metadata`` (rule, value as JSON), ``trees`` (all nodes of all trees, one row each) and one Spark ML
model per class label. Nothing is scored before the metadata has passed the check.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift import constants as K

BINARY = "binary"
FAMILY = "family"
ATTACK = "attack"
ROUNDS, DEPTH, STEP, SHARE = 700, 8, 0.08, 0.85
LEAST_GAIN = 0.01


# --- metadata and contract ---------------------------------------------------------


def contract(kind: str) -> dict:
    """What the metadata of a scoring model must say, by rule."""
    types = {f: "categorical_int" if f in K.CATEGORICAL_FEATURES else "numeric" for f in K.FEATURE_ORDER} | {"L4_DST_PORT": "service_port_int"}
    return {
        "feature_order": K.FEATURE_ORDER, "feature_types": types, "categorical_features": K.CATEGORICAL_FEATURES,
        "excluded_features": K.EXCLUDED_FEATURES, "class_labels": K.FAMILIES if kind == FAMILY else [ATTACK],
    }


def metadata_of(kind: str, encoders: dict[str, dict[str, int]]) -> dict:
    return contract(kind) | {"categorical_encoders": encoders}


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    """(rule, value): the metadata as a table with one JSON value per rule."""
    return spark.createDataFrame([(rule, json.dumps(value)) for rule, value in metadata.items()], "rule string, value string")


def read_metadata(rows: DataFrame, limit: int = 100) -> dict:
    return {r["rule"]: json.loads(r["value"]) for r in rows.limit(limit).collect()}


def checked_rules(metadata: dict, kind: str) -> dict[str, bool]:
    """For each of the six rules whether the metadata keeps it. Encoders need codes for every categorical feature."""
    kept = {rule: metadata.get(rule) == wanted for rule, wanted in contract(kind).items()}
    encoders = metadata.get("categorical_encoders") or {}
    kept["categorical_encoders"] = set(encoders) == set(K.CATEGORICAL_FEATURES) and all(encoders.values())
    return kept


def check_contract(metadata: dict, kind: str = BINARY) -> None:
    """Refuses a model that was not trained on the current feature contract."""
    failed = [rule for rule, ok in checked_rules(metadata, kind).items() if not ok]
    if failed:
        raise ValueError("model metadata does not match the feature contract: " + ", ".join(failed))


# --- training ------------------------------------------------------------------------


def with_class_weight(rows: DataFrame, label: str = "Label") -> DataFrame:
    """Attack rows weigh negatives / positives of the train split."""
    counts = rows.filter(F.col("split") == "train").agg(
        F.count_if(F.col(label) == 0).alias("_neg"), F.greatest(F.lit(1), F.count_if(F.col(label) == 1)).alias("_pos")
    )
    weight = F.when(F.col(label) == 1, F.col("_neg") / F.col("_pos")).otherwise(1.0)
    return rows.join(F.broadcast(counts), how="cross").withColumn("weight", weight).drop("_neg", "_pos")  # one row


def boosted(
    matrix: DataFrame, label: str = "Label", *, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, share: float = SHARE, seed: int = 42
) -> GBTClassificationModel:
    """Boosted trees on (x, label, split) with class weights.

    Up to ``rounds`` trees; training ends when a round improves the validation split by less than ``LEAST_GAIN`` of its
    error. Each tree sees ``share`` of the rows and each node ``share`` of the features.
    """
    used = with_class_weight(matrix.filter(F.col("split").isin("train", "validation")), label)
    trainer = GBTClassifier(
        featuresCol="x", labelCol=label, weightCol="weight", validationIndicatorCol="is_validation", validationTol=LEAST_GAIN,
        maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed,
    )
    return trainer.fit(used.withColumn("is_validation", F.col("split") == "validation"))


def train_binary(matrix: DataFrame, **settings) -> dict[str, GBTClassificationModel]:
    return {ATTACK: boosted(matrix, **settings)}


def train_family(matrix: DataFrame, *, at_once: int = 6, **settings) -> dict[str, GBTClassificationModel]:
    """One booster per attack family against the rest, on attack rows (x, family, split); ``at_once`` fits share the cluster."""

    def one(family: str) -> GBTClassificationModel:
        return boosted(matrix.withColumn("is_family", (F.col("family") == family).cast("int")), "is_family", **settings)

    spark = matrix.sparkSession
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(K.FAMILIES, pool.map(inheritable_thread_target(spark)(one), K.FAMILIES), strict=True))


# --- versions ------------------------------------------------------------------------


@dataclass
class Version:
    """A checked model version: its kind, metadata, models by class label and the folder it came from."""

    kind: str
    metadata: dict
    models: dict[str, GBTClassificationModel]
    folder: str

    @property
    def encoders(self) -> dict[str, dict[str, int]]:
        return self.metadata["categorical_encoders"]


def save_version(spark: SparkSession, folder: str, kind: str, models: dict[str, GBTClassificationModel], encoders: dict) -> None:
    """Writes models, trees and, last, the metadata; a folder without metadata is no version."""
    for label, model in models.items():
        model.write().overwrite().save(f"{folder}/models/{label}")
    stored_trees(spark, folder, list(models)).write.mode("overwrite").parquet(f"{folder}/trees")
    metadata_frame(spark, metadata_of(kind, encoders)).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")


def load_version(spark: SparkSession, folder: str, kind: str) -> Version:
    metadata = read_metadata(spark.read.schema("rule string, value string").json(f"{folder}/metadata"))
    check_contract(metadata, kind)
    models = {label: GBTClassificationModel.load(f"{folder}/models/{label}") for label in metadata["class_labels"]}
    return Version(kind, metadata, models, folder)


def stored_trees(spark: SparkSession, folder: str, labels: list[str]) -> DataFrame:
    """(label, tree, weight, node, feature, threshold, left, right, value, cover): every node of the saved models; leaves have feature -1."""
    found = None
    for label in labels:
        path = f"{folder}/models/{label}"
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
        split = F.col("nodeData.split")
        nodes = spark.read.parquet(f"{path}/data").select(
            F.lit(label).alias("label"), F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), split["featureIndex"].alias("feature"),
            F.try_element_at(split["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"), F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.rawCount").cast("double").alias("cover"),
        )
        nodes = nodes.join(F.broadcast(weights), "tree")  # one row per tree
        found = nodes if found is None else found.unionByName(nodes)
    return found.withColumn("feature", F.when(F.col("left") < 0, F.lit(-1)).otherwise(F.col("feature")))


# --- scores --------------------------------------------------------------------------


def _bounded(p):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def with_probability(rows: DataFrame, model: GBTClassificationModel, name: str) -> DataFrame:
    scorer = model.copy().setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction")
    scored = scorer.transform(rows).withColumn(name, _bounded(vector_to_array(F.col("_probability")).getItem(1)))
    return scored.drop("_raw", "_probability", "_prediction")


def score_binary(version: Version, matrix: DataFrame) -> DataFrame:
    """``prob`` of an attack, the hint at 0.5 and its confidence."""
    scored = with_probability(matrix, version.models[ATTACK], "prob")
    hint = F.when(F.col("prob") >= 0.5, "malicious").otherwise("benign")
    return scored.withColumns({"category_hint": hint, "category_confidence": F.greatest(F.col("prob"), 1 - F.col("prob"))})


def score_family(version: Version | None, matrix: DataFrame) -> DataFrame:
    """``family_probs`` (in label order, summing to one), the most likely family and its probability; first of equal ones.

    Without a model nothing is evaluated.
    """
    if version is None:
        return matrix.withColumns({"category_hint": F.lit("not_evaluated"), "category_confidence": F.lit(0.0)})
    labels = version.metadata["class_labels"]
    scored = matrix
    for k, label in enumerate(labels):
        scored = with_probability(scored, version.models[label], f"_p{k}")
    raw = F.array(*[F.greatest(F.col(f"_p{k}"), F.lit(1e-12)) for k in range(len(labels))])
    total = F.aggregate("_raw", F.lit(0.0), lambda a, p: a + p)
    scored = scored.withColumn("_raw", raw).withColumn("family_probs", F.transform("_raw", lambda p: p / total))
    best = F.array_max("family_probs")
    names = F.array(*[F.lit(f) for f in labels])
    hint = F.element_at(names, F.array_position("family_probs", best).cast("int"))
    return scored.withColumns({"category_hint": hint, "category_confidence": _bounded(best)}).drop("_raw", *[f"_p{k}" for k in range(len(labels))])


# --- contributions -------------------------------------------------------------------


@dataclass
class Leaf:
    """A leaf's weighted value, its cover share, and for each feature on its path: the range (low, high] and the cover share kept."""

    value: float
    share: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kept: np.ndarray


def leaves_of(nodes: dict[int, tuple], weight: float) -> list[Leaf]:
    """``nodes``: id to (feature, threshold, left, right, value, cover)."""
    out = []
    waiting = [(0, {})]
    while waiting:
        at, path = waiting.pop()
        feature, threshold, left, right, value, cover = nodes[at]
        if feature < 0:
            names = sorted(path)
            ranges = np.array([path[f] for f in names]).reshape(-1, 3)
            out.append(Leaf(weight * value, cover / nodes[0][5], np.array(names, int), ranges[:, 0], ranges[:, 1], ranges[:, 2]))
            continue
        low, high, kept = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, limits in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            waiting.append((child, path | {feature: (*limits, kept * nodes[child][5] / cover)}))
    return out


def leaf_contributions(leaf: Leaf, known: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf for rows of ``known`` (whether the row is inside each feature's range).

    The weight of a subset of the other features is an integral over t of t where a feature is known and 1 - t where it
    is not, so the sum over all subsets is the integral of a product: a polynomial, integrated exactly by Gauss nodes.
    """
    d = len(leaf.features)
    nodes, weights = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
    t, weights = (nodes + 1) / 2, weights / 2
    factor = (1 - t) * leaf.kept[:, None] + t * known[:, :, None]
    product = factor.prod(axis=1, keepdims=True)
    return leaf.value * (known - leaf.kept) * ((product / factor) @ weights)


def contributions(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact contributions (rows x features) to the sum of all trees, and the base that they add to.

    Rows that fall alike inside a leaf's ranges share one computation, 2 ** depth of them at most.
    """
    total = np.zeros_like(x)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        own = x[:, leaf.features]
        known = (own > leaf.low) & (own <= leaf.high)
        code = known @ (1 << np.arange(len(leaf.features)))
        first, back = np.unique(code, return_index=True, return_inverse=True)[1:]
        total[:, leaf.features] += leaf_contributions(leaf, known[first].astype(np.float64))[back]
    return total, sum(leaf.value * leaf.share for leaf in leaves)


def version_leaves(spark: SparkSession, version: Version, label: str = ATTACK) -> list[Leaf]:
    """The leaves of one booster; its size is bounded by rounds x 2 ** depth."""
    trees: dict[int, tuple[float, dict]] = {}
    for r in spark.read.parquet(f"{version.folder}/trees").where(F.col("label") == label).collect():
        trees.setdefault(r["tree"], (r["weight"], {}))[1][r["node"]] = (r["feature"], r["threshold"], r["left"], r["right"], r["value"], r["cover"])
    return [leaf for k in sorted(trees) for leaf in leaves_of(trees[k][1], trees[k][0])]


def explain_scores(version: Version, matrix: DataFrame, key: str = "flow_id", label: str = ATTACK) -> DataFrame:
    """(key, base, margin, contributions): for every row what each feature adds to the base; together they are the margin."""
    spark = matrix.sparkSession
    sent = spark.sparkContext.broadcast(version_leaves(spark, version, label))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([np.asarray(v) for v in batch.column(1).to_numpy(zero_copy_only=False)])
            total, base = contributions(sent.value, x)
            width = np.arange(0, total.size + 1, total.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(x), base)), pa.array(base + total.sum(axis=1)), lists], ["key", "base", "margin", "contributions"]
            )

    rows = matrix.select(F.col(key).cast("string").alias("key"), vector_to_array(F.col("x")).alias("xs"))
    found = rows.mapInArrow(work, "key string, base double, margin double, contributions array<double>")
    return found.withColumnRenamed("key", key)


def with_attributions(explained: DataFrame, features: list[str], limit: int = 5) -> DataFrame:
    """Adds ``attributions``: the ``limit`` features with the largest absolute contribution, by contract order on ties."""
    from netsift.operators.routing import top_attributions

    names = F.array(*[F.lit(f) for f in features])
    entries = F.zip_with(names, "contributions", lambda f, c: F.struct(f.alias("feature"), c.alias("contribution")))
    return explained.withColumn("attributions", top_attributions(entries, limit))
