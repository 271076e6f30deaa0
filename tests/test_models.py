"""Boosted models: exact contributions, stored versions, the contract check."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from netsift import constants as K
from netsift.operators import learning as L
from netsift.operators import models as M
from netsift.plans import inputs

ENCODERS = {f: {"a": 0} for f in K.CATEGORICAL_FEATURES}


def random_tree(rng, depth, features):
    """Nodes by id: (feature, threshold, left, right, value, cover); features repeat along paths."""
    nodes = {}

    def grow(level, cover):
        at = len(nodes)
        nodes[at] = None
        if level == depth or cover < 2:
            nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), cover)
            return at
        part = int(rng.integers(1, cover))
        left, right = grow(level + 1, part), grow(level + 1, cover - part)
        nodes[at] = (int(rng.integers(features)), float(rng.normal()), left, right, 0.0, cover)
        return at

    grow(0, 500)
    return nodes


def expected_value(nodes, x, known, at=0):
    feature, threshold, left, right, value, cover = nodes[at]
    if feature < 0:
        return value
    if feature in known:
        return expected_value(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][5] / cover * expected_value(nodes, x, known, c) for c in (left, right))


def by_enumeration(nodes, x, features):
    out = np.zeros(features)
    for j in range(features):
        others = [f for f in range(features) if f != j]
        for size in range(features):
            share = factorial(size) * factorial(features - size - 1) / factorial(features)
            for s in combinations(others, size):
                out[j] += share * (expected_value(nodes, x, {*s, j}) - expected_value(nodes, x, set(s)))
    return out


def test_contributions_equal_enumeration():
    rng = np.random.default_rng(3)
    for depth in (0, 1, 3, 6):
        trees = [(random_tree(rng, depth, 5), w) for w in (1.0, 0.3)]
        x = rng.normal(size=(12, 5))
        total, base = M.contributions([leaf for nodes, w in trees for leaf in M.leaves_of(nodes, w)], x)
        want = [sum(w * by_enumeration(nodes, row, 5) for nodes, w in trees) for row in x]
        assert np.allclose(total, want)
        assert np.isclose(base, sum(w * expected_value(nodes, x[0], set()) for nodes, w in trees))


@pytest.fixture(scope="module")
def trained(spark, data, tmp_path_factory):
    rows = inputs.view(spark, data, "ml_features").withColumn(
        "split", F.element_at(F.array(*[F.lit(s) for s in L.SPLITS]), (F.col("arrival") % 3 + 1).cast("int"))
    )
    maps = L.collect_maps(L.fit_categorical_maps(rows.filter("split = 'train'"), K.CATEGORICAL_FEATURES))
    path = str(tmp_path_factory.mktemp("models"))
    L.make_matrix(rows, K.FEATURE_ORDER, maps).select("flow_id", "x", "Label", "Attack", "split").write.parquet(f"{path}/matrix")
    matrix = spark.read.parquet(f"{path}/matrix")
    M.save_version(spark, f"{path}/binary", M.BINARY, M.train_binary(matrix, rounds=6, depth=4), maps)
    attacks = L.attack_frame(matrix.filter("Label = 1"))
    M.save_version(spark, f"{path}/family", M.FAMILY, M.train_family(attacks, rounds=4, depth=4, step=0.5), maps)
    return path, matrix, attacks


def test_contributions_add_up_to_the_margin(spark, trained):
    path, matrix, _ = trained
    version = M.load_version(spark, f"{path}/binary", M.BINARY)
    explained = M.explain_scores(version, matrix)
    raw = version.models[M.ATTACK].transform(matrix).select("flow_id", vector_to_array("rawPrediction")[1].alias("raw"))
    added = F.aggregate("contributions", F.col("base"), lambda a, c: a + c)
    rows = explained.join(raw, "flow_id").select((added - F.col("raw")).alias("d"), (F.col("margin") - F.col("raw")).alias("e"), F.size("contributions").alias("n")).collect()
    assert len(rows) == matrix.count() and {r.n for r in rows} == {len(K.FEATURE_ORDER)}
    assert max(abs(r.d) + abs(r.e) for r in rows) < 1e-9
    top = M.with_attributions(explained, K.FEATURE_ORDER).first()
    sizes = [abs(a["contribution"]) for a in top["attributions"]]
    assert len(sizes) == 5 and sizes == sorted((abs(c) for c in top["contributions"]), reverse=True)[:5]
    assert M.explain_scores(version, matrix.limit(0)).collect() == []


def test_family_probabilities(spark, trained):
    path, matrix, attacks = trained
    version = M.load_version(spark, f"{path}/family", M.FAMILY)
    scored = M.score_family(version, attacks.filter("split = 'test'"))
    rows = scored.select("family", "category_hint", "category_confidence", "family_probs").collect()
    for r in rows:
        assert abs(sum(r.family_probs) - 1) < 1e-9 and r.category_confidence == max(r.family_probs)
        assert r.category_hint == K.FAMILIES[r.family_probs.index(max(r.family_probs))]
    often = max(sum(r.family == f for r in rows) for f in K.FAMILIES)
    assert sum(r.family == r.category_hint for r in rows) > often
    prob = M.score_binary(M.load_version(spark, f"{path}/binary", M.BINARY), matrix).select("prob", "category_confidence").collect()
    assert all(0 <= r.prob <= 1 and r.category_confidence == max(r.prob, 1 - r.prob) for r in prob)
    assert {r.category_hint for r in M.score_family(None, matrix.limit(3)).collect()} == {"not_evaluated"}


@pytest.mark.parametrize("kind", [M.BINARY, M.FAMILY])
def test_contract(spark, kind, tmp_path, trained):
    good = M.metadata_of(kind, ENCODERS)
    M.check_contract(good, kind)
    for rule in good:
        for value in (None, [], {}):
            with pytest.raises(ValueError, match=rule):
                M.check_contract(good | {rule: value}, kind)
        with pytest.raises(ValueError, match=rule):
            M.check_contract({k: v for k, v in good.items() if k != rule}, kind)
    assert M.read_metadata(M.metadata_frame(spark, good)) == good
    with pytest.raises(ValueError, match="feature_order"):
        M.check_contract(good | {"feature_order": K.FEATURE_ORDER[::-1]}, kind)
    with pytest.raises(ValueError, match="categorical_encoders"):
        M.check_contract(good | {"categorical_encoders": ENCODERS | {"PROTOCOL": {}}}, kind)
    M.metadata_frame(spark, good | {"class_labels": ["other"]}).write.json(f"{tmp_path}/metadata")
    with pytest.raises(ValueError, match="class_labels"):
        M.load_version(spark, str(tmp_path), kind)
