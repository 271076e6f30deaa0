"""The two classifiers: held-out accuracy, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import labels as labels_of
from netsift.llm import quality as Q
from netsift.llm import registry
from netsift.llm import toxicity as X

FOLDER = "/root/testdata/sf0.1"


def auc(scores, target):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for value in np.unique(scores):
        ranks[scores == value] = np.flatnonzero(scores[order] == value).mean() + 1
    ones = target == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("query, label, least", [(Q.op6_quality, "quality", 0.98), (X.op1_toxicity, "toxic", 0.95)])
def test_held_out_rows(spark, query, label, least):
    rows = query(spark, FOLDER)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    known = registry.table(spark, FOLDER, "labels")
    got = rows.where("held_out").join(known, "doc_id").select("score", "predicted", label).toPandas()
    assert auc(got.score.to_numpy(), got[label].to_numpy()) > least
    assert (got.predicted == got[label]).mean() > 0.98
    assert rows.count() == registry.table(spark, FOLDER, "documents").count()


def test_quality_odd_rows(spark, odd_documents, no_documents, documents, labels):
    both = odd_documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000).select("doc_id", "text"), allowMissingColumns=True)
    moved = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 5), (1004, 0), (1004, 1), (8, 1)], "doc_id bigint, quality int")
    known = moved.select("doc_id", "quality").unionByName(odd)
    model = Q.fit(both, known)
    rows = Q.with_scores(both.select(F.col("doc_id").alias("payload"), "text"), model).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert Q.keep_good(both, known).columns == both.columns
    nothing = Q.fit(both, known.limit(0))
    assert {r.score for r in Q.with_scores(both.select(F.col("doc_id").alias("payload"), "text"), nothing).collect()} == {0.5}
    assert Q.keep_good(no_documents, known).collect() == []


def test_toxicity_odd_rows(odd_documents, no_documents, labels):
    model = X.fit(odd_documents, labels)
    rows = X.with_features(odd_documents.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id"), model.entries, model.stems, "doc_id").collect()
    assert len(rows) == odd_documents.count()
    empty = X.fit(no_documents, labels.limit(0))
    assert empty.entries == empty.stems == [] and empty.scores(np.zeros((1, X.FEATURES)))[0] < 1e-6


def test_regression_of_parted_labels():
    """Newton steps overshoot where one feature parts the labels; the constant used to run away."""
    x = np.zeros((386, 2))
    x[:40, 0], x[:40, 1] = np.log1p(3), 1
    weights = X.regression(x, (np.arange(386) < 40).astype(float))
    assert np.abs(weights).max() < 20 and x[0] @ weights[:-1] + weights[-1] > 0 > weights[-1]


@pytest.mark.parametrize("marked, share", [(1, 0.1), (0, 0.1), (1, 0.5), (0, 0.5)])
def test_toxicity_ranks_either_label(spark, marked, share):
    """The telling words may be those of label 1 or 0, and the label may be rare or held by half of the rows."""
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("abcdefghijklmnoprst"), 6)) for _ in range(3000)]
    rows = []
    for i in range(600):
        text = list(rng.choice(plain, 60))
        has = rng.random() < share
        if has:
            text[10:40:10] = rng.choice(["zworm", "wquizz", "yzunder"], 3)
        rows.append((i, " ".join(text), marked if has else 1 - marked))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = X.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    held = docs.where(labels_of.remainder(F.col("doc_id"), X.FOLDS) == 1)
    got = X.with_features(held.select("text", "toxic"), model.entries, model.stems, "toxic", model.clean).toArrow()
    scores = model.scores(np.array(got.column("features").to_pylist()))
    target = np.array(got.column("toxic").to_pylist())
    assert auc(scores, target) > 0.95


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    entries = sorted({word(n) for n in rng.integers(3, 9, 60)})
    trie = X.Trie(entries, ["cacacac"])
    for text in [word(n) for n in rng.integers(1, 10, 4000)]:
        want = X.NO_HIT
        if text in entries:
            want = X.EXACT
        elif text.startswith("cacacac"):
            want = X.STEM
        elif any(len(e) >= X.FUZZY_LENGTH and distance(e, text) == 1 for e in entries):
            want = X.FUZZY
        assert trie.judge(text) == want, text


def test_settings_of_hits():
    import pyarrow as pa

    from netsift.llm import words

    reader = X.Reader(X.Trie(["idiot", "trash"], []))
    texts = ["you are an idiot", 'he wrote "what an idiot" again', "he said idiot", "idi0t", "«idiot» here", "“idiot” here", "", "nothing at all"]
    (_, _, w), = words.column_words(X.with_straight_quotes(pa.array(texts)), words.ALNUM)
    got = reader.features(w) > 0
    plain, quoted, fuzzy, aimed = got[:, 0], got[:, 1], got[:, 4], got[:, 6]
    assert plain.tolist() == [True, False, False, False, False, False, False, False]
    assert quoted.tolist() == [False, True, True, False, True, True, False, False]
    assert fuzzy.tolist() == [False, False, False, True, False, False, False, False] and aimed.tolist() == [True] + [False] * 7
