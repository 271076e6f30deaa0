import zlib

import pytest

import corpus_pipeline as P
from netsift.llm import quality as Q
from netsift.llm import secret_scan as S
from tests.llm import test_decontamination, test_near_duplicates, test_packing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_columns_stay(steps):
    for name, _ in P.STAGES[:-1]:
        assert steps[name].columns == steps["documents"].columns
        assert steps[name].dtypes == steps["documents"].dtypes


def test_quality_keeps_what_scores(spark, steps):
    docs = steps["documents"]
    model = Q.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = Q.with_scores(docs.selectExpr("doc_id payload", "text"), model).collect()
    assert {*texts(steps["quality"])} == {r.payload for r in rows if r.score >= Q.THRESHOLD}


def test_one_of_each_group(steps):
    before = list(texts(steps["quality"]).items())
    want = {i for i, _, _, kept in test_near_duplicates.brute(before, 5, 80) if kept}
    assert {*texts(steps["near_duplicates"])} == want


def test_benchmark_goes(spark, steps):
    before = list(texts(steps["near_duplicates"]).items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {i for i, _, hit, _ in test_decontamination.brute(before, items, 10) if not hit}
    assert {*texts(steps["decontamination"])} == want


def test_secrets_are_masked(steps):
    before, after = texts(steps["decontamination"]), steps["secrets"].collect()
    words = S.automaton()
    assert {r.doc_id for r in after} == {*before}
    for r in after:
        assert (r.text == before[r.doc_id]) == (not S.scan(before[r.doc_id], words)) and r.n_chars == len(r.text)


def test_all_is_packed(spark, steps):
    assert test_packing.sound(steps["packing"].collect(), texts(steps["secrets"]), 2048) < 0.02
    ids = {r.doc_id for r in P.run(spark, FOLDER).select("doc_id").collect()}
    assert ids == {*texts(steps["secrets"])} and zlib.crc32(b"") == 0
