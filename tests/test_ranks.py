"""Ranks, running sums and quantiles over sampled ranges."""

import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import ranks
from netsift.operators.ranks import lower_quantiles, range_rank, range_sums


def rows_of(kind, n=3_000):
    rng = random.Random(kind)
    if kind == "one value":
        return [("k", 1.0, i) for i in range(n)]
    if kind == "one hot key":
        return [("hot" if i % 3 else f"k{i}", rng.choice([0.5, 1.5, 1e12]), i) for i in range(n)]
    if kind == "repeated rows":
        return [("k", 1.0, 7)] * n + [("j", 2.0, 8)] * 5
    return [(rng.choice("abc"), rng.expovariate(1) ** 9, i) for i in range(n)]


KINDS = ["one value", "one hot key", "repeated rows", "heavy tail"]


@pytest.mark.parametrize("kind", KINDS)
def test_rank_and_sums(spark, kind):
    rows = rows_of(kind)
    frame = spark.createDataFrame(rows, "key string, v double, id long")
    ranked = range_rank(frame, [F.desc("v"), "id"], "r", total="n").collect()
    assert sorted(r.r for r in ranked) == list(range(1, len(rows) + 1)) and {r.n for r in ranked} == {len(rows)}
    assert [(r.v, r.id) for r in sorted(ranked, key=lambda r: r.r)] == [(v, i) for _, v, i in sorted(rows, key=lambda r: (-r[1], r[2]))]
    inside = range_rank(frame, ["v", "id"], "r", keys=["key"], total="n").collect()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in inside if r.key == key), key=lambda r: r.r)
        want = sorted((v, i) for k, v, i in rows if k == key)
        assert [(r.v, r.id) for r in own] == want and [r.r for r in own] == list(range(1, len(want) + 1)) and {r.n for r in own} == {len(want)}
    summed = sorted(range_sums(frame, ["v", "id"], {"upto": F.lit(1), "ids": F.col("id")}).collect(), key=lambda r: r.upto)
    assert [r.upto for r in summed] == list(range(1, len(rows) + 1))
    assert [r.ids for r in summed] == [sum(s) for s in zip([r.id for r in summed], [0, *[r.ids for r in summed[:-1]]], strict=True)]
    keyed = range_sums(frame, ["v", "id"], {"upto": F.lit(1)}, keys=["key"]).collect()
    for key in {r[0] for r in rows}:
        assert sorted(r.upto for r in keyed if r.key == key) == list(range(1, sum(k == key for k, _, _ in rows) + 1))


@pytest.mark.parametrize("small", [0, 100_000])
def test_hot_key_stays_spread(spark, monkeypatch, small):
    """With no join turned into a broadcast by size, no partition gets more than a few ranges of a key that holds all rows."""
    monkeypatch.setattr(ranks, "SMALL", small)
    frame = spark.createDataFrame([(None, float(i % 7), i) for i in range(4_000)], "key string, v double, id long")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {name: spark.conf.get(name) for name in off}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        ranked = range_rank(frame, ["v", "id"], "r", keys=["key"], total="n").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    assert sorted(r.r for r in ranked) == list(range(1, 4_001)) and {r.n for r in ranked} == {4_000}
    assert max(sum(r.p == p for r in ranked) for p in {r.p for r in ranked}) < 3_000


@pytest.mark.parametrize("kind", KINDS)
def test_lower_quantiles(spark, kind):
    rows = rows_of(kind)
    values = sorted(v for _, v, _ in rows)
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = lower_quantiles(frame, "v", [0.25, 0.5, 0.99]).first()
    assert (got.n, got.min, got.max) == (len(values), values[0], values[-1])
    assert [got.p25, got.p50, got.p99] == [values[int((len(values) - 1) * p)] for p in (0.25, 0.5, 0.99)]


def test_no_rows(spark):
    frame = spark.createDataFrame([], "key string, v double")
    assert range_rank(frame, ["v"], "r", total="n").collect() == []
    assert range_sums(frame, ["v"], {"s": F.col("v")}).collect() == []
    assert lower_quantiles(frame, "v", [0.5]).first().p50 is None
