import numpy as np
import pytest

from netsift.llm import vector_search as V


def brute(ids, x, query, k=10):
    own = x[np.flatnonzero(ids == query)[0]]
    d = np.sqrt(((x - own) ** 2).sum(axis=1))
    d[ids == query] = np.inf
    best = np.lexsort((ids, d))[:k]
    return [int(i) for i, v in zip(ids[best], d[best], strict=True) if v < np.inf], d


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_recall_and_scores(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    local = frame.select("vec_id", "embedding").toPandas()
    ids, x = local.vec_id.to_numpy(), np.array(local.embedding.tolist(), dtype=np.float64)
    rows = V.nearest(frame, "pmod(id, 100) = 0", least=100).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r["rank"]] = r
    hits = 0
    for query, ranks in found.items():
        want, d = brute(ids, x, query)
        assert sorted(ranks) == list(range(1, 11))
        got = [ranks[k].vec_id for k in range(1, 11)]
        assert got == sorted(got, key=lambda i: (d[np.flatnonzero(ids == i)[0]], i))
        assert all(abs(ranks[k].score - d[np.flatnonzero(ids == ranks[k].vec_id)[0]]) < 1e-12 for k in ranks)
        hits += len({*want} & {*got})
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)


def test_cells_are_walked_by_summed_distance():
    rng = np.random.default_rng(1)
    left, right, counts = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    walked = V.walk_cells(left, right, counts, 10**9)
    sums = (left[:, None] + right).ravel()
    assert walked == [c for c in np.argsort(sums, kind="stable").tolist() if counts[c]]
    few = V.walk_cells(left, right, counts, 5)
    assert few == walked[: len(few)] and counts[few].sum() >= 5 > counts[few[:-1]].sum()


def test_hot_cells_are_cut():
    counts = np.array([5, 0, 100, 7, 1])
    first, span = V.deal_cells(counts, 10)
    assert span[2] == 10 and first[2] > first[0] and first[3] >= first[2] + 10


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(100 * k, same) for k in range(3)] + [(k, same) for k in range(1, 40)] + [
        (700, None), (701, [0.0] * 4), (702, [1.0, None, 2.0, 3.0]), (703, [float("nan"), 1.0, 1.0, 1.0]), (704, [float("inf"), 1.0, 1.0, 1.0]),
        (705, [1.0]), (None, same), (5, same), (100, [9.0, 9.0, 9.0, 9.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 v", "'q' id", "2 cell")
    found = V.nearest(frame, "pmod(id, 100) = 0").collect()
    top = sorted((r["rank"], r.vec_id) for r in found if r.query_id == 200)
    assert [v for _, v in top] == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    assert not {r.vec_id for r in found} & {700, 701, 702, 703, 704, 705}
    few = V.nearest(frame.where("vec_id in (0, 1, 2)"), "pmod(id, 100) = 0").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert V.nearest(frame.limit(0), "pmod(id, 100) = 0").collect() == []
