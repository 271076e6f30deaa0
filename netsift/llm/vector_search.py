"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each quantised by its own ``centroids`` centres, so a cell is a pair of centres. The
centres are fitted by Lloyd rounds on a bounded sample (``FIT_ROWS`` rows with the smallest hash); every row is
indexed. A query walks the cells in the order of summed half distances, with a heap over pairs of ranked centres, until the
cells walked hold ``share`` of all rows (``least`` at least). All rows of those cells are reranked by the exact
distance on the original vectors.

Cells are dealt into shards of equal row counts; a cell of more rows, such as one of a very common vector, is cut
by a hash of its rows. Only the table of cell counts (centroids^2 numbers) reaches the driver. Inside a shard its
rows come first and are held, at most about ``SHARD_ROWS`` of them, and queries stream by in Arrow batches, so neither the
number of queries nor of rows per cell bounds memory. A shard gives its 10 nearest per query; a ranking limited before
and after its shuffle merges them.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
nor do rows without id. Ties go to the smaller id. Rows of the query's own id are never its results. Repeated
candidate rows are results each; of repeated query ids the smallest vector asks. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.llm import registry

CENTROIDS = 64
FIT_ROWS = 16_384
SHARE = 0.5
LEAST = 2_000
SHARD_ROWS = 8_192
ROUNDS = 12


def fit_centres(sample: np.ndarray, centroids: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd rounds from evenly spaced rows of the sample; deterministic."""
    centres = sample[np.linspace(0, len(sample) - 1, min(centroids, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = half_distances(sample, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def half_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * rows @ centres.T, 0)


def walk_cells(left: np.ndarray, right: np.ndarray, counts: np.ndarray, target: int) -> list[int]:
    """Filled cells by summed half distance until they hold ``target`` rows."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    heap, cells, held = [(left[a[0]] + right[b[0]], 0, 0)], [], 0
    while heap and held < target:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (left[a[i]] + right[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (left[a[i + 1]] + right[b[0]], i + 1, 0))
    return cells


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds doubles of the most common length."""
    rows = vectors.select(
        vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("v")
    ).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0].n if lengths else 0))


def deal_cells(counts: np.ndarray, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each cell and how many shards it spans, so that no shard gets much more than ``per_shard``."""
    first, span = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, free = 0, per_shard
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > free and free < per_shard:
            shard, free = shard + 1, per_shard
        first[cell] = shard
        if n > per_shard:
            span[cell] = -(-n // per_shard)
            shard, free = shard + int(span[cell]), per_shard
        else:
            free -= n
    return first, span


def nearest(
    vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """For each row for which the SQL text ``is_query`` (over ``id`` and ``v``) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "v").limit(fit_rows).collect()
    if not sample:
        return spark.createDataFrame([], shape)
    fit = np.array([r.v for r in sample])
    half = fit.shape[1] // 2
    left, right = fit_centres(fit[:, :half], centroids), fit_centres(fit[:, half:], centroids)
    cells = len(left) * len(right)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            cell = half_distances(x[:, :half], left).argmin(axis=1) * len(right) + half_distances(x[:, half:], right).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    indexed = rows.mapInArrow(index, "id bigint, v array<double>, cell int")
    counts = np.zeros(cells, np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row per cell
        counts[r.cell] = r["count"]
    total = int(counts.sum())
    target = max(least, int(np.ceil(share * total)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = max(1, min(SHARD_ROWS, -(-total // tasks)))
    first, span = deal_cells(counts, per_shard)
    shards = int((first + span).max())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, key = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shard = first[cell] + key % span[cell]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(cell), np.int8)), batch.column(0),
                    batch.column(1), pa.array(cell[:, None].tolist(), pa.list_(pa.int32())),
                ],
                ["shard", "asks", "id", "v", "cells"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each shard that holds a cell of its walk."""
        for batch in batches:
            x = matrix(batch.column(1))
            for r in range(len(x)):
                row = x[r : r + 1]
                walk = walk_cells(half_distances(row[:, :half], left)[0], half_distances(row[:, half:], right)[0], counts, target)
                to: dict[int, list[int]] = {}
                for cell in walk:
                    for shard in range(first[cell], first[cell] + span[cell]):
                        to.setdefault(shard, []).append(cell)
                n = len(to)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(to), pa.int32()), pa.array(np.ones(n, np.int8)), pa.array([batch.column(0)[r].as_py()] * n, pa.int64()),
                        pa.array([x[r]] * n, pa.list_(pa.float64())), pa.array(list(to.values()), pa.list_(pa.int32())),
                    ],
                    ["shard", "asks", "id", "v", "cells"],
                )

    dealt = "shard int, asks tinyint, id bigint, v array<double>, cells array<int>"
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    placed = indexed.withColumn("key", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))).mapInArrow(place, dealt)
    both = placed.unionByName(queries.mapInArrow(ask, dealt))
    parts = min(shards, max(tasks, 1))
    ordered = both.repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard", "asks")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs, cs, ready = None, [], [], [], None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy()
            borders = np.flatnonzero(np.diff(shard, prepend=-1) | np.diff(asks, prepend=-1))
            for a, z in zip(borders.tolist(), [*borders[1:].tolist(), len(shard)], strict=True):
                part = batch.slice(a, z - a)
                if shard[a] != now:
                    now, ids, xs, cs, ready = shard[a], [], [], [], None
                if not asks[a]:
                    ids.append(part.column(2).to_numpy()), xs.append(matrix(part.column(3)))
                    cs.append(part.column(4).flatten().to_numpy())
                    continue
                if ready is None and ids:
                    ready = np.concatenate(ids), np.concatenate(xs), np.concatenate(cs)
                if ready is not None:
                    yield from _top(part, *ready, cells, k)

    found = ordered.mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(
    part: pa.RecordBatch, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, cells: int, k: int, block: int = 128
) -> Iterator[pa.RecordBatch]:
    """The k nearest of a shard's rows for each query, among the rows of its walked cells."""
    query, q, walks = part.column(2).to_numpy(), matrix(part.column(3)), part.column(4)
    norms = (x**2).sum(axis=1)
    for a in range(0, len(query), block):
        own = q[a : a + block]
        near = np.maximum((own**2).sum(axis=1)[:, None] + norms - 2 * own @ x.T, 0)
        out_q, out_id, out_d = [], [], []
        walked = np.zeros(cells, bool)
        for r in range(len(own)):
            held = walks[a + r].values.to_numpy()
            walked[held] = True
            at = np.flatnonzero(walked[cell] & (ids != query[a + r]))
            walked[held] = False
            if len(at) > k:  # rounding moves these by less than the slack; the exact measure below decides
                d = near[r, at]
                at = at[d <= np.partition(d, k - 1)[k - 1] + 1e-9 * (1 + norms[at] + (own[r] ** 2).sum())]
            exact = np.sqrt(((x[at] - own[r]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            out_q.append(np.full(len(best), query[a + r])), out_id.append(ids[at[best]]), out_d.append(exact[best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(p)) for p in (out_q, out_id, out_d)], ["query_id", "vec_id", "score"]
        )


@registry.query("op10_vector_search")
def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every vector whose id is divisible by 100. Approximate, so no SQL; recall is tested."""
    return nearest(registry.table(spark, sf_dir, "embeddings"), "pmod(id, 100) = 0")
