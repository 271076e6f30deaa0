"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of its byte trigrams and of runs of letter shapes, hashed to ``DIMS`` numbers, and of repeated
words, rooted and weighted by inverse document frequency over all documents, and projected on the leading singular vectors of a bounded labelled sample (at most ``FIT_ROWS``
rows, a documented parameter). The sample's projected vectors with their labels are broadcast: at most FIT_ROWS x RANK
numbers. Every document is compared with all of them in blocks of exact cosine products; its ``NEIGHBOURS`` nearest
vote for their labels, weighted by similarity.

Null and empty texts (and those shorter than a trigram) have no vector; their score is the mean label of the sample.
Without labelled rows every score is 0.5. Ids, languages, sources and labels are never inputs of a score. Repeated rows
score alike; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import carry, labels, registry, words
from netsift.session import run_folder

DIMS = 4096
RANK = 64
FIT_ROWS = 4096
NEIGHBOURS = 24
BLOCK_ROWS = 512
BLOCK = 256
PASSES = 4
POWER = 4
THRESHOLD = 0.3
FOLDS = 5


def _hashed(codes: list[np.ndarray], dims: int) -> np.ndarray:
    """One dimension for each run of codes."""
    key = codes[0].astype(np.uint32)
    for more in codes[1:]:
        key = (key * np.uint32(0x01000193)) ^ more
    key = ((key * np.uint32(0x9E3779B1)) ^ (key >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    return (key >> np.uint32(16)) % np.uint32(dims)


#: Letters by case, digits as one; all other ASCII bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[48:58], SHAPE[65:91], SHAPE[97:123], SHAPE[128:] = 48, 65, 97, 97


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, term counts) over the pieces of a text column.

    Terms are hashed byte trigrams, hashed runs of four byte shapes, and in the last two dimensions the words
    that do, and do not, equal one of the three words before them.
    """
    half = DIMS // 2
    data, offsets = words.text_bytes(column)
    for a, b in words.pieces(offsets, 1 << 20, BLOCK_ROWS):
        raw = data[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        counts = np.zeros((b - a, DIMS + 2), np.float32)
        row = np.repeat(np.arange(b - a), np.diff(own))
        for n, codes, first in ((3, raw.astype(np.uint32), 0), (4, SHAPE[raw], half)):
            if len(raw) >= n:
                inside = row[: 1 - n] == row[n - 1 :]
                bucket = _hashed([codes[k : len(codes) - n + 1 + k] for k in range(n)], half)
                flat = np.bincount(row[: 1 - n][inside] * half + bucket[inside], minlength=(b - a) * half)
                counts[:, first : first + half] = flat.reshape(b - a, half)
        found = words.find_words(raw, own)
        of, again = found.row_of(), np.zeros(len(found.hashes), bool)
        for k in (1, 2, 3):
            again[k:] |= (found.hashes[k:] == found.hashes[:-k]) & (of[k:] == of[:-k])
        counts[:, DIMS] = np.bincount(of[again], minlength=b - a)
        counts[:, DIMS + 1] = np.bincount(of[~again], minlength=b - a)
        yield a, b, counts


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each dimension occurs, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS + 2, np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, _, counts in term_counts(batch.column(0)):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(-1, DIMS + 2)), "n": pa.array(np.append(n, seen))})

    found = rows.select("text").mapInArrow(count, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 3, np.int64)
    for r in found:  # one row per dimension
        out[r.dim + 1] = r.n
    return out[1:], int(out[0])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rooted shares within each family of terms, by inverse document frequency; families have fixed parts."""
    half, parts = DIMS // 2, []
    for a, b, part, own in ((0, half, 0.4, weights), (half, DIMS, 1.0, weights), (DIMS, DIMS + 2, 0.8, np.ones_like(weights))):
        parts.append(_unit(np.sqrt(counts[:, a:b]) * own[a:b]) * np.float32(part))
    return np.concatenate(parts, axis=1)


@dataclass
class Model:
    weights: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.weights) @ self.project)

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.labels.mean() if len(self.labels) else 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts), block):
            own = counts[a : a + block]
            filled = np.flatnonzero(own.any(axis=1))
            if not len(filled):
                continue
            cosine = self.embed(own[filled]) @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** POWER
            out[a + filled] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def sample_blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(weighted terms, labels) of the sample's rows that have terms, ``BLOCK`` rows at a time."""
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            part = batch.slice(a, BLOCK)
            counts = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16).reshape(-1, DIMS + 2).astype(np.float32)
            filled = counts.any(axis=1)
            yield weighted(counts[filled], weights), part.column(1).to_numpy()[filled]


def leading_vectors(sample: DataFrame, weights: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors by subspace iteration with a fixed seed.

    The sample stays on the executors: each pass sends (terms x probes) numbers and brings as many back.
    """
    context = sample.sparkSession.sparkContext

    def passed(probe: np.ndarray) -> np.ndarray:
        sent = context.broadcast((weights, probe))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, probe = sent.value
            total = np.zeros(probe.shape, np.float32)
            for x, _ in sample_blocks(batches, weights):
                total += x.T @ (x @ probe)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        out = np.zeros(probe.shape, np.float32)
        for row in sample.mapInArrow(work, "total binary").toLocalIterator():
            out += np.frombuffer(row["total"], np.float32).reshape(probe.shape)
        sent.destroy()
        return out

    base = np.random.default_rng(7).standard_normal((DIMS + 2, rank + 16)).astype(np.float32)
    for _ in range(PASSES):
        base = np.linalg.qr(passed(base))[0]
    turn = np.linalg.eigh(base.T @ passed(base))[1][:, ::-1]
    return (base @ turn[:, :rank]).astype(np.float32)


def fit(docs: DataFrame, known: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "quality") -> Model:
    rows = docs.select(docs[text_col].cast("string").alias("text"))
    seen, total = document_frequency(rows)
    weights = (np.log((1 + total) / (1 + seen)) + 0.1).astype(np.float32)
    learn = labels.remainder(F.col("id"), FOLDS) != 0
    chosen = labels.labelled_sample(docs, known, label, learn, FIT_ROWS, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, counts in term_counts(batch.column(0)):
                small = np.minimum(counts, np.iinfo(np.uint16).max).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.tobytes() for c in small], pa.binary()), batch.column(1).slice(a, b - a)], ["counts", "label"]
                )

    path = run_folder(docs.sparkSession, "quality")
    chosen.mapInArrow(counted, "counts binary, label double").write.parquet(path)  # at most FIT_ROWS rows
    sample = docs.sparkSession.read.schema("counts binary, label double").parquet(path)

    def embedded(project: np.ndarray) -> pa.Table:
        """(vector, label) of the sample's rows that have terms."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y in sample_blocks(batches, weights):
                vectors = _unit(x @ project)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(y)], ["vector", "label"])

        return sample.mapInArrow(work, "vector binary, label double").toArrow()

    rows_known = sample.count()
    project = leading_vectors(sample, weights, min(RANK, rows_known)) if rows_known else np.zeros((DIMS + 2, 1), np.float32)
    got = embedded(project)
    vectors = np.frombuffer(b"".join(got.column(0).to_pylist()), np.float32).reshape(-1, project.shape[1])
    return Model(weights, project, vectors, got.column(1).to_numpy())


def with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """rows (payload, text) with ``score``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.scores(counts) for _, _, counts in term_counts(batch.column(1))]
            scores = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], ["payload", "text", "score"])

    payload = rows.schema["payload"].dataType.simpleString()
    return rows.mapInArrow(work, f"payload {payload}, text string, score double")


def keep_good(docs: DataFrame, known: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, unchanged."""
    model = fit(docs, known, text_col, id_col)
    scored = with_scores(carry.packed(docs, text_col), model)
    return scored.where(F.col("score") >= threshold).select(*carry.unpacked(docs, text_col))


@registry.query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document. Learned, so no SQL; held-out accuracy is tested."""
    docs = registry.table(spark, sf_dir, "documents")
    model = fit(docs, registry.table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").alias("payload"), F.col("text").cast("string").alias("text"))
    return with_scores(rows, model).select(
        F.col("payload").alias("doc_id"), (labels.remainder(F.col("payload"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
