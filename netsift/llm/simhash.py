"""SimHash near-duplicates by a Gray-order hierarchical index.

A document's fingerprint has the bits that are set in over half of the XXH64 hashes of its word shingles, repeats
included. Fingerprints that differ in at most ``distance`` bits are linked.

1. Equal fingerprints are one code, so copies cost one row each.
2. Codes are dealt into groups that agree in some bits. The free bits are cut into ``distance`` + 1 runs; codes in reach
   of each other agree in at least one run, so they meet in the group of that run. A group of more than ``GROUP``
   codes is dealt again by the bits that are still free: every group ends bounded and no pair is lost.
3. In a group, codes are sorted by their rank in the Gray code. Each ``FAN`` neighbours get an upper node with the bits they
   all share (mask and pattern), up to one root; a node keeps only the shared bits that its parent does not have. All
   codes of the group go down from the root, adding the differences at each node, and leave out a whole node
   once they exceed ``distance``. At the leaves the sum is the exact number of differing bits.
4. A group gives at most one link per code, to the smallest index it reaches there. Components are smallest labels over these
   links, every round written to the shared folder.

A text without words, empty or null, has fingerprint zero and is linked like any other. A null id has a null component
and links nothing. Rows that repeat an id keep their own fingerprints. A very long text is one row, hashed in blocks.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry
from netsift.llm.near_duplicates import Work, components, small

SHINGLE = 3
DISTANCE = 3
SEED = 42
BITS = 64
GROUP = 2_048
FAN = 16
ROWS = 1 << 16
FRONTIER = 1 << 20
BLOCK = 1 << 16

_U = np.uint64
_ALL = (1 << BITS) - 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, in blocks; of the whole sequence if it is shorter; nothing without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(last), BLOCK):
        spans = zip(starts[a : a + BLOCK], last[a : a + BLOCK], strict=False)
        yield np.array([digest(joined[s : e - 1], SEED) for s, e in spans], _U)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    count, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle):
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * count > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, code) of (doc_id, text); ``code`` is the fingerprint as a signed number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "code"])

    return docs.mapInArrow(work, "doc_id bigint, code bigint")


def runs_of(held: int, parts: int) -> list[int]:
    """``held`` with each of ``parts`` runs of the free bits added."""
    free = [b for b in range(BITS) if not held >> b & 1]
    cuts = [k * len(free) // parts for k in range(parts + 1)]
    return [held | sum(1 << b for b in free[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(s)
    return rank


class GrayIndex:
    """The hierarchies of all groups of a sorted batch; ``group`` is the number of each code's group, ascending."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, self.group = codes, group
        pattern, mask, of, last = codes, np.full(len(codes), _ALL, _U), group, np.arange(len(codes))
        self.levels = []
        while True:
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            if len(begins) == len(of):
                break
            within = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
            first = np.flatnonzero(within % FAN == 0)
            sizes = np.diff(np.append(first, len(of)))
            every, some = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(every ^ some)
            self.levels.append((pattern, mask & ~np.repeat(shared, sizes), last, first, sizes))
            pattern, mask, of, last = every & shared, shared, of[first], last[first + sizes - 1]
        self.pattern, self.mask = pattern, mask

    def near(self, ask: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of one group and at most ``distance`` differing bits, for i in ``ask``."""
        i, node = ask, self.group[ask]
        off = np.bitwise_count((self.codes[i] ^ self.pattern[node]) & self.mask[node])
        for pattern, rest, last, first, sizes in reversed(self.levels):
            keep = off <= distance
            i, node, off = i[keep], node[keep], off[keep]
            many = sizes[node]
            start = np.repeat(first[node] - (np.cumsum(many) - many), many)
            node = start + np.arange(len(start))
            i, off = np.repeat(i, many), np.repeat(off, many)
            ahead = last[node] > i
            i, node, off = i[ahead], node[ahead], off[ahead]
            off = off + np.bitwise_count((self.codes[i] ^ pattern[node]) & rest[node])
        keep = (off <= distance) & (node > i) if self.levels else np.zeros(len(i), bool)
        return i[keep], node[keep]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in ``label``, where each index names the smallest of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, further := label[label]):
            label[:] = further


def batch_links(codes: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, smaller index's code) that join what is in reach inside each group; rows of a group lie together."""
    group = np.cumsum((np.diff(group, axis=0, prepend=group[:1]) != 0).any(axis=1))
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    index, label = GrayIndex(codes, group), np.arange(len(codes))
    bound = np.cumsum(np.bincount(group)[group])  # a code meets at most its whole group
    at = 0
    while at < len(codes):
        to = max(at + 1, int(np.searchsorted(bound, (bound[at - 1] if at else 0) + FRONTIER, "right")))
        joined(label, *index.near(np.arange(at, to), distance))
        at = to
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def swept(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) inside the groups of (held, block, code)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: np.ndarray) -> pa.RecordBatch:
            a, b = batch_links(table[:, 2].copy().view(_U), table[:, :2], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        waiting = np.zeros((0, 3), np.int64)
        for batch in batches:
            waiting = np.concatenate([waiting, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)])
            if len(waiting) >= ROWS:
                end = np.flatnonzero((waiting[1:, :2] != waiting[:-1, :2]).any(axis=1))
                cut = int(end[-1]) + 1 if len(end) else 0
                if cut:
                    yield links(waiting[:cut])
                    waiting = waiting[cut:]
        if len(waiting):
            yield links(waiting)

    ordered = rows.select("held", "block", "code").repartition("held", "block").sortWithinPartitions("held", "block")
    return ordered.mapInArrow(work, "a bigint, b bigint")


def near_codes(codes: DataFrame, work: Work, distance: int) -> DataFrame:
    """Links (a, b) that connect every two values of ``code`` (distinct, signed) in reach of each other."""
    parts = distance + 1
    masks = F.array(*(F.lit(signed(m)) for m in runs_of(0, parts)))
    rows = codes.select(F.explode(masks).alias("held"), "code").withColumn("block", F.col("code").bitwiseAND(F.col("held")))
    links = None
    while True:
        rows = work.kept(rows)
        free = F.lit(BITS) - F.bit_count("held")
        wide = rows.groupBy("held", "block").agg(F.count(F.lit(1)).alias("m")).where((F.col("m") > GROUP) & (F.pow(F.lit(2.0), free) > GROUP))
        wide = work.kept(wide.select("held", "block"))
        split = [r.held for r in wide.select("held").distinct().collect()]  # masks, not codes: parts ** rounds at most
        narrow = rows.join(small(wide), ["held", "block"], "left_anti") if split else rows
        found = work.kept(swept(narrow, distance))
        links = found if links is None else links.union(found)
        if not split:
            return links.distinct()
        again = [(h, [signed(m) for m in runs_of(h & _ALL, parts)]) for h in split]
        again = rows.sparkSession.createDataFrame(again, "held bigint, finer array<bigint>")
        rows = rows.join(small(wide), ["held", "block"], "left_semi").join(F.broadcast(again), "held")
        rows = rows.select(F.explode("finer").alias("held"), "code").withColumn("block", F.col("code").bitwiseAND(F.col("held"))).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id in reach)."""
    work = Work(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = work.kept(fingerprints(texts, shingle))
    codes = work.kept(rows.where("doc_id is not null").groupBy("code").agg(F.min("doc_id").alias("least")))
    labels = components(near_codes(codes.select("code"), work, distance), work)
    named = codes.join(labels, codes["code"] == labels["node"], "left").select("code", "least", F.coalesce("label", "code").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = work.kept(named.join(smallest, "label").select("code", "component_id"))
    return rows.join(small(found), "code", "left").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("code"), BITS // 4, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


@registry.query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, at most three differing bits."""
    return near_duplicates(registry.table(spark, sf_dir, "documents"))
