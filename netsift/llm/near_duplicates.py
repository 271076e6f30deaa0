"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of ``shingle`` words (with fewer words, the whole sequence as one). Its sketch
has ``REGISTERS`` registers: 16 independent hashes of every shingle, each dealt into 16 buckets, of which the least
value is stored as its count of leading zeros (6 bits) and the bits behind the leading one (10 bits).
An empty bucket takes the next filled one of its hash.

1. Equal sets are one class (by a 128-bit digest), so copies cost one row each and nothing more.
   Registers of very small sets repeat, so links of sets of up to ``EXACT`` shingles (fewer below 60 %) are found exactly:
   two sets are linked if they share a subset of the size that the threshold asks of their sizes, and all sets that hold a
   subset are joined by a star. Such sets enter no band.
2. Classes that agree in all registers of a band share a bucket. The smallest class of a bucket is paired with the
   others; pairs are estimated by equal registers, corrected for the chance that different minima have equal registers.
   What stays ``SLACK`` standard deviations below the threshold is no candidate.
3. Each class is first verified against its best candidate. Verified links give components. Candidates inside one
   component are implied, those between two are verified.
4. Buckets that still hold more than one component are swept, sorted by set size, for pairs of different components with
   fitting sizes and estimate. The sweep gives no pairs but the classes concerned, and which components are in reach of
   each other (a spanning forest). A bucket of more than ``BUCKET`` classes is dealt into cells by set size and hash, and
   cells are swept two by two, so all its pairs still meet.
5. Components in reach of each other are a family. The classes concerned of a family are compared all with all, by
   products of their incidence matrices, in groups of two chunks of about ``CHUNK``; a group gives at most the links that
   join its components. So copies cost rows in proportion to their number, and no link between different texts is dropped.

Verification counts the full sets of both texts. Components are smallest labels, spread over links with pointer jumping;
every round is written to the shared folder. Only counts reach the driver; lists are broadcast below
``SMALL`` rows of two numbers, else joined by shuffle, where Spark splits hot keys.

Documents without words or id are linked with nothing; a null id has a null component and is kept. Rows that repeat an id
are told apart by their sets. Repeated rows are copies of each other. An empty table gives no rows. Classes are named by
64 bits of their digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry, words
from netsift.session import run_folder

SHINGLE = 5
PERCENT = 80
GROUPS, BUCKETS = 16, 16
REGISTERS = GROUPS * BUCKETS
MANTISSA = 10
BANDS, BAND_ROWS = 32, 5
FEW, FEW_BANDS = 40, REGISTERS // BAND_ROWS  # sets of up to FEW shingles use all registers
EXACT, SUBSETS = 10, 10_000
SLACK = 4.5
BUCKET = 4_096
CHUNK = 256
COLUMNS = 4_096
SMALL = 200_000

_U = np.uint64
_SALTS = words.mix(np.arange(1, GROUPS + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of sets of 64-bit hashes; empty sets are zero.

    Neighbouring registers belong to different hashes, so a band reads five independent ones.
    """
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BUCKETS, GROUPS), np.uint16)
    if not sizes.sum():
        return out.reshape(len(sets), -1)
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes) * BUCKETS
    none = np.iinfo(_U).max
    for g in range(GROUPS):
        with np.errstate(over="ignore"):
            v = words.mix(h * _SALTS[g])
        least = np.full(len(sets) * BUCKETS, none, _U)
        np.minimum.at(least, row + (v & _U(BUCKETS - 1)).astype(np.int64), v >> _U(4))
        least = least.reshape(-1, BUCKETS)
        for _ in range(BUCKETS - 1):
            empty = least == none
            if not empty[sizes > 0].any():
                break
            least = np.where(empty, np.roll(least, -1, axis=1), least)
        part, exponent = np.frexp(least.astype(np.float64))
        zeros = np.clip(60 - exponent, 0, 63).astype(np.uint16)
        out[:, :, g] = (zeros << np.uint16(MANTISSA)) | ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.uint16)
    out[sizes == 0] = 0
    return out.reshape(len(sets), -1)


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of a and b shingles are equal: both minima have equal zeros and equal bits."""
    level = 2.0 ** -np.arange(0, 40)[:, None]
    share = lambda n: np.exp(-n / BUCKETS * level / 2) - np.exp(-n / BUCKETS * level)
    return (share(np.maximum(a, 1)) * share(np.maximum(b, 1))).sum(axis=0) / (1 << MANTISSA)


def estimated(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance."""
    chance = collision_rate(a, b)
    return (equal / REGISTERS - chance) / (1 - chance)


def passes(equal: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and estimate allow the threshold; small sets have a wider margin."""
    small, large, level = np.minimum(a, b), np.maximum(a, b), percent / 100
    sd = np.sqrt(level * (1 - level)) * np.sqrt(1 / REGISTERS + 1 / np.maximum(small, 1))
    return (100 * small >= percent * large) & (estimated(equal, a, b) >= level - SLACK * sd)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    with np.errstate(over="ignore"):
        for k, s in enumerate(sets):
            if len(s):
                one[k] = words.mix(np.array([s.sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0]
                two[k] = np.bitwise_xor.reduce(words.mix(s ^ _U(0x5851F42D4C957F2D))).view(np.int64)
    return one, two


def needed(a: int, b: int, percent: int) -> int:
    """Common shingles that link sets of a and b shingles."""
    return -(-percent * (a + b) // (100 + percent))


def exact_size(percent: int) -> int:
    """Sets of up to so many shingles are joined exactly: EXACT, or less where a low threshold makes over SUBSETS subsets."""
    wide = lambda n: math.comb(100 * n // percent, needed(n, 100 * n // percent, percent))
    return max((n for n in range(1, EXACT + 1) if wide(n) <= SUBSETS), default=0)


def partners(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, common shingles) of the links that a set of n shingles can have with or as an exactly joined set."""
    top = exact_size(percent)
    pairs = ((min(n, m), max(n, m)) for m in range(1, 100 * top // percent + 1))
    return [(a, b, needed(a, b, percent)) for a, b in pairs if a <= top and a >= needed(a, b, percent)]


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, node, check, registers, few) of (doc_id, text); ``few`` holds the shingles of sets that can link with a set of up to EXACT."""
    widest = 100 * exact_size(percent) // percent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in words.column_words(batch.column(1)):
                sets = words.shingle_sets(w, shingle)
                one, two = digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two),
                        pa.array([r.tobytes() for r in sketch(sets)], pa.binary()),
                        pa.array([s.tobytes() if 0 < len(s) <= widest else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n", "node", "check", "registers", "few"],
                )

    return docs.mapInArrow(work, "doc_id bigint, n bigint, node bigint, check bigint, registers binary, few binary")


def small_links(classes: DataFrame, work: Work, percent: int) -> DataFrame:
    """Links (a, b) of classes of which one has at most EXACT shingles, enough to join all that are linked.

    Each set gives all its subsets of the size that a link with a partner of given size takes. Whatever holds a subset is
    linked with whatever holds it on the other side, so the smallest node of a side stands for the side.
    """

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, few in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words.mix(np.frombuffer(few, _U) ^ _U(0x5851F42D4C957F2D)), words.mix(np.frombuffer(few, _U) + _U(1))
                for a, b, size in partners(len(own[0]), percent):
                    picks = np.array(list(combinations(range(len(own[0])), size)))
                    with np.errstate(over="ignore"):
                        key, check = (h[picks].sum(axis=1, dtype=_U).view(np.int64) for h in own)
                    side = [pa.array(np.full(len(picks), x, np.int32)) for x in (a * (EXACT * 100) + b, len(own[0]) == b)]
                    yield pa.RecordBatch.from_arrays(
                        [*side, pa.array(key), pa.array(check), pa.array(np.full(len(picks), node, np.int64))],
                        ["sizes", "larger", "key", "check", "node"],
                    )

    rows = classes.where("few is not null").select("node", "few")
    held = work.kept(rows.mapInArrow(subsets, "sizes int, larger int, key bigint, check bigint, node bigint"))
    group = ["sizes", "key", "check"]
    ends = held.groupBy(*group).agg(
        F.min(F.when(F.col("larger") == 0, F.col("node"))).alias("low"), F.min(F.when(F.col("larger") == 1, F.col("node"))).alias("high"),
        F.count(F.lit(1)).alias("m"),
    )
    # of two sets of one size both are on the larger side
    ends = ends.where("m > 1 and high is not null").withColumn("same", F.col("sizes") % (EXACT * 100 + 1) == 0).where("same or low is not null")
    met = held.join(ends, group).select("node", F.when(F.col("same") | (F.col("larger") == 0), F.col("high")).otherwise(F.col("low")).alias("a"))
    return work.kept(met.where("a <> node").select(F.col("a"), F.col("node").alias("b")).distinct())


def banded(classes: DataFrame, percent: int) -> DataFrame:
    """(key, node) for every band of every class that is not joined exactly."""
    count = F.when(F.col("n") <= FEW, FEW_BANDS).otherwise(BANDS)
    bands = F.explode(F.sequence(F.lit(0), count - 1)).alias("band")
    width = BAND_ROWS * 2
    part = F.expr(f"substring(registers, band * {width} + 1, {width})")
    return classes.where(F.col("n") > exact_size(percent)).select("node", "registers", bands).select(F.xxhash64("band", part).alias("key"), "node")


class Work:
    """Tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, run_folder(spark, "neardup"), 0

    def kept(self, frame: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame) -> DataFrame:
    """A list of one or two numbers per row with a broadcast hint, if it is at most SMALL rows."""
    return F.broadcast(frame) if frame.limit(SMALL + 1).count() <= SMALL else frame


def with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) with sizes and registers of both."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, likeness) of the pairs whose sizes and estimate allow a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            equal, (a, b) = (one == two).sum(axis=1), (batch.column(k).to_numpy() for k in (2, 3))
            good = passes(equal, a, b, percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(estimated(equal, a, b))], ["a", "b", "likeness"]
            ).filter(pa.array(good))

    both = with_classes(pairs, classes).select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return both.mapInArrow(work, "a bigint, b bigint, likeness double")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, work: Work, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    pairs = work.kept(pairs.select("a", "b"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = class_texts(nodes, classes, docs, work, shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a = batch.column(0).to_pylist()
            good = []
            for first, end, w in words.column_words(batch.column(3)):
                for k, own in zip(range(first, end), words.shingle_sets(w, shingle), strict=True):
                    if a[k] != last or held is None:
                        text = batch.column(2).slice(k, 1)
                        held = words.shingle_sets(words.find_words(*words.text_bytes(text)), shingle)[0]
                        last = a[k]
                    both = len(np.intersect1d(held, own, assume_unique=True))
                    good.append(100 * both >= percent * (len(held) + len(own) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t_{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
    return work.kept(joined.mapInArrow(compare, "a bigint, b bigint"))


def class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, work: Work, shingle: int) -> DataFrame:
    """(node, text): one text of each class."""
    wanted = work.kept(nodes.distinct().join(classes.select("node", "rep"), "node"))

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that repeat an id may hold another text than the class."""
        for batch in batches:
            for a, b, w in words.column_words(batch.column(1)):
                one, _ = digests(words.shingle_sets(w, shingle))
                part = batch.slice(a, b - a)
                good = pa.array(one == part.column(0).to_numpy())
                yield part.filter(good)

    found = docs.join(small(wanted.withColumnRenamed("rep", "doc_id")), "doc_id").select("node", "text")
    return work.kept(found.mapInArrow(same_set, "node bigint, text string").dropDuplicates(["node"]))


def components(links: DataFrame, work: Work) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches."""
    both = work.kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work.kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        spread = work.kept(spread)
        ends = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = work.kept(spread.join(ends, "next").select("node", F.col("label").alias("was"), F.least("next", "far").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("was <> label").isEmpty():
            return labels


def swept(bands: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(key, node, label, part) of the groups to sweep: buckets of several components, wide ones in parts."""
    named = bands.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    counted = lambda frame: frame.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low <> high").select("key", "m")
    rows = named.join(counted(named), "key")
    narrow = rows.where(F.col("m") <= BUCKET).select("key", "node", "label", F.lit(-1).alias("part"))
    return narrow.union(dealt(rows.where(F.col("m") > BUCKET).select("key", "node", "label"), classes, percent))


def dealt(wide: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, node, label, part) of the rows of wide buckets, in groups of two cells; every two rows that need a comparison meet.

    A cell holds about half of BUCKET, of one range of set sizes; rows of fitting size are in one range or two neighbouring
    ones. A component that fills a cell has cells of its own, and two cells of one component are no group. Part 0 is
    compared with part 1; a cell that is grouped with itself has part -1.
    """
    step = math.log(100 / percent) + 1e-6
    rows = wide.join(classes.select("node", F.floor(F.log("n") / step).alias("range")), "node")
    rows = rows.join(rows.groupBy("key", "range", "label").agg(F.count(F.lit(1)).alias("alike")), ["key", "range", "label"])
    rows = rows.withColumn("own", F.when(F.col("alike") > BUCKET // 2, F.col("label"))).withColumn("alone", F.col("own").isNotNull())
    rows = rows.withColumn("own", F.coalesce("own", F.lit(0)))
    split = rows.groupBy("key", "range", "alone", "own").agg(F.ceil(F.count(F.lit(1)) * 2 / BUCKET).alias("cells"))
    rows = rows.join(split, ["key", "range", "alone", "own"])
    cell = F.struct("alone", "own", F.pmod(F.xxhash64("node"), F.col("cells")).alias("k")).alias("cell")
    rows = rows.select("key", "range", cell, "node", "label")
    cells = rows.groupBy("key", "range", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one = cells.select("key", *(F.col(c).alias(f"{c}_1") for c in ("range", "cell", "low", "high")))
    one = one.withColumn("range", F.explode(F.array(F.col("range_1"), F.col("range_1") + 1)))
    met = one.join(cells, ["key", "range"]).where("range <> range_1 or cell_1 <= cell")
    met = met.where("least(low, low_1) <> greatest(high, high_1)")
    same = (F.col("range") == F.col("range_1")) & (F.col("cell") == F.col("cell_1"))
    side = lambda r, c, part: F.struct(F.col(r).alias("range"), F.col(c).alias("cell"), F.lit(part).alias("part"))
    sides = F.when(same, F.array(side("range", "cell", -1))).otherwise(F.array(side("range_1", "cell_1", 0), side("range", "cell", 1)))
    met = met.select("key", F.xxhash64("key", "range_1", "cell_1", "range", "cell").alias("group"), F.explode(sides).alias("s"))
    met = met.select("key", "group", "s.range", "s.cell", "s.part")
    return rows.join(met, ["key", "range", "cell"]).select(F.col("group").alias("key"), "node", "label", "part")


def in_reach(bands: DataFrame, classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """From buckets of several components: (0, node, its label) of classes with a candidate in another component, and
    (1, label, label) of components in reach of each other."""
    rows = swept(bands, classes, labels, percent)
    rows = rows.join(classes.select("node", "n", "registers"), "node").select("key", "n", "node", "label", "part", "registers")
    ordered = rows.repartition("key").sortWithinPartitions("key", "n", "node")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the rows of one bucket whose sizes can still fit; ``reach`` names what is connected so far."""
        now = None
        sizes, nodes, held, reach, parts, regs = (np.zeros(0, np.int64) for _ in range(6))
        for batch in batches:
            if not len(batch):
                continue
            key, n, node, label, part = (batch.column(k).to_numpy() for k in range(5))
            own = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            out: set[tuple[int, int, int]] = set()
            borders = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, z in zip(borders[:-1], borders[1:], strict=True):
                if key[a] != now:
                    now, sizes, nodes, held, reach, parts, regs = key[a], n[:0], node[:0], label[:0], label[:0], part[:0], own[:0]
                fits = sizes * 100 >= percent * n[a]
                known = dict(zip(held.tolist(), reach.tolist(), strict=True))
                sizes, nodes, held = np.append(sizes[fits], n[a:z]), np.append(nodes[fits], node[a:z]), np.append(held[fits], label[a:z])
                reach = np.append(reach[fits], [known.get(x, x) for x in label[a:z].tolist()]).astype(np.int64)
                parts, regs = np.append(parts[fits], part[a:z]), np.concatenate([regs[fits], own[a:z]])
                marked = np.zeros(len(sizes), bool)
                for k in range(len(sizes) - (z - a), len(sizes)):
                    at = np.flatnonzero((held[:k] != held[k]) & ((parts[:k] != parts[k]) | (parts[k] < 0)))
                    if len(at):
                        equal = (regs[at] == regs[k]).sum(axis=1)
                        at = at[passes(equal, sizes[at], np.full(len(at), sizes[k]), percent)]
                    if len(at):
                        marked[at] = marked[k] = True
                        for other in np.unique(reach[at][reach[at] != reach[k]]).tolist():
                            first = at[reach[at] == other][0]
                            out.add((1, int(held[first]), int(held[k])))
                            reach[reach == other] = reach[k]
                out.update((0, x, y) for x, y in zip(nodes[marked].tolist(), held[marked].tolist(), strict=True))
            found = np.array(sorted(out), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(3)], ["kind", "a", "b"])

    return ordered.mapInArrow(sweep, "kind bigint, a bigint, b bigint").distinct()


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    keys = np.concatenate([*one, *two])
    values, back, often = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1  # what is in one set only is in no intersection
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    shared = often[back] > 1
    row, column = row[shared], number[back[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        out += part[: len(one)] @ part[len(one) :].T
    return out.astype(np.int64)


def family_links(reach: DataFrame, classes: DataFrame, docs: DataFrame, work: Work, shingle: int, percent: int) -> DataFrame:
    """Verified links (a, b) between different components in reach of each other, enough to join all that are linked."""
    families = components(reach.where("kind = 1").select("a", "b"), work)
    members = reach.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("own"))
    members = members.join(families, members["own"] == families["node"]).select(members["node"], "own", F.col("label").alias("family"))
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = work.kept(members.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    texts = class_texts(members.select("node"), classes, docs, work, shingle)
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    rows = dealt.join(texts, "node").select("family", "i", "j", "chunk", "node", "own", "text")

    def compare(table: pa.Table) -> pa.Table:
        sets = [s for _, _, w in words.column_words(table.column("text")) for s in words.shingle_sets(w, shingle)]
        chunk, node, reach_ = (table.column(c).to_numpy() for c in ("chunk", "node", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        found = []
        if len(one) and len(two):
            both = common_counts([sets[k] for k in one], [sets[k] for k in two])
            n = np.array([len(s) for s in sets])
            linked = 100 * both >= percent * (n[one][:, None] + n[two] - both)
            linked &= reach_[one][:, None] != reach_[two]
            reach_ = reach_.copy()
            for x, y in zip(*np.nonzero(linked), strict=True):
                a, b = one[x], two[y]
                if reach_[a] != reach_[b]:
                    found.append((int(node[a]), int(node[b])))
                    reach_[reach_ == reach_[a]] = reach_[b]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return work.kept(rows.groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept`` (its own component's smallest id)."""
    work = Work(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = work.kept(sketches(texts, shingle, percent))
    classes = work.kept(
        rows.where("n > 0 and doc_id is not null").groupBy("node", "check", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("few").alias("few"))
    )
    exact = small_links(classes, work, percent)
    bands = banded(classes, percent)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("a")).where("m > 1").select("key", "a")
    bands = work.kept(bands.join(shared, "key").select("key", "a", "node"))
    stars = bands.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    pairs = work.kept(candidates(stars, classes, percent))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("likeness", -F.col("a"))).alias("a"))
    links = exact.union(verified(best, classes, texts, work, shingle, percent))
    labels = components(links, work)

    name = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}"))
    apart = pairs.join(best.withColumnRenamed("a", "first"), "b").where("a <> first").join(name("a"), "a", "left").join(name("b"), "b", "left")
    apart = apart.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")
    links = links.union(verified(apart, classes, texts, work, shingle, percent))
    labels = components(links, work)

    reach = work.kept(in_reach(bands.select("key", "node"), classes, labels, percent))
    links = links.union(family_links(reach, classes, texts, work, shingle, percent))
    labels = components(links, work)

    named = classes.select("node", "check", "n", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = work.kept(named.join(least, "label").select("node", "check", "n", "component_id"))
    joined = rows.select("doc_id", "n", "node", "check").join(found, ["node", "check", "n"], "left")
    return joined.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """The documents with one of each group left: its smallest id. Rows that repeat an id leave one; rows without id stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, percent)
    ids = Work(docs.sparkSession).kept(
        found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    )
    gone, again = (small(ids.where(test).select("id")) for test in ("not kept", "kept and n > 1"))
    key = docs[id_col].cast("bigint")
    left = docs.join(gone, key == gone["id"], "left_anti")
    key = left[id_col].cast("bigint")
    once = left.join(again, key == again["id"], "left_anti")
    return once.unionByName(left.join(again, key == again["id"], "left_semi").dropDuplicates([id_col]))


SQL = r"""
with w as (select doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
    'abcdefghijklmnopqrstuvwxyz     '), ' '), ' +') w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) p from w) where w <> ['']),
n as (select doc_id, count(*) n from s group by 1),
e as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from e join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
r as (with recursive r(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from r join l on l.x = r.y) select x, min(y) y from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, r.y component_id, r.y = d.doc_id kept
from documents d left join n on n.doc_id = d.doc_id join r on r.x = d.doc_id
"""


@registry.query("op4_near_duplicates", SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85."""
    return near_duplicates(registry.table(spark, sf_dir, "documents"), shingle=3, percent=85)
