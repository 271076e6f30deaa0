"""Packing: bounded-space online best-fit of documents into windows of ``SIZE`` tokens.

A task keeps at most ``OPEN`` open windows. A document's token ids, with the end id behind them, are cut into full windows
as long as they fill one; the rest goes to the open window that it fits best. If none fits and all are in use, the
fullest is emitted: first filled by cutting the document, unless that would cut off fewer than ``LEAST_CUT`` tokens; then
it keeps that padding. At its end a task passes its open windows on, with their ids. Tasks are merged ``FAN_IN`` at a
time by the same packer, in as many rounds as it takes, so no task ever gets more than FAN_IN x OPEN windows. The
last task joins its leftovers without gaps; what remains below a full window is cut into lengths that are powers of two,
which need no padding.

Ids come from the tokenizer file itself. Its pre-tokenizer never joins text across ASCII white space, so each distinct
stretch between white space is encoded once per Python worker and remembered by a 64-bit hash (A-Z lower-cased,
as the tokenizer does), up to ``REMEMBER`` of them; texts with ``<|`` could hold special tokens and are encoded whole.

Null and empty texts are the end id alone. Repeated rows are packed each; a null id stays null. An empty table gives no
rows. Where pieces lie depends on the order within the input's partitions, never which ids they hold. Other columns
are not read. Pieces are stored in the shared folder before the merge rounds, so lost executors repeat single tasks only.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry, words
from netsift.session import run_folder

SIZE = 2048
OPEN = 16
LEAST_CUT = 32
FAN_IN = 64
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
REMEMBER = 1_000_000
JOINED = 200

PIECE_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class WordIds:
    """Token ids of stretches between white space, by hash; one per Python worker and tokenizer file."""

    _made: dict[str, WordIds] = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.clear()

    @classmethod
    def of(cls, file: str) -> WordIds:
        if file not in cls._made:
            cls._made[file] = cls(file)
        return cls._made[file]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.full(1 << 16, END_ID, np.uint32), 1  # place 0 holds the end id

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, hashes: np.ndarray, stretches: list[str]) -> None:
        """Encodes new stretches, some at a time with blanks between; offsets tell which ids belong to which."""
        counts, ids = np.zeros(len(stretches), np.int32), []
        for k in range(0, len(stretches), JOINED):
            group = stretches[k : k + JOINED]
            found = self.tokenizer.encode(" ".join(group), add_special_tokens=False)  # one at a time: its record is large
            if found.ids:
                begins = np.cumsum([0, *[len(x) + 1 for x in group]])
                at = np.searchsorted(begins, np.array(found.offsets)[:, 0], "right") - 1
                counts[k : k + len(group)] = np.bincount(at, minlength=len(group))
                ids.append(np.array(found.ids, np.uint32))
        new = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], new, np.zeros(self.used + len(new), np.uint32)])
        else:
            self.flat[self.used : self.used + len(new)] = new
        first = self.used + np.cumsum(counts) - counts
        self.used += len(new)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, counts)

    def ids(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id behind, and n + 1 offsets."""
        if len(self.keys) > REMEMBER:
            self.clear()
        hashes, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            self.learn(hashes[new], [w.word(k).decode("utf-8", "replace") for k in one[new].tolist()])
            at = np.searchsorted(self.keys, hashes)
        first = np.insert(self.first[at][back], w.rows[1:], 0)
        count = np.insert(self.count[at][back], w.rows[1:], 1).astype(np.int64)
        to = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(first - to[:-1], count) + np.arange(to[-1])]
        return ids, to[w.rows + np.arange(len(w.rows))]


def document_ids(column: pa.Array, file: str) -> Iterator[np.ndarray]:
    """The ids of each text of a column, the end id last."""
    known = WordIds.of(file)
    for _, _, w, raw, own in _pieces(column):
        ids, rows = known.ids(w)
        marked = _marked(raw, own)
        for k in range(len(rows) - 1):
            if k in marked:
                text = raw[own[k] : own[k + 1]].tobytes().decode("utf-8", "replace")
                yield np.append(known.whole(text), np.uint32(END_ID))
            else:
                yield ids[rows[k] : rows[k + 1]]


def _pieces(column: pa.Array) -> Iterator[tuple]:
    data, offsets = words.text_bytes(column)
    for a, b in words.pieces(offsets):
        raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, words.find_words(raw, own), raw, own


def _marked(raw: np.ndarray, own: np.ndarray) -> set[int]:
    """Rows with ``<|`` in their text."""
    at = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
    return set((np.searchsorted(own, at, "right") - 1).tolist())


class Packer:
    """Open windows of one task. A piece is (owner, start, ids, doc_tokens); rows come out as closed pieces."""

    def __init__(self, sequences: int, size: int = SIZE, most_open: int = OPEN, least_cut: int = LEAST_CUT):
        self.size, self.most_open, self.least_cut = size, most_open, least_cut
        self.windows: list[tuple[int, int]] = []  # (free, number), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.made, self.next_sequence = 0, sequences
        self.closed: list[tuple] = []

    def add(self, owner, ids: np.ndarray, start: int, doc_tokens: int) -> None:
        at, n = 0, len(ids)
        while at < n:
            left = n - at
            if left >= self.size:
                self._close([(owner, start + at, ids[at : at + self.size], doc_tokens)])
                at += self.size
                continue
            fit = bisect_left(self.windows, (left, -1))
            if fit < len(self.windows):
                at += self._put(fit, owner, ids[at:], start + at, doc_tokens)
            elif len(self.windows) < self.most_open:
                self.made += 1
                self.pieces[self.made] = []
                insort(self.windows, (self.size, self.made))
                at += self._put(len(self.windows) - 1, owner, ids[at:], start + at, doc_tokens)
            elif self.windows[0][0] >= self.least_cut:
                at += self._put(0, owner, ids[at : at + self.windows[0][0]], start + at, doc_tokens)
            else:
                self._close(self.pieces.pop(self.windows.pop(0)[1]))

    def _put(self, place: int, owner, ids: np.ndarray, start: int, doc_tokens: int) -> int:
        free, number = self.windows.pop(place)
        self.pieces[number].append((owner, start, ids, doc_tokens))
        if free == len(ids):
            self._close(self.pieces.pop(number))
        else:
            insort(self.windows, (free - len(ids), number))
        return len(ids)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for owner, start, ids, doc_tokens in pieces:
            self.closed.append((owner, start, ids, doc_tokens, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def leftovers(self) -> list[tuple]:
        return [piece for _, number in self.windows for piece in self.pieces[number]]

    def finish(self) -> None:
        """Joins the leftovers without gaps; the last window is cut into powers of two."""
        rest, self.windows, self.pieces = self.leftovers(), [], {}
        total = sum(len(p[2]) for p in rest)
        sizes = [self.size] * (total // self.size)
        sizes += [1 << k for k in range(self.size.bit_length(), -1, -1) if total % self.size >> k & 1]
        rest.reverse()
        for size in sizes:
            held = []
            while size:
                owner, start, ids, doc_tokens = rest.pop()
                held.append((owner, start, ids[:size], doc_tokens))
                if len(ids) > size:
                    rest.append((owner, start + size, ids[size:], doc_tokens))
                size -= len(held[-1][2])
            self._close(held)


def _rows(task: int, closed: list[tuple], left: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Closed pieces (with their CRC, without ids) and leftovers (with ids)."""
    ids = [np.ascontiguousarray(p[2], dtype="<u4") for p in (*closed, *left)]
    both = [*closed, *[(*p, None, None) for p in left]]
    return pa.RecordBatch.from_pydict({
        "task": pa.array([task] * len(both), pa.int32()),
        "doc_id": pa.array([p[0] for p in both], kind),
        "start": pa.array([p[1] for p in both], pa.int64()),
        "length": pa.array([len(p[2]) for p in both], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
        "doc_tokens": pa.array([p[3] for p in both], pa.int64()),
        "sequence_id": pa.array([p[4] for p in both], pa.int64()),
        "offset": pa.array([p[5] for p in both], pa.int64()),
        "ids": pa.array([None] * len(closed) + [x.tobytes() for x in ids[len(closed) :]], pa.binary()),
    })


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file: str = TOKENIZER, size: int = SIZE,
    most_open: int = OPEN, least_cut: int = LEAST_CUT, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``size`` is a power of two."""
    spark = docs.sparkSession
    rows = docs.select(
        docs[text_col].cast("string").alias("text"), docs[id_col].alias("doc_id"), F.spark_partition_id().alias("task")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = (
        f"task int, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
        " sequence_id bigint, offset bigint, ids binary"
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task, owner_kind = None, 0, None
        for batch in batches:
            if packer is None and len(batch):
                task, owner_kind = batch.column(2)[0].as_py(), batch.column(1).type
                packer = Packer(task << 32, size, most_open, least_cut)
            owners = batch.column(1).to_pylist()
            for k, ids in enumerate(document_ids(batch.column(0), file)):
                packer.add(owners[k], ids.copy() if len(ids) < size else ids, 0, len(ids))
                if len(packer.closed) >= 2000:
                    yield _rows(task, packer.closed, [], owner_kind)
                    packer.closed = []
        if packer is not None:
            yield _rows(task, packer.closed, packer.leftovers(), owner_kind)

    def merge(level: int, last: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, task, owner_kind = None, 0, None
            for batch in batches:
                if not len(batch):
                    continue
                if packer is None:
                    task, owner_kind = batch.column(0)[0].as_py(), batch.column(1).type
                    packer = Packer((level << 56) + (task << 32), size, most_open, least_cut)
                columns = [batch.column(k).to_pylist() for k in (1, 2, 5, 8)]
                for owner, start, doc_tokens, ids in zip(*columns, strict=True):
                    packer.add(owner, np.frombuffer(ids, "<u4"), start, doc_tokens)
            if packer is not None:
                if last:
                    packer.finish()
                yield _rows(task, packer.closed, packer.leftovers(), owner_kind)

        return work

    folder = run_folder(spark, "packing")
    rows.mapInArrow(first, shape).write.parquet(f"{folder}/0")
    level, done = 0, []
    tasks = None
    while True:
        table = spark.read.schema(shape).parquet(f"{folder}/{level}")
        done.append(table.where("sequence_id is not null").select("doc_id", *PIECE_COLUMNS))
        if tasks == 1:
            break
        open_pieces = table.where("sequence_id is null")
        if tasks is None:
            most = open_pieces.agg(F.max("task")).first()[0]
            tasks = 1 if most is None else most + 1
        level, tasks = level + 1, -(-tasks // fan_in)
        dealt = open_pieces.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).repartitionById(tasks, F.col("task"))
        ordered = dealt.sortWithinPartitions("task", F.desc("length"), "doc_id", "start")
        ordered.mapInArrow(merge(level, tasks == 1), shape).write.parquet(f"{folder}/{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").alias(id_col), *PIECE_COLUMNS)


@registry.query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed. A tokenizer is not SQL; the pieces are put together again in a test."""
    return pack(registry.table(spark, sf_dir, "documents"))
