r"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Words are runs of letters, digits and non-ASCII after A-Z lower-casing. A window is ``size`` consecutive words of
an item; an item of fewer words, but not none, is one window. A window's set is its shingles of ``shingle`` words
(of all its words, if fewer). All of them must occur, so by the prefix rule one shingle per window is enough to
find its candidates: the rarest, by occurrences in all documents. A document position holding a window's prefix
shingle fixes where the window would begin; it must begin and end inside the document (positional and length
bounds), and then every word of the item-sized stretch is compared, by 64-bit word hashes.

Items are cut into pieces of at most ``PIECE_WORDS`` words (overlapping by a window less one word), and pieces are
dealt into blocks of about ``BLOCK_BYTES`` of text. A block's tables are all that is sent to the executors for one
pass, so that is bounded by a parameter; a larger benchmark takes more passes inside the same stage. Documents
are never shuffled: a hot passage or source costs its own rows only.

Null texts and texts without words have no hit. Items without text or words take no part; those without an id are hit like
others, but not counted or named. Repeated items count once, repeated documents are treated alike each time. No item: nothing is hit. Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import carry, registry, words

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 20_000
EXPAND = 4_000_000

_HITS = pa.list_(pa.int64())
_ITEMS = pa.list_(pa.string())


@dataclass
class Block:
    """Distinct windows of some item pieces: word hashes, lengths, the items of each, and its shingles."""

    window_words: np.ndarray
    lengths: np.ndarray
    item_rows: np.ndarray
    items: list[str]
    shingle_of: np.ndarray
    shingle_at: np.ndarray
    shingle_hash: np.ndarray
    shingle_len: np.ndarray

    def sizes(self) -> list[int]:
        return np.unique(self.shingle_len).tolist()


def build_block(ids: list[str | None], texts: list[str], size: int, shingle: int) -> Block:
    found: dict[bytes, set[str]] = {}
    for first, _, w in words.column_words(pa.array(texts, pa.large_string()), words.ALNUM):
        for k in range(len(w.rows) - 1):
            own = w.hashes[w.rows[k] : w.rows[k + 1]]
            for at in range(max(len(own) - size + 1, min(len(own), 1))):
                found.setdefault(own[at : at + size].tobytes(), set()).update([ids[first + k]] if ids[first + k] is not None else [])
    keys = sorted(found)
    lengths = np.array([len(k) // 8 for k in keys], np.int64)
    table = np.zeros((len(keys), size), np.uint64)
    for k, key in enumerate(keys):
        table[k, : lengths[k]] = np.frombuffer(key, np.uint64)
    held = [sorted(found[k]) for k in keys]
    of, at, hashes, lens = [], [], [], []
    for k in range(len(keys)):
        n = int(lengths[k])
        q = min(shingle, n)
        own = words.Words(np.zeros(0, np.uint8), *[np.zeros(n, np.int64)] * 2, table[k, :n], np.array([0, n]))
        h, _ = words.windows(own, q)
        of.append(np.full(len(h), k)), at.append(np.arange(len(h))), hashes.append(h), lens.append(np.full(len(h), q))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return Block(
        table, lengths, np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64),
        [x for own in held for x in own], join(of, np.int64), join(at, np.int64), join(hashes, np.uint64), join(lens, np.int64),
    )


class Lookup:
    """Positions of a sorted table of 64-bit keys in arrays of hashes; most misses end at a bitmap of 2^18 bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(keys >> np.uint64(46)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, positions in ``keys``) of all that are there."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(46)).astype(np.int64)])
        where = np.searchsorted(self.keys, hashes[at])
        good = self.keys[np.minimum(where, len(self.keys) - 1)] == hashes[at]
        return at[good], where[good]


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct item pieces (block, id, text) and the number of blocks."""
    good = items.select(items[id_col].cast("string").alias("id"), items[text_col].cast("string").alias("text")).where("text is not null")
    good = good.distinct()  # one item repeated many times would be one block of any size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                w = words.find_words(*words.text_bytes(pa.array([text], pa.large_string())), words.ALNUM)
                raw, n = text.encode(), len(w.starts)
                for at in range(0, max(n - size + 1, 1), PIECE_WORDS):
                    to = min(at + PIECE_WORDS + size - 1, n)
                    if to > at:
                        rows.append((key, raw[w.starts[at] : w.ends[to - 1]].decode()))
            yield pd.DataFrame(rows, columns=["id", "text"])

    total = good.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    cut_up = good.mapInPandas(cut, "id string, text string")
    return cut_up.distinct().withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), blocks


def shingle_counts(rows: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences of a block's shingles in all documents, by (length, hash)."""
    sizes = block.sizes()
    tables = {q: np.unique(block.shingle_hash[block.shingle_len == q]) for q in sizes}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {q: Lookup(t) for q, t in tables.items()}
        counts = {q: np.zeros(len(t), np.int64) for q, t in tables.items()}
        for batch in batches:
            for _, _, w in words.column_words(batch.column(0), words.ALNUM):
                for q in sizes:
                    _, where = lookups[q].find(words.windows(w, q)[0])
                    np.add.at(counts[q], where, 1)
        for q in sizes:
            at = np.flatnonzero(counts[q])
            yield pa.RecordBatch.from_pydict({
                "q": pa.array(np.full(len(at), q)), "hash": pa.array(tables[q][at].view(np.int64)), "n": pa.array(counts[q][at]),
            })

    found = rows.select("text").mapInArrow(count, "q bigint, hash bigint, n bigint").groupBy("q", "hash").agg(F.sum("n").alias("n"))
    return {(r.q, r.hash): r.n for r in found.collect()}  # at most the shingles of one block


def prefixes(block: Block, counts: dict[tuple[int, int], int]) -> np.ndarray:
    """For each window the number of its rarest shingle; ties go to the smaller hash, then the earlier one."""
    signed = block.shingle_hash.view(np.int64)
    seen = np.array([counts.get(k, 0) for k in zip(block.shingle_len.tolist(), signed.tolist(), strict=True)], np.int64)
    order = np.lexsort((block.shingle_at, block.shingle_hash, seen, block.shingle_of))
    _, first = np.unique(block.shingle_of[order], return_index=True)
    return order[first]


def join_block(rows: DataFrame, block: Block, chosen: np.ndarray) -> DataFrame:
    """Adds what a block's windows hit to ``hits`` (word ranges) and ``items`` of each row."""
    sent = rows.sparkSession.sparkContext.broadcast((block, chosen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, prefix = sent.value
        tables = []
        for q in b.sizes():
            own = prefix[b.shingle_len[prefix] == q]
            own = own[np.argsort(b.shingle_hash[own], kind="stable")]
            keys, begin = np.unique(b.shingle_hash[own], return_index=True)
            tables.append((q, Lookup(keys), np.append(begin, len(own)), b.shingle_of[own], b.shingle_at[own]))
        for batch in batches:
            n_words, hits, items = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, _, w in words.column_words(batch.column(1), words.ALNUM):
                n_words += np.diff(w.rows).tolist()
                for doc, ranges, seen in _matches(w, b, tables):
                    hits[first + doc] = _merged(hits[first + doc] + ranges)
                    items[first + doc] = sorted({*items[first + doc], *seen})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(items, _ITEMS)],
                ["payload", "text", "n_words", "hits", "items"],
            )

    return rows.mapInArrow(work, rows.schema)


def _matches(w: words.Words, b: Block, tables: list) -> Iterator[tuple[int, list[int], set[str]]]:
    """(row, word ranges, items) of each row with a window in it."""
    starts, which = [], []
    rows = w.rows
    for q, lookup, begin, of, offset in tables:
        h, shingle_rows = words.windows(w, q)
        at, key = lookup.find(h)
        row = np.searchsorted(shingle_rows, at, "right") - 1
        place = at - shingle_rows[row] + rows[row]
        many = begin[key + 1] - begin[key]
        for a, z in _blocks(many):
            n = many[a:z]
            entry = np.repeat(begin[key[a:z]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc, window = np.repeat(row[a:z], n), of[entry]
            start = np.repeat(place[a:z], n) - offset[entry]
            fits = (start >= rows[doc]) & (start + b.lengths[window] <= rows[doc + 1])
            start, window = start[fits], window[fits]
            for k in range(b.window_words.shape[1]):
                inside = b.lengths[window] > k
                same = ~inside
                same[inside] = w.hashes[start[inside] + k] == b.window_words[window[inside], k]
                start, window = start[same], window[same]
            starts.append(start), which.append(window)
    if not starts or not sum(map(len, starts)):
        return
    start, window = np.concatenate(starts), np.concatenate(which)
    doc = np.searchsorted(rows, start, "right") - 1
    order = np.lexsort((start, doc))
    start, window, doc = start[order], window[order], doc[order]
    for a, z in zip(*(lambda i: (i, np.append(i[1:], len(doc))))(np.flatnonzero(np.diff(doc, prepend=-1))), strict=True):
        own = start[a:z] - rows[doc[a]]
        ranges = np.stack([own, own + b.lengths[window[a:z]]], axis=1)
        seen: set[str] = set()
        for k in np.unique(window[a:z]).tolist():
            seen.update(b.items[b.item_rows[k] : b.item_rows[k + 1]])
        yield int(doc[a]), _merged(ranges.ravel().tolist()), seen


def _blocks(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of positions that expand to about EXPAND candidates each."""
    total, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + EXPAND, "right")))
        yield at, to
        at = to


def _merged(flat: list[int]) -> list[int]:
    """Word ranges [start, end, start, end, ...] sorted and joined where they touch."""
    out: list[int] = []
    for a, z in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def _overlap(
    rows: DataFrame, items: DataFrame, item_id: str, item_text: str, size: int, shingle: int, block_bytes: int
) -> DataFrame:
    """rows (payload, text) with ``n_words``, ``hits`` and ``items``."""
    cut, blocks = item_blocks(items, item_id, item_text, size, block_bytes)
    out = rows.select(
        "payload", "text", F.lit(None).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        own = cut.where(F.col("block") == k).orderBy("id", "text").collect()  # one block, bounded by block_bytes
        block = build_block([r.id for r in own], [r.text for r in own], size, shingle)
        out = join_block(out, block, prefixes(block, shingle_counts(rows, block)))
    return out


def find_benchmark(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``hits`` (word ranges [start, end, ...]) and ``items`` (ids as sorted strings)."""
    rows = docs.select(docs[id_col].alias("payload"), docs[text_col].cast("string").alias("text"))
    out = _overlap(rows, items, item_id, item_text, size, shingle, block_bytes)
    return out.select(F.col("payload").alias(id_col), "n_words", "hits", "items")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents in which no window of the benchmark occurs, unchanged."""
    out = _overlap(carry.packed(docs, text_col), items, item_id, item_text, size, shingle, block_bytes)
    return out.where(F.size("hits") == 0).select(*carry.unpacked(docs, text_col))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, array_to_string(w[p:p + 9], ' ') k, least(len(w), 10) n
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) p from b)),
lens as (select distinct n from bw),
dw as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') k
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d cross join lens)),
hit as (select dw.doc_id, dw.p, dw.n, bw.item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
pos as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by 1),
its as (select doc_id, count(i) n_items, string_agg(i, ',' order by i) s
        from (select distinct doc_id, item_id::varchar i from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos on pos.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
"""


@registry.query("op5_decontamination", SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of benchmark items."""
    found = find_benchmark(registry.table(spark, sf_dir, "documents"), registry.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        _covered().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _covered():
    """Words in all ranges: ends less starts."""
    signed = F.transform("hits", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda n, x: n + x)

