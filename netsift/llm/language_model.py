r"""Language-model scoring with a weighted backoff automaton.

Tokens are words between ASCII white space (A-Z lower-cased) and one end per text. Counts come from the training texts.
Unigrams are smoothed by one; an n-gram (h, w) has the probability (c(h w) + MU p(w | h')) / (c(h) + MU), h' being h
without its first token. In the automaton the contexts seen in training are states; a seen n-gram is an arc with its
log-probability, and a failure arc with log MU / (c(h) + MU) leads to the state of h'. One traversal from left to right
carries the state of a text and adds up the weights. Texts begin in the state of the start mark.

The model grows with the corpus, so no task ever holds it. Texts are dealt into blocks of about ``BLOCK_BYTES`` by a hash
of id and text. A block sends each of its distinct n-grams once, as 64-bit hash with its count in training texts,
packed by hash range ("bucket"). A bucket adds up the counts and answers only where other blocks changed them.
So every block gets the part of the automaton that its texts walk, and nothing else; a common n-gram costs one entry
per block. In a block, texts are cut into segments walked in step; as a state is decided by the last tokens, a
segment starts as many tokens early and adds no weight there.

Null and empty texts are the end token alone. Without training texts all counts are 0. Repeated rows count and are scored
each; a null id is scored and is training (its remainder is none). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import labels, registry, words

ORDER = 2
MU = 200.0
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
SEGMENT = 512
FOLDS, HELD_OUT = 7, 2

_U = np.uint64
_CHAIN = _U(0xD6E8FEB86659FD93)
START, END = words.mix(np.array([0x53544152, 0x454E44], _U) << _U(8))  # no word has these hashes but by chance


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when their high bytes agree."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=_U(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(from_planes(data, _U), dtype=_U)


class Block:
    """Token sequences of some texts and their n-grams.

    ``seq`` is start, words, end of each text, one after the other; ``rows`` their borders. For level k (n-grams of k tokens)
    ``keys[k]`` are the distinct hashes and ``at[k]`` gives, for the position of an n-gram's last token, its
    place there (-1 where a text has begun less than k tokens before).
    """

    def __init__(self, texts: pa.Array, order: int):
        parts, sizes = [], []
        for _, _, w in words.column_words(texts):
            own = np.insert(w.hashes, np.concatenate([w.rows[:-1], w.rows[1:]]), np.repeat([START, END], len(w.rows) - 1))
            # of equal places, the end of a text comes before the start of the next
            starts = w.rows[:-1] + 2 * np.arange(len(w.rows) - 1)
            ends = w.rows[1:] + 2 * np.arange(len(w.rows) - 1) + 1
            keep = np.ones(len(own), bool)
            keep[starts] = keep[ends] = False
            own[keep], own[starts], own[ends] = w.hashes, START, END
            parts.append(own), sizes.append(np.diff(w.rows) + 2)
        self.seq = np.concatenate(parts) if parts else np.zeros(0, _U)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.arange(len(self.seq)) - np.repeat(self.rows[:-1], sizes)
        self.keys, self.at = {}, {}
        key = words.mix(self.seq)
        for k in range(1, order + 1):
            if k > 1:
                with np.errstate(over="ignore"):
                    key = np.concatenate([np.zeros(1, _U), words.mix(key[:-1] * _CHAIN + self.seq[1:])])[: len(self.seq)]
            good = place >= k - 1
            self.keys[k], back = np.unique(key[good], return_inverse=True)
            self.at[k] = np.full(len(self.seq), -1)
            self.at[k][good] = back
        self.place = place

    def counts(self, k: int, training: np.ndarray) -> np.ndarray:
        """Occurrences in training texts."""
        inside = np.repeat(training, np.diff(self.rows)) & (self.at[k] >= 0)
        return np.bincount(self.at[k][inside], minlength=len(self.keys[k]))


class Automaton:
    """States, arcs and failure arcs of one block, from the counts of its n-grams in all training texts."""

    def __init__(self, block: Block, counts: dict[int, np.ndarray], order: int, total: int, distinct: int, mu: float):
        self.block, self.order, self.counts = block, order, counts
        # the start mark is no token of its own; as a context it is as frequent as the end
        start, end = (np.searchsorted(block.keys[1], words.mix(np.array([x], _U))[0]) for x in (START, END))
        if len(block.keys[1]):
            counts[1][start] = counts[1][end]
        self.start = int(start)
        self.fail, self.arc, self.drop = {}, {}, {}
        prob = (counts[1] + 1) / (total + distinct + 1)
        self.arc[1] = np.log10(prob)
        self.drop[1] = np.log10(mu / (counts[1] + mu))
        self.fail[1] = np.full(len(block.keys[1]), -1)
        for k in range(2, order + 1):
            n, at = len(block.keys[k]), block.at[k]
            last = np.zeros(n, np.int64)
            here = np.flatnonzero(at >= 0)
            last[at[here]] = here
            self.fail[k] = block.at[k - 1][last]
            context = block.at[k - 1][last - 1] if n else np.zeros(0, np.int64)
            prob = (counts[k] + mu * prob[self.fail[k]]) / (counts[k - 1][context] + mu)
            self.arc[k] = np.log10(prob)
            self.drop[k] = np.log10(mu / (counts[k] + mu))
        self._link()

    def _link(self) -> None:
        """Arcs as sorted (state, token) keys; a state is its level and place, numbered from 1 (0 is the root)."""
        first, self.first = 1, {}
        for k in range(1, self.order):
            self.first[k] = first
            first += len(self.block.keys[k])
        states = first
        self.drop_of, self.fail_of = np.zeros(states), np.zeros(states, np.int64)
        for k in range(1, self.order):
            own = slice(self.first[k], self.first[k] + len(self.block.keys[k]))
            self.drop_of[own] = self.drop[k]
            self.fail_of[own] = np.where(self.fail[k] >= 0, self.first.get(k - 1, 0) + self.fail[k], 0)
        keys, weights, targets = [], [], []
        width = max(len(self.block.keys[1]), 1)
        for k in range(2, self.order + 1):
            at = self.block.at[k]
            here = np.flatnonzero(at >= 0)
            last = np.zeros(len(self.block.keys[k]), np.int64)
            last[at[here]] = here
            seen = np.flatnonzero(self.counts[k] > 0)
            source = self.first[k - 1] + self.block.at[k - 1][last[seen] - 1]
            keys.append(source * width + self.block.at[1][last[seen]])
            weights.append(self.arc[k][seen])
            targets.append(self.first[k] + seen if k < self.order else self.first[k - 1] + self.fail[k][seen])
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.width, self.keys = width, key[order]
        self.weights = (np.concatenate(weights) if weights else np.zeros(0))[order]
        self.targets = (np.concatenate(targets) if targets else np.zeros(0, np.int64))[order]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token each, and the weights of the arcs taken."""
        weight, state = np.zeros(len(state)), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            at_root = state[open_] == 0
            root = open_[at_root]
            weight[root] += self.arc[1][token[root]]
            seen = self.counts[1][token[root]] > 0
            state[root] = np.where(seen & (self.order > 1), 1 + token[root], 0)
            open_ = open_[~at_root]
            if not len(open_):
                break
            key = state[open_] * self.width + token[open_]
            place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[place] == key if len(self.keys) else np.zeros(len(open_), bool)
            taken = open_[hit]
            weight[taken] += self.weights[place[hit]]
            state[taken] = self.targets[place[hit]]
            open_ = open_[~hit]
            weight[open_] += self.drop_of[state[open_]]
            state[open_] = self.fail_of[state[open_]]
        return state, weight

    def scores(self) -> np.ndarray:
        """log10 probability of each text."""
        block, early = self.block, self.order - 1
        n_tokens = np.diff(block.rows) - 1  # without the start mark
        pieces = -(-n_tokens // SEGMENT)
        text = np.repeat(np.arange(len(n_tokens)), pieces)
        begin = 1 + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + SEGMENT, 1 + n_tokens[text])
        place = np.maximum(begin - early, 1)
        known = self.order > 1 and len(self.counts[1]) and self.counts[1][self.start] > 0
        state = np.where((place == 1) & known, 1 + self.start, 0)
        total = np.zeros(len(text))
        base = block.rows[text]
        alive = np.arange(len(text))
        while len(alive):
            token = block.at[1][base[alive] + place[alive]]
            state[alive], weight = self.step(state[alive], token)
            total[alive] += np.where(place[alive] >= begin[alive], weight, 0)
            place[alive] += 1
            alive = alive[place[alive] < end[alive]]
        return np.bincount(text, total, minlength=len(n_tokens))


def corpus_size(rows: DataFrame, buckets: int) -> tuple[int, int]:
    """Training tokens and distinct training tokens, from (text, held_out)."""

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, total = [], 0, 0
        for batch in batches:
            texts = batch.column(0).filter(pc.invert(batch.column(1)))
            for _, _, w in words.column_words(texts):
                total += len(w.hashes) + len(w.rows) - 1
                held.append(np.unique(w.hashes))
                kept += len(held[-1])
                if kept > 1_000_000:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 500_000:
                        yield from _split(held[0], total, buckets)
                        held, total = [], 0
                    kept = sum(map(len, held))
        yield from _split(np.unique(np.concatenate(held)) if held else np.zeros(0, _U), total, buckets)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            total += sum(batch.column(2).to_pylist())
            held += [unpack_keys(x) for x in batch.column(1).to_pylist()]
        number = len(np.unique(np.concatenate(held))) if held else 0
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64()), "v": pa.array([number], pa.int64())})

    sent = rows.mapInArrow(unigrams, "bucket int, keys binary, total bigint")
    found = sent.groupBy("bucket").applyInArrow(distinct, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    texts = found.n or 0
    return texts, (found.v or 0) + (1 if texts else 0)  # and the end token


def _split(keys: np.ndarray, total: int, buckets: int) -> Iterator[pa.RecordBatch]:
    borders = np.searchsorted(keys, _edges(buckets))
    parts = [(b, keys[x:y]) for b, (x, y) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if y > x or b == 0]
    yield pa.RecordBatch.from_pydict({
        "bucket": pa.array([b for b, _ in parts], pa.int32()), "keys": pa.array([pack_keys(x) for _, x in parts], pa.binary()),
        "total": pa.array([total if b == 0 else 0 for b, _ in parts], pa.int64()),
    })


def _edges(buckets: int) -> np.ndarray:
    """buckets + 1 borders of equal ranges of 64-bit hashes."""
    out = np.array([(k << 64) // buckets for k in range(buckets)], _U)
    return np.append(out, np.iinfo(_U).max)


def score_texts(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``held_out`` is a column over ``id``; where it holds, a text is not counted.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = (max(tasks, -(-size // per)) for per in (block_bytes, bucket_bytes))
    total, distinct = corpus_size(rows.select("text", "held_out"), buckets)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block")

    def ask(table: pa.Table) -> pa.Table:
        """A block's distinct n-grams and their counts in its own training texts, by level and bucket."""
        number, training = table.column("block")[0].as_py(), ~table.column("held_out").to_numpy()
        block = Block(table.column("text"), order)
        out = []
        for k in range(1, order + 1):
            counts = block.counts(k, training).astype(np.uint32)
            borders = np.searchsorted(block.keys[k], _edges(buckets))
            out += [
                (b, number, k, pack_keys(block.keys[k][x:y]), planes(counts[x:y]))
                for b, (x, y) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if y > x
            ]
        return _table(out, ["bucket", "block", "level", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        """The totals of a bucket, to each block where they differ from its own counts."""
        bucket = table.column("bucket")[0].as_py()
        own = [
            (b, k, unpack_keys(keys), from_planes(counts, np.uint32))
            for b, k, keys, counts in zip(*(table.column(c).to_pylist() for c in ("block", "level", "keys", "counts")), strict=True)
        ]
        out = []
        for level in range(1, order + 1):
            parts = [p for p in own if p[1] == level]
            if not parts:
                continue
            keys, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([p[3] for p in parts]), minlength=len(keys)).astype(np.int64)
            at = 0
            for b, k, mine, counts in parts:
                totals = sums[back[at : at + len(mine)]]
                at += len(mine)
                changed = np.flatnonzero(totals != counts)
                if len(changed):  # as places among the keys that the block has sent
                    out.append((bucket, b, k, pack_keys(changed.astype(_U)), planes(totals[changed])))
        return _table(out, ["bucket", "block", "level", "keys", "counts"])

    shape = "bucket int, block int, level int, keys binary, counts binary"
    asked = dealt.groupBy("block").applyInArrow(ask, shape)
    answered = asked.groupBy("bucket").applyInArrow(answer, shape)

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        held = table.column("held_out").to_numpy()
        block = Block(table.column("text"), order)
        counts = {k: block.counts(k, ~held) for k in range(1, order + 1)}
        first = {k: np.searchsorted(block.keys[k], _edges(buckets)) for k in block.keys}
        for b, k, places, totals in zip(*(answers.column(c).to_pylist() for c in ("bucket", "level", "keys", "counts")), strict=True):
            counts[k][first[k][b] + unpack_keys(places).astype(np.int64)] = from_planes(totals, np.int64)
        model = Automaton(block, counts, order, total, distinct, mu)
        text = np.repeat(np.arange(len(held)), np.diff(block.rows))
        token = block.at[1]
        real = block.place > 0  # without start marks
        base = np.log10((counts[1][token[real]] + 1) / (total + distinct + 1))
        return pa.table({
            "id": table.column("id"), "held_out": table.column("held_out"), "n_tokens": pa.array(np.diff(block.rows) - 1),
            "n_known": pa.array(np.bincount(text[real], counts[1][token[real]] > 0, minlength=len(held)).astype(np.int64)),
            "base_score": pa.array(np.bincount(text[real], base, minlength=len(held))), "score": pa.array(model.scores()),
        })

    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        walk, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


@registry.query("op3_language_model")
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of every document under a smoothed bigram model of the training documents."""
    held_out = labels.remainder(F.col("id"), FOLDS) == HELD_OUT
    return score_texts(registry.table(spark, sf_dir, "documents"), held_out)
