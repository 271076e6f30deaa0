"""Toxicity: a learned lexicon as a trie, Levenshtein automata against it, and context windows around hits.

Learning reads a bounded sample of labelled rows (``FIT_ROWS``, a documented parameter). Words that are far more common in
toxic than in clean rows become entries; so do beginnings of words that many different such words share. Both
are kept in one trie, at most ``LEXICON`` of each. Common means: of the words read under a label, whatever share of the
rows has it, and too much for chance. A second lexicon holds the words that are far more common in clean rows, so that labels under
which the telling words are those of label 0 are learned as well.

A word is judged by running its Levenshtein automaton (rows of edit distances, cut off above one edit) along the trie: an
entry at distance 0 is ``exact``, a beginning that ends inside the word is ``stem``, an entry of ``FUZZY_LENGTH`` or more
characters at distance 1 is ``fuzzy``. Only distinct words meet the automaton; each task remembers up to
``REMEMBER`` of them.

Every hit is set into a window of ``WINDOW`` words to both sides. Quotation marks on both sides, or a reporting word
before it, make it ``quoted``, otherwise it is ``plain``; a second person in the window makes it ``aimed``. Log counts by
kind and setting and the share of hits, of each lexicon, enter a logistic regression fitted on the same sample, so the labels
decide what a quotation is worth.

Null and empty texts and texts without hits have the score of no hit. Without labelled rows, or with one label only,
every score is the share of toxic rows seen (0 if none). Ids, languages, sources and labels are never inputs of a score.
Repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import labels, registry, words

FIT_ROWS = 12_000
LEXICON = 20_000
LIFT = 16.0
EVIDENCE = 8.0
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_WORDS = 6
STEM_EVIDENCE = 20.0
FUZZY_LENGTH = 5
WINDOW = 8
REMEMBER = 400_000
THRESHOLD = 0.7
FOLDS = 3

# Words that report speech, and second persons.
REPORTING = "said says say wrote called quote quoted quotes told dijo dice dit sagt sagte schrieb".split()
SECOND = "you your yours du dich dir dein ihr tu te toi vous ton usted tus eres".split()

NO_HIT, EXACT, STEM, FUZZY = 0, 1, 2, 3
PER_LEXICON = 9
FEATURES = 2 * PER_LEXICON

Lexicon = tuple[list[str], list[str]]  # entries and stems
NO_LEXICON: Lexicon = ([], [])


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entry: bool = False
    stem: bool = False


class Trie:
    """Entries and stems; judges words by their Levenshtein automaton of one edit."""

    def __init__(self, entries: list[str], stems: list[str]):
        self.root = Node()
        for word in entries:
            self._add(word).entry = True
        for word in stems:
            self._add(word).stem = True

    def _add(self, word: str) -> Node:
        node = self.root
        for c in word:
            node = node.children.setdefault(c, Node())
        return node

    def judge(self, word: str) -> int:
        node, stem = self.root, False
        for c in word:
            node = node.children.get(c)
            if node is None:
                break
            stem = stem or node.stem
        else:
            if node.entry:
                return EXACT
        if stem:
            return STEM
        return FUZZY if len(word) >= FUZZY_LENGTH - 1 and self._fuzzy(word) else NO_HIT

    def _fuzzy(self, word: str) -> bool:
        """Whether an entry of FUZZY_LENGTH or more characters is one edit away.

        States are (letters of the word read, edits made); without an edit so far the automaton may also swap, skip or add
        a letter, with one it only reads on. A dead state is a trie node without the wanted child.
        """
        node, depth = self.root, 0
        while node is not None:  # the state without edits walks straight down
            rest = word[depth:]
            if len(rest) == 1 and node.entry and depth >= FUZZY_LENGTH:
                return True
            if self._reads(node, rest[1:], depth):
                return True
            for child in node.children.values():
                if self._reads(child, rest, depth + 1) or (rest and self._reads(child, rest[1:], depth + 1)):
                    return True
            if not rest:
                return False
            node, depth = node.children.get(rest[0]), depth + 1
        return False

    @staticmethod
    def _reads(node: Node, rest: str, depth: int) -> bool:
        for c in rest:
            node = node.children.get(c)
            if node is None:
                return False
        return node.entry and depth + len(rest) >= FUZZY_LENGTH


def with_straight_quotes(texts: pa.Array) -> pa.Array:
    """Curly and angle quotation marks as straight ones, so that they part words and set off hits as those do."""
    return pc.replace_substring_regex(texts, "[\u201c\u201d\u201e\u00ab\u00bb]", '"')


class Reader:
    """Features of documents by one lexicon; remembers judged words by their hash."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.empty = not trie.root.children
        self.known: dict[int, int] = {}
        hashed = [words.find_words(*words.text_bytes(pa.array([" ".join(own)])), words.ALNUM).hashes for own in (REPORTING, SECOND)]
        self.reporting, self.second = (np.sort(h) for h in hashed)

    def kinds(self, w: words.Words) -> np.ndarray:
        hashes, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.known.clear()
        out = np.empty(len(hashes), np.int8)
        known = self.known
        for k, h in enumerate(hashes.tolist()):
            kind = known.get(h)
            if kind is None:
                kind = known[h] = self.trie.judge(w.word(first[k]).decode("utf-8", "replace"))
            out[k] = kind
        return out[back]

    def features(self, w: words.Words) -> np.ndarray:
        n = len(w.rows) - 1
        out = np.zeros((n, PER_LEXICON))
        if self.empty:
            return out
        kinds = self.kinds(w)
        at = np.flatnonzero(kinds)
        if not len(at):
            return out
        doc = np.searchsorted(w.rows, at, "right") - 1
        lo, hi = np.maximum(at - WINDOW, w.rows[doc]), np.minimum(at + WINDOW, w.rows[doc + 1] - 1)
        quotes = np.flatnonzero(w.low == 0x22)
        left = np.where(lo > w.rows[doc], w.ends[lo - 1], w.bytes[doc])
        right = np.where(hi + 1 < w.rows[doc + 1], w.starts[np.minimum(hi + 1, len(w.starts) - 1)], w.bytes[doc + 1])
        before = np.searchsorted(quotes, w.starts[at]) - np.searchsorted(quotes, left)
        after = np.searchsorted(quotes, right) - np.searchsorted(quotes, w.ends[at])
        told = np.concatenate([[0], np.cumsum(np.isin(w.hashes, self.reporting))])
        aims = np.concatenate([[0], np.cumsum(np.isin(w.hashes, self.second))])
        quoted = ((before > 0) & (after > 0)) | (told[at] - told[lo] > 0)
        column = (kinds[at].astype(np.int64) - 1) * 2 + quoted
        np.add.at(out, (doc, column), 1)
        np.add.at(out[:, 6], doc, aims[hi + 1] - aims[lo] > 0)
        total = out[:, :6].sum(axis=1)
        out[:, :7] = np.log1p(out[:, :7])
        out[:, 7] = np.minimum(total / np.maximum(np.diff(w.rows), 1) * 20, 3)
        out[:, 8] = total > 0
        return out


def _evidence(own: Column, other: Column, share: Column) -> Column:
    """How far a word's counts are from chance, if ``share`` of all words are read under its own label: the log of the odds."""
    n = own + other
    part = lambda k, of: F.when(k > 0, k * F.log(k / (n * of))).otherwise(0.0)
    return part(own, share) + part(other, 1 - share)


def _lift(own: Column, other: Column, share: Column) -> Column:
    """How many times more common a word is under its own label than under the other; half a word more is seen of both."""
    return (own + 0.5) / share / ((other + 0.5) / (1 - share))


def lexicons(sample: DataFrame) -> tuple[Lexicon, Lexicon]:
    """Entries and stems from a sample of (text, label): those of toxic rows and those of clean ones.

    A word counts once for each pair of neighbours, so copies of one text do not make a word common.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy() >= 0.5
            for a, _, w in words.column_words(with_straight_quotes(batch.column(0)), words.ALNUM):
                h = w.hashes
                row = w.row_of()
                left, right = np.zeros_like(h), np.zeros_like(h)
                left[1:], right[:-1] = h[:-1] * (row[1:] == row[:-1]), h[1:] * (row[1:] == row[:-1])
                with np.errstate(over="ignore"):
                    around = words.mix(left * np.uint64(3) + right)
                    key = words.mix(around + h) ^ toxic[a + row].astype(np.uint64)
                _, first = np.unique(key, return_index=True)
                first = first[w.ends[first] - w.starts[first] >= min(STEM_LENGTHS)]
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([w.word(k).decode("utf-8", "replace") for k in first.tolist()], pa.string()),
                    "around": pa.array(around[first].view(np.int64)), "toxic": pa.array(toxic[a + row[first]].astype(np.int64)),
                })

    seen = sample.mapInArrow(neighbours, "word string, around bigint, toxic bigint").distinct()
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).persist()
    toxic, clean = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    try:
        if not toxic or not clean:
            return NO_LEXICON, NO_LEXICON
        return _of_label(counts, "t", "c", toxic / (toxic + clean)), _of_label(counts, "c", "t", clean / (toxic + clean))
    finally:
        counts.unpersist()


def _of_label(counts: DataFrame, own: str, other: str, share: float) -> Lexicon:
    """The entries and stems of the label whose counts ``own`` holds."""
    k, j, of = F.col(own), F.col(other), F.lit(share)
    telling = (_lift(k, j, of) >= LIFT) & (k > j * share / (1 - share))
    stems = (
        counts.select("t", "c", F.explode(F.array(*[F.lit(n) for n in STEM_LENGTHS])).alias("n"), "word")
        .where(F.length("word") >= F.col("n")).groupBy(F.expr("substring(word, 1, n)").alias("stem"))
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((k > 0).cast("int")).alias("forms"))
        .where(telling & (F.col("forms") >= STEM_WORDS)).withColumn("e", _evidence(k, j, of)).where(F.col("e") >= STEM_EVIDENCE)
        .orderBy(F.desc("e"), "stem").limit(LEXICON).collect()
    )
    chosen: set[str] = set()
    for stem in sorted((r.stem for r in stems), key=lambda x: (len(x), x)):
        if not any(stem[:n] in chosen for n in range(1, len(stem))):
            chosen.add(stem)
    found = counts.where(telling).withColumn("e", _evidence(k, j, of)).where(F.col("e") >= EVIDENCE)
    entries = found.orderBy(F.desc("e"), "word").limit(LEXICON).collect()
    return sorted(r.word for r in entries if not any(r.word[:n] in chosen for n in range(1, len(r.word) + 1))), sorted(chosen)


@dataclass
class Model:
    entries: list[str]
    stems: list[str]
    weights: np.ndarray
    clean: Lexicon = NO_LEXICON

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant.

    A full step can overshoot where the features part the labels cleanly, and the constant then runs away until all scores are
    one: so a step is halved until it lowers the penalized loss.
    """
    share = y.mean() if len(y) else 0.0
    base = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    weights = np.append(np.zeros(x.shape[1]), base)
    if not 0 < share < 1:
        return weights
    full = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag(np.append(np.full(x.shape[1], penalty), 1e-6))

    def loss(w: np.ndarray) -> float:
        return np.sum(np.logaddexp(0, full @ w) - y * (full @ w)) + w @ ridge @ w / 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + ridge, full.T @ (p - y) + ridge @ weights)
        while np.abs(step).max() >= 1e-6 and loss(weights - step) > loss(weights):
            step = step / 2
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def with_features(rows: DataFrame, entries: list[str], stems: list[str], passed: str, clean: Lexicon = NO_LEXICON) -> DataFrame:
    """(text, x) becomes (x, features): x passes unchanged. ``clean`` is the lexicon of label 0."""
    sent = rows.sparkSession.sparkContext.broadcast(((entries, stems), clean))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(Trie(*one)) for one in sent.value]
        for batch in batches:
            parts = words.column_words(with_straight_quotes(batch.column(0)), words.ALNUM)
            found = [np.column_stack([reader.features(w) for reader in readers]) for _, _, w in parts]
            flat = np.concatenate(found) if found else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(list(flat), pa.list_(pa.float64()))], [passed, "features"]
            )

    kind = rows.schema[passed].dataType.simpleString()
    return rows.mapInArrow(work, f"{passed} {kind}, features array<double>")


def fit(docs: DataFrame, known: DataFrame, text_col: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model:
    learn = labels.remainder(F.col("id"), FOLDS) != 1
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = labels.labelled_sample(docs, known, label, learn, FIT_ROWS, id_col, text_col).repartition(tasks)
    (entries, stems), clean = lexicons(sample)
    got = with_features(sample, entries, stems, "label", clean).toArrow()  # at most FIT_ROWS rows
    x = np.array(got.column(1).to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    y = (got.column(0).to_numpy() >= 0.5).astype(np.float64)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever order the rows arrive in
    return Model(entries, stems, regression(x[order], y[order]), clean)


@registry.query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document. Learned, so no SQL; held-out accuracy is tested."""
    docs = registry.table(spark, sf_dir, "documents")
    model = fit(docs, registry.table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    found = with_features(rows, model.entries, model.stems, "doc_id", model.clean)
    total = sum((F.get("features", F.lit(k)) * F.lit(float(w)) for k, w in enumerate(model.weights[:-1])), F.lit(float(model.weights[-1])))
    scored = found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"))
    return scored.select(
        "doc_id", (labels.remainder(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
