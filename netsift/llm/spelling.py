"""Spelling variants: words one edit apart, grouped under the more frequent form, by asymmetric q-chunks.

1. Runs of letters of whole texts are counted per batch of a task first, so a hot word shuffles one row per batch.
2. A word of length L contributes two disjoint chunks, its halves. The word compared with it contributes its positional
   grams of the same length. One edit changes one chunk at most, so the other one is a gram of the other word: at the same
   place, or one further right if that word is one longer and the edit lies before it. Words join on (L, place, gram) within
   that shift of 0 or 1; grams at other places can meet no chunk and are not made.
3. Where more than ``GROUP`` rows share a chunk, the edit lies in the window that the chunk does not cover. That window is halved
   again and the rows join on all that lies outside of one half. This goes on while a group is wide, to windows of one code
   point, where a group is no larger than the alphabet allows. So a common half makes no square of rows.
4. Joined words are verified by their edit distance, so equal hashes of different grams do no harm.

A word's form is its near word of largest count, if that has at least ``FACTOR`` times its own count; counts double along forms,
so the chain to the root is short and pointer jumping ends in a few rounds, each written to the shared folder.

Null and empty texts have no words. A null id counts as an empty one when runs are perturbed. Repeated rows count again.
Ties between near words of one count go to the smallest in code-point order. A very long text is one row; a very long run
is one word like any other. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry
from netsift.llm.near_duplicates import Work, small

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
FACTOR = 2
TYPO_EVERY = 97
GROUP = 64
HELD = 1 << 18


def with_typo(doc_id: str, run: str, every: int = TYPO_EVERY) -> str:
    """The run, of which one code point is deleted if ``every`` divides the crc32 of ``doc_id:run``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted_words(docs: DataFrame, every: int = TYPO_EVERY, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of (doc_id, text): words of at least ``least_length`` code points with their number of occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(*(batch.column(k) for k in range(2)), strict=True):
                lowered = (text.as_py() or "").encode().lower().decode()
                for run, n in Counter(LETTERS.findall(lowered)).items():
                    if len(run) >= least_length and len(word := with_typo(key.as_py() or "", run, every)) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    found = docs.mapInArrow(work, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def outside(lo: Column, hi: Column, shift: Column) -> Column:
    """What a word holds before ``lo`` and, ``shift`` further right, from ``hi`` on, named with its place."""
    return F.xxhash64(
        "size", lo, hi, F.substring("word", F.lit(1), lo), F.substring("word", hi + shift + 1, F.char_length("word"))
    )


def halved(rows: DataFrame) -> DataFrame:
    """Every row twice: the edit lies in the first or in the second half of its window, the other half is a chunk or gram."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    cut = rows.select("word", "n", "size", "shift", F.explode(halves).alias("w")).select("word", "n", "size", "shift", "w.lo", "w.hi")
    return cut.withColumn("key", outside(F.col("lo"), F.col("hi"), F.col("shift")))


def near_words(words: DataFrame, work: Work) -> DataFrame:
    """(a, n_a, b, n_b): every two words exactly one insertion, deletion or replacement apart, once."""
    shifts = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    size = F.char_length("word") - F.col("shift")
    rows = words.select("word", "n", shifts).select("word", "n", size.alias("size"), "shift", F.lit(0).alias("lo"), size.alias("hi"))
    pairs = None
    while True:
        rows = work.kept(halved(rows))
        wide = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        wide = work.kept(wide.where((F.col("m") > GROUP) & (F.col("open") > 1)).select("key"))
        last = wide.isEmpty()
        listed = None if last else small(wide)
        narrow = rows if last else rows.join(listed, "key", "left_anti")
        chunks = narrow.where("shift = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        grams = narrow.select("key", "shift", F.col("word").alias("b"), F.col("n").alias("n_b"))
        met = chunks.join(grams, "key").where("(shift = 1 or a < b) and levenshtein(a, b, 1) = 1").select("a", "n_a", "b", "n_b")
        pairs = met if pairs is None else pairs.union(met)
        if last:
            return work.kept(pairs.distinct())
        rows = rows.join(listed, "key", "left_semi").drop("key")


def roots(forms: DataFrame, work: Work) -> DataFrame:
    """(word, root) of (word, form): the last word on the way along forms."""
    found = work.kept(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = work.kept(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        found = jumped.select("word", "root")
        if jumped.where("next is not null").isEmpty():
            return found


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n) with each word once becomes word, form, root, n, n_near, form_n."""
    work = Work(words.sparkSession)
    words = work.kept(words)
    pairs = near_words(words, work)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), "other")).alias("best"))
    grows = -F.col("best.m") >= factor * F.col("n")
    formed = work.kept(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(grows, F.col("best.other")).alias("form"), F.when(grows, -F.col("best.m")).alias("form_n"),
        )
    )
    ends = roots(formed.where("form is not null").select("word", "form"), work)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR,
) -> DataFrame:
    """The forms of all words that occur at least ``least_count`` times in the texts."""
    texts = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return spelling_forms(counted_words(texts, every, least_length).where(F.col("n") >= least_count), factor)


SQL = r"""
with steps as (select list_transform(range(256), lambda k: list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) r from documents),
many as (select doc_id, r, count(*) n from runs group by 1, 2),
bytes as (select doc_id, r, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) x from many where length(r) >= 5),
sums as (select doc_id, r, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, length(x) // 2 + 1), lambda k: ('0x' || substr(x, (2 * k - 1)::int, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) h from bytes, steps),
v as (select case when h % 97 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end word, n from sums),
w as (select word, sum(n)::bigint n from v where length(word) >= 5 group by 1 having sum(n) >= 3),
d as (select word, n, unnest(range(1, length(word) + 1)) p from w),
e as (select word, n, p, substr(word, 1, p::int - 1) || substr(word, p::int + 1) x from d),
l as (select a.word x, b.word y, b.n from e a join e b on a.p = b.p and a.x = b.x and a.word <> b.word
  union select e.word, w.word, w.n from e join w on w.word = e.x union select w.word, e.word, e.n from e join w on w.word = e.x),
f as (select x word, count(*) n_near, min(struct_pack(m := -n, w := y)) b from l group by 1),
o as (select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when -b.m >= 2 * w.n then b.w end form, case when -b.m >= 2 * w.n then -b.m end form_n
  from w left join f using (word)),
r as (with recursive r(word, z) as (select word, word from o union all select r.word, o.form from r join o on o.word = r.z where o.form is not null)
  select r.word, r.z root from r join o on o.word = r.z where o.form is null)
select o.word, form, root, n, n_near, form_n::bigint form_n from o join r using (word)
"""


@registry.query("op11_spelling", SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(registry.table(spark, sf_dir, "documents"))
