r"""URL filter: a sort-merge range join of hosts with nested host rules, then path prefixes.

A host's key is its labels in reverse, each followed by a zero character: ``www.example.com`` becomes
``com\0example\0www\0``. All subdomains of a rule's host lie in the interval from the rule's key to that key with
a largest character behind it, and two intervals are nested or apart. In a sweep over pages and rules sorted
by key, the rules whose interval is open form a stack; a page takes the best rule on the stack whose path
its own path begins with.

Pages are cut by key into as many ranges as there are shuffle partitions. The borders are quantiles of (key,
salt) of a bounded sample of pages; the salt is a hash of the page, so a host with a third of all pages is spread
over a third of the ranges. A rule goes to every range that its interval meets. Borders only decide where a
row is compared, never whether it matches. One shuffle moves ids, hosts and paths.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#``
or the end; a url that is null or has no ``://`` has both empty and takes the default verdict. The longest rule
wins (characters of host and path together); of equal length, the longer host, then block before allow. Rules
whose host is empty fit every host. Repeated rules and pages are harmless; without rules all verdicts are the
default. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import registry

SAMPLE_PER_RANGE = 60
DEFAULT_VERDICT = "allow"

# The rules of the query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a zero character behind it; the empty host has the empty key.

    Zero characters inside a label become two others, so only the end of a label is one.
    """
    plain = F.replace(F.replace(host, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))
    labels = F.transform(F.reverse(F.split(plain, r"\.")), lambda x: F.concat(x, F.lit("\0")))
    return F.when(host == "", F.lit("")).otherwise(F.array_join(labels, ""))


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _borders(keyed: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """At most ranges - 1 sorted (key, salt) pairs from a sample of about SAMPLE_PER_RANGE pages for each range."""
    total = keyed.count()
    if total == 0 or ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / total)
    sample = keyed.where(F.pmod("salt", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "salt")
    found = sorted((r.key, r.salt) for r in sample.limit(4 * ranges * SAMPLE_PER_RANGE).collect())
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    spark = pages.sparkSession
    url = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    parts = url.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = parts.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("id", "host", "path"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(keyed, ranges)
    ranges = len(borders) + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The range of each page: how many borders are at or below its (key, salt)."""
        keys = np.array([k.encode() for k, _ in borders], dtype=object)
        salts = np.array([s for _, s in borders], dtype=np.int64)
        for batch in batches:
            key = np.array([k.encode() for k in batch.column(3).to_pylist()], dtype=object)
            salt = batch.column(4).to_numpy()
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            where = lo.copy()
            for at in np.flatnonzero(hi > lo):
                where[at] = lo[at] + np.searchsorted(salts[lo[at] : hi[at]], salt[at], "right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(where.astype(np.int32))], ["id", "host", "path", "key", "range"]
            )

    kind = keyed.schema["id"].dataType.simpleString()
    dealt = keyed.mapInArrow(pick, f"id {kind}, host string, path string, key string, range int")

    known = rules.select(
        rules["verdict"].alias("verdict"), F.translate(F.coalesce(rules["host"], F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce(rules["path"], F.lit("")).alias("path"),
    ).where("verdict is not null")
    known = known.withColumn("key", host_key(F.col("host")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A rule once for every range that its interval meets."""
        keys = np.array([k.encode() for k, _ in borders], dtype=object)
        for batch in batches:
            key = [k.encode() for k in batch.column(3).to_pylist()]
            first = np.searchsorted(keys, np.array(key, dtype=object), "left")
            last = np.searchsorted(keys, np.array([k + LAST.encode() for k in key], dtype=object), "right")
            many = last - first + 1
            row = np.repeat(np.arange(len(key)), many)
            where = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(row)) for c in batch.columns], pa.array(where.astype(np.int32))],
                ["verdict", "host", "path", "key", "range"],
            )

    copied = known.mapInArrow(spread, "verdict string, host string, path string, key string, range int")
    both = dealt.select("range", "key", F.lit(1).alias("page"), "host", "path", "id", F.lit(None).cast("string").alias("verdict")).unionByName(
        copied.select("range", "key", F.lit(0).alias("page"), "host", "path", F.lit(None).cast(kind).alias("id"), "verdict")
    )
    ordered = both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "page")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, rules before pages of the same key; the stack holds the open intervals."""
        stack: list[tuple[str, dict[str, tuple], dict[int, bool]]] = []  # key, rules by path, lengths of paths
        for batch in batches:
            out: list[tuple[str | None, str]] = []
            at = []
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 6)), strict=True)
            for k, (key, page, host, path, verdict) in enumerate(rows):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not page:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, {}))
                    _, held, lengths = stack[-1]
                    rule = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
                    held[path] = max(rule, held.get(path, rule))
                    lengths[len(path)] = True
                    continue
                best = None
                for _, held, lengths in stack:
                    for length in lengths:
                        rule = held.get(path[:length]) if length <= len(path) else None
                        if rule and (best is None or rule > best):
                            best = rule
                at.append(k)
                out.append(best[3:] if best else (None, default))
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(5).take(taken), batch.column(3).take(taken), batch.column(4).take(taken),
                    pa.array([r for r, _ in out], pa.string()), pa.array([v for _, v in out], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict"],
            )

    judged = ordered.mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


SQL = r"""
with rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest from pages),
parts as (select page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from cut),
ids as (select *, row_number() over () n from parts),
fit as (select n, verdict, rhost || rpath rule,
    row_number() over (partition by n order by length(rhost || rpath) desc, length(rhost) desc) k
  from ids join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict
from ids left join fit on fit.n = ids.n and fit.k = 1
"""


@registry.query("op2_url_filter", SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    return judge_urls(registry.table(spark, sf_dir, "pages"), rule_frame(spark, RULES))
