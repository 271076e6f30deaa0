"""Global ranks, running sums and exact quantiles without a single-task sort.

Rows are dealt into sorted ranges of about equal size, whose borders Spark takes from a sample of the rows. The ranges are
stored once, so that their numbers stay as they are; what lies before a range is a sum over as many rows as there are ranges.
Equal rows are told apart by their place in the input, so one value, one key or one repeated row may hold any share of the
rows and still spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.session import run_folder
from netsift.sources.sinks import settle

SMALL = 100_000  # rows that may be broadcast


def _sorted_ranges(df: DataFrame, by: list) -> DataFrame:
    """The rows with ``_part``, the number of their range, and ``_at``, their place in it from 0."""
    by = [*by, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    stored = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), run_folder(df.sparkSession, "ranges"))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumns({"_part": part, "_at": place})


def _before_each(totals: DataFrame, names: list[str]) -> DataFrame:
    """For each range the sums over all earlier ones; one row per range."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names])


def range_rank(df: DataFrame, order: list, name: str = "rank", keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Adds the 1-based rank over ``order`` (inside ``keys``, if given) and with ``total`` how many rows were ranked there."""
    keys = keys or []
    stored = _sorted_ranges(df, [*keys, *order])
    if keys:  # joined by range and key, so that a key with most of the rows stays spread over its ranges
        named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
        spans = stored.groupBy(F.col("_part").alias("_in"), *named).agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
        own = Window.partitionBy(*[f"_key{i}" for i in range(len(keys))])  # one row per range that holds the key
        earlier = F.sum("_here").over(own.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
        spans = spans.select("_in", *[f"_key{i}" for i in range(len(keys))], "_first", F.coalesce(earlier, F.lit(0)).alias("_start"), F.sum("_here").over(own).alias("_of"))
        if spans.limit(SMALL + 1).count() <= SMALL:
            spans = F.broadcast(spans)
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
        ranked = stored.join(spans, [F.col("_part") == F.col("_in"), *same])
        ranked = ranked.withColumn(name, F.col("_start") + F.col("_at") - F.col("_first") + 1)
    else:
        counts = stored.groupBy("_part").agg(F.count("*").alias("_start"))
        starts = F.broadcast(_before_each(counts, ["_start"]))  # one row per range
        ranked = stored.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at") + 1)
        if total:
            ranked = ranked.join(F.broadcast(counts.agg(F.sum("_start").alias("_of"))), how="cross")  # one row
    if total:
        ranked = ranked.withColumn(total, F.col("_of"))
    return ranked.select(*df.columns, name, *([total] if total else []))


def range_sums(df: DataFrame, order: list, sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Adds for each name the sum of its column over all rows up to this one in ``order`` (inside ``keys``, if given)."""
    keys = keys or []
    stored = _sorted_ranges(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), [*keys, *order])
    totals = stored.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    if keys:  # only a key that spans ranges has something before it: one per range border
        last = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("_part", *keys, *[F.sum(f"_b_{n}").over(last).alias(f"_b_{n}") for n in sums])
        before = before.where(F.col(f"_b_{next(iter(sums))}").isNotNull())
    else:
        before = _before_each(totals, [f"_b_{n}" for n in sums])
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = stored.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    summed = summed.join(F.broadcast(before), ["_part", *keys], "left")  # at most one row per range
    return summed.select(*df.columns, *[(F.col(f"_v_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums])


def lower_quantiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """sorted[int((n - 1) * p)] for each p (the lower index, no interpolation), plus min, mean, max, n.

    Distinct values are counted first, so copies cost nothing; their running counts bracket each wanted place.
    """
    value = F.col(column)
    counts = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("c"))
    placed = range_sums(counts, ["v"], {"upto": F.col("c")})
    total = placed.agg(
        F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
    )
    names = {p: f"p{int(p * 100)}" for p in fractions}
    at = lambda p: F.floor((F.col("n") - 1) * p)
    held = lambda p: (at(p) < F.col("upto")) & (at(p) >= F.col("upto") - F.col("c"))
    with_n = placed.join(F.broadcast(total.select("n")), how="cross")  # one row
    spread = with_n.groupBy().agg(*[F.max(F.when(held(p), F.col("v"))).alias(n) for p, n in names.items()])
    return total.join(spread, how="cross").select("n", "min", *names.values(), "mean", "max")
