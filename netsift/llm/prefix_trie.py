"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns (role, text); it is named by two 64-bit keys, the exclusive or of hashes of
its turns and their places. Its members are the conversations that start with it. Totals over subtrees are summed so:

1. ``steps`` has one row per conversation and depth, ``nodes`` one per distinct prefix, with its parent. The number of nodes
   below a node comes from its members: each node belongs to its smallest member, whose nodes are the last ones of its path.
2. The tree is one component, named by its top. The centroid of a component is its lowest node that has at least half of the
   component's nodes below it. It splits off what hangs below it: each child is the top of a new component, what is left above
   stays. Every part has at most half of the nodes, so as many rounds as the logarithm of their number end it.
3. Before the split, what the component holds at and below its centroid is summed once and added to all nodes on the path
   from the centroid to the top. A node has its full total when it has been a centroid itself.
4. Components of more than ``PART`` nodes are split in rounds over the whole table, each written to the shared folder; a round
   knows one centroid per such component (nodes / PART at most). Smaller ones are dealt, many together, to tasks that go on
   with the same steps in arrays.

So neither a deep path nor a wide node costs more than a logarithm of passes. Paths are looked up in ``BAND`` depths at a time.
Turns are numbered and hashed along a conversation in two levels (ranges, then blocks of ``BAND`` turns), so one
conversation may hold a third of all rows. The members that end at a node are joined in blocks of ids, then hashed as a stream.

Turns sort by (turn, role, text), nulls first; null role or text is empty; repeated turns stay. Turns without conversation id
take no part. A conversation that ends up without turns is a member of the root. Very long texts are hashed whole.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.llm import registry
from netsift.llm.near_duplicates import Work
from netsift.operators.ranks import range_rank

SHARED_EVERY = 20
SHARED_TURNS = 4
PART = 16_384
BAND = 1_024
IDS = 1_024
LISTED = 100_000

NODE = ["k1", "k2"]
TOP = ["t1", "t2"]


def numbered_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, pos from 1, role, text) with nulls as empty texts."""
    text = lambda name: F.coalesce(turns[name].cast("string"), F.lit("")).alias(name)
    rows = turns.select(turns[id_col].cast("bigint").alias("conv_id"), turns["turn"].alias("turn"), text("role"), text("text"))
    ranked = range_rank(rows.where("conv_id is not null"), ["turn", "role", "text"], "pos", keys=["conv_id"])
    return ranked.select("conv_id", "pos", "role", "text")


def with_shared_heads(turns: DataFrame, every: int = SHARED_EVERY, most: int = SHARED_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their ``every`` ids, h being the id's crc32 modulo ``most``.

    Returns (conv_id, pos, role, text) and (conv_id, n), the latter with conversations that end up without turns.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base, h = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    shape = lengths.select("conv_id", "own", base.alias("base"), h.alias("h")).join(bases, "base", "left")
    shape = shape.withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    first = shape.join(heads, "base").where("pos <= head").select("conv_id", "pos", "role", "text")
    rest = turns.join(shape.select("conv_id", "h", "head"), "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "role", "text")
    sizes = shape.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint").alias("n"))
    return first.union(rest), sizes


def keyed_steps(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): the node at each depth, its parent and the words of its last text."""
    name = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    own = [F.xxhash64(name, F.lit(k), F.col("pos")).alias(f"g{k}") for k in (1, 2)]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")
    rows = turns.select("conv_id", F.col("pos").cast("bigint").alias("depth"), words, *own)
    rows = rows.withColumn("band", F.floor(F.col("depth") / BAND))
    over = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"in{k}": F.bit_xor(f"g{k}").over(over) for k in (1, 2)})
    bands = rows.groupBy("conv_id", "band").agg(*(F.bit_xor(f"g{k}").alias(f"b{k}") for k in (1, 2)))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # one row per BAND turns
    before = bands.select("conv_id", "band", *(F.coalesce(F.bit_xor(f"b{k}").over(earlier), F.lit(0)).alias(f"e{k}") for k in (1, 2)))
    keys = [F.col(f"e{k}").bitwiseXOR(F.col(f"in{k}")).alias(f"k{k}") for k in (1, 2)]
    keyed = rows.join(before, ["conv_id", "band"]).select("conv_id", "depth", "words", "g1", "g2", *keys)
    return keyed.select("conv_id", "depth", *NODE, *(F.col(f"k{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (1, 2)), "words")


def trie_nodes(steps: DataFrame, sizes: DataFrame, work: Work) -> DataFrame:
    """(k1, k2, p1, p2, conv_id, depth, n_convs, words, below): all nodes with their smallest member; the root has no parent."""
    inner = steps.groupBy(*NODE).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
    )
    inner = work.kept(inner)
    root = sizes.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("bigint")
    root = root.select(
        F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), none.alias("p1"), none.alias("p2"),
        "conv_id", F.lit(0).cast("bigint").alias("depth"), "n_convs", F.lit(0).cast("bigint").alias("words"),
    )
    owned = sizes.join(inner.groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned")), "conv_id", "left")
    owned = owned.select("conv_id", "n", (F.col("n") - F.coalesce("owned", F.lit(0))).alias("others"))
    at = steps.select("conv_id", "depth", *NODE).join(owned, "conv_id")
    below = at.groupBy(*NODE).agg(F.sum(F.col("n") - F.greatest(F.col("others"), F.col("depth") - 1)).alias("below"))
    all_ = owned.agg((F.sum(F.col("n") - F.col("others")) + 1).alias("below"))
    return work.kept(inner.join(below, NODE).unionByName(root.join(F.broadcast(all_), how="cross")))  # one row with one row


def listed(frame: DataFrame, rows: int = LISTED) -> DataFrame:
    """A list of a few numbers per row with a broadcast hint, if it is short."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def node_is(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a) == F.col(b) for a, b in zip(NODE, names, strict=True)))


def split_once(tree: DataFrame, big: DataFrame, steps: DataFrame, values: list[str], work: Work) -> DataFrame:
    """One round over the components ``big`` (t1, t2, size, top_depth): sums added along centroid paths, components split.

    ``tree`` has k1, k2, conv_id, depth, t1, t2 (its component; null once it has been a centroid), below, the values and their
    sums so far (``sum_`` and the name of the value).
    """
    heavy = tree.join(big, TOP).where("2 * below >= size")
    pick = F.min(F.struct("below", *NODE, "conv_id", "depth")).alias("c")
    cents = heavy.groupBy(*TOP).agg(pick, F.min("top_depth").alias("top_depth"))
    cents = work.kept(cents.select(
        *TOP, F.col("c.k1").alias("c1"), F.col("c.k2").alias("c2"), F.col("c.below").alias("c_below"),
        F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), "top_depth",
    ))
    few = listed(cents.select(*TOP, "c1", "c2", "c_depth"))
    through = work.kept(
        steps.join(few, node_is(["c1", "c2"])).select(F.col("conv_id").alias("m"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "c_depth")
    )
    root = few.where("c1 = 0 and c2 = 0")
    if not root.isEmpty():  # the root is no step: all conversations pass through it
        every = tree.select("conv_id").distinct().join(F.broadcast(root.limit(1)), how="cross")
        through = through.unionByName(every.select(F.col("conv_id").alias("m"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "c_depth"))
    next_ = through.withColumn("at", F.col("c_depth") + 1).join(
        steps.select(F.col("conv_id").alias("m"), F.col("depth").alias("at"), F.col("k1").alias("n1"), F.col("k2").alias("n2")), ["m", "at"], "left"
    )
    bands = F.explode(F.sequence(F.floor(F.col("top_depth") / BAND), F.floor(F.col("c_depth") / BAND))).alias("band")
    ways = listed(cents.select(F.col("c_conv").alias("conv_id"), "c_depth", "top_depth", bands))
    path = steps.withColumn("band", F.floor(F.col("depth") / BAND)).join(ways, ["conv_id", "band"])
    path = path.where("depth between top_depth and c_depth").select(F.col("k1").alias("w1"), F.col("k2").alias("w2"))
    path = path.unionByName(cents.where("top_depth = 0").select(F.lit(0).cast("bigint").alias("w1"), F.lit(0).cast("bigint").alias("w2")))
    marked = tree.join(next_.drop("at"), (F.col("conv_id") == F.col("m")) & (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    under = F.coalesce(F.col("depth") >= F.col("c_depth"), F.lit(False))
    marked = marked.join(path.distinct(), node_is(["w1", "w2"]), "left")
    marked = work.kept(marked.select(*tree.columns, under.alias("under"), F.col("w1").isNotNull().alias("way"), "n1", "n2"))
    totals = marked.where("under").groupBy(*TOP).agg(*(F.sum(v).alias(f"add_{v}") for v in values))
    totals = cents.join(totals, TOP).select(F.col("t1").alias("m1"), F.col("t2").alias("m2"), "c1", "c2", "c_below", *(f"add_{v}" for v in values))
    both = marked.join(listed(work.kept(totals)), (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    way = F.col("way") & F.col("c1").isNotNull()
    centre = F.coalesce(node_is(["c1", "c2"]), F.lit(False))
    name = lambda t, n: F.when(centre, None).when(F.col("under"), F.col(n)).otherwise(F.col(t)).alias(t)
    fresh = {"t1": name("t1", "n1"), "t2": name("t2", "n2"), "below": (F.col("below") - F.when(way & ~centre, F.col("c_below")).otherwise(0)).alias("below")}
    fresh |= {f"sum_{v}": (F.col(f"sum_{v}") + F.when(way, F.col(f"add_{v}")).otherwise(0)).alias(f"sum_{v}") for v in values}
    return work.kept(both.select(*(fresh.get(c, F.col(c)) for c in tree.columns)))


def preorder(parent: np.ndarray, depth: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of a forest's nodes so that each subtree of ``size`` nodes is contiguous; ``parent`` is -1 at tops."""
    place, order = np.zeros(len(parent), np.int64), np.argsort(depth, kind="stable")
    borders = np.flatnonzero(np.diff(depth[order], prepend=np.iinfo(np.int64).min))
    tops = np.flatnonzero(parent < 0)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    for a, z in zip(borders, [*borders[1:], len(order)], strict=True):
        rows = order[a:z]
        rows = rows[parent[rows] >= 0]
        rows = rows[np.argsort(parent[rows], kind="stable")]
        if len(rows):
            before = np.cumsum(size[rows]) - size[rows]
            first = np.flatnonzero(np.diff(parent[rows], prepend=-2))
            before -= np.repeat(before[first], np.diff([*first, len(rows)]))
            place[rows] = place[parent[rows]] + 1 + before
    return place


def centroid_sums(parent: np.ndarray, depth: np.ndarray, below: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of ``values`` in a forest of whole components, all components one step further in each round."""
    n = len(parent)
    size, place = below.copy(), preorder(parent, depth, below)
    whole, sums = below, [np.zeros(n, np.int64) for _ in values]
    top = np.flatnonzero(parent < 0)
    order = np.argsort(place)
    part = np.empty(n, np.int64)  # the component: the index of its top
    part[order] = top[np.argsort(place[top])][np.searchsorted(np.sort(place[top]), place[order], "right") - 1]
    live = np.arange(n)
    while len(live):
        held = np.zeros(n, np.int64)
        held[top] = size[top]
        heavy = live[2 * size[live] >= held[part[live]]]
        heavy = heavy[np.lexsort((place[heavy], size[heavy], part[heavy]))]
        cents = heavy[np.flatnonzero(np.diff(part[heavy], prepend=-1))]
        centre = np.full(n, -1, np.int64)
        centre[part[cents]] = cents
        c = centre[part[live]]
        under = (place[live] >= place[c]) & (place[live] < place[c] + whole[c])
        way = (place[live] <= place[c]) & (place[c] < place[live] + whole[live])
        for total, value in zip(sums, values, strict=True):
            found = np.zeros(n, np.int64)
            np.add.at(found, c[under], value[live[under]])
            total[live[way]] += found[c[way]]
        shrink = way & (live != c)
        size[live[shrink]] -= size[c[shrink]]
        is_centre = np.zeros(n, bool)
        is_centre[cents] = True
        tops = live[(parent[live] >= 0) & is_centre[np.maximum(parent[live], 0)] & (part[live] == part[np.maximum(parent[live], 0)])]
        tops = tops[np.lexsort((place[tops], part[tops]))]
        down = under & (live != c)
        if len(tops):
            at = np.searchsorted(part[tops] * n + place[tops], part[live[down]] * n + place[live[down]], "right") - 1
            part[live[down]] = tops[at]
        live = live[live != c]
        top = np.unique(part[live])
    return sums


def small_parts(tree: DataFrame, count: int, values: list[str]) -> DataFrame:
    """(k1, k2, sums): components of at most PART nodes, dealt by a hash of their names into groups of a few PART."""
    groups = max(1, -(-count // PART))
    dealt = tree.where("t1 is not null").withColumn("deal", F.pmod(F.xxhash64(*TOP), F.lit(groups)))
    columns = ["deal", *NODE, "p1", "p2", *TOP, "depth", "below", *values, *(f"sum_{v}" for v in values)]

    def work(table: pa.Table) -> pa.Table:
        get = {c: table.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in columns[1:]}
        node = np.rec.fromarrays([get["k1"], get["k2"]])
        up = np.rec.fromarrays([get["p1"], get["p2"]])
        order = np.argsort(node)
        at = np.minimum(np.searchsorted(node[order], up), len(node) - 1)
        parent = order[at]
        is_top = (get["k1"] == get["t1"]) & (get["k2"] == get["t2"])
        parent[is_top] = -1
        sums = centroid_sums(parent, get["depth"], get["below"], [get[v] for v in values])
        found = {f"sum_{v}": pa.array(get[f"sum_{v}"] + s) for v, s in zip(values, sums, strict=True)}
        return pa.table({"k1": pa.array(get["k1"]), "k2": pa.array(get["k2"])} | found)

    kinds = ", ".join(f"{c} bigint" for c in [*NODE, *(f"sum_{v}" for v in values)])
    return dealt.select(*columns).groupBy("deal").applyInArrow(work, kinds)


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], work: Work, part: int | None = None) -> DataFrame:
    """(k1, k2, sum_...): for each node the sums of its values over its subtree, itself included."""
    part = PART if part is None else part
    zero = F.lit(0).cast("bigint")
    tree = nodes.select(
        *NODE, "p1", "p2", "conv_id", "depth", zero.alias("t1"), zero.alias("t2"), "below", *values, *(zero.alias(f"sum_{v}") for v in values)
    )
    tree = work.kept(tree)
    while True:
        sizes = tree.where("t1 is not null").groupBy(*TOP).agg(F.count(F.lit(1)).alias("size"), F.min("depth").alias("top_depth"))
        big = work.kept(sizes.where(F.col("size") > part))
        if big.isEmpty():
            break
        tree = split_once(tree, listed(big), steps, values, work)
    sums = [f"sum_{v}" for v in values]
    return tree.where("t1 is null").select(*NODE, *sums).union(small_parts(tree, tree.count(), values).select(*NODE, *sums))


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ascending ids (conv_id) at each node, comma-joined.

    Ids are joined in blocks of IDS neighbouring numbers first; a task then streams the blocks of its nodes in order.
    """
    block = F.floor(F.col("conv_id") / IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*NODE, block.alias("block")).agg(ids.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (k1, k2) != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows(done)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], [*NODE, "ends_sha256"])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return ordered.mapInArrow(work, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, part: int | None = None) -> DataFrame:
    """One row per node of the conversations ``turns`` (conv_id, pos, role, text) of ``sizes`` (conv_id, n) turns."""
    work = Work(turns.sparkSession)
    sizes = work.kept(sizes)
    steps = work.kept(keyed_steps(turns))
    nodes = trie_nodes(steps, sizes, work)
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = work.kept(
        nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    )
    sums = work.kept(subtree_sums(nodes, steps, ["leaves", "saved"], work, part))
    last = steps.join(sizes, "conv_id").where("depth = n").select("conv_id", *NODE)
    turnless = sizes.where("n = 0").select("conv_id", F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"))
    ends = end_digests(last.union(turnless))
    up = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(up, ["p1", "p2"], "left").join(sums, NODE).join(ends, NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, id_col: str = "conv_id", part: int | None = None) -> DataFrame:
    """The trie of conversations with shared heads."""
    work = Work(conversations.sparkSession)
    turns, sizes = with_shared_heads(work.kept(numbered_turns(conversations, id_col)))
    return prefix_trie(turns, sizes, part)


SQL = r"""
with steps as (select list_transform(range(256), lambda k: list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, s: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
own as (select conv_id, coalesce(role, '') r, coalesce(text, '') x,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p from conversations where conv_id is not null),
ids as (select conv_id, m, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
    lambda k: ascii(substr(conv_id::varchar, k::int, 1))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 h from (select conv_id, max(p) m from own group by 1), steps),
shape as (select i.conv_id, i.h, least(i.h, coalesce(b.m, 0)) k from ids i left join ids b on b.conv_id = i.conv_id - i.conv_id % 20),
turns as (select s.conv_id, o.p, o.r, o.x from shape s join own o on o.conv_id = s.conv_id - s.conv_id % 20 and o.p <= s.k
  union all select s.conv_id, o.p - s.h + s.k, o.r, o.x from shape s join own o on o.conv_id = s.conv_id and o.p > s.h),
paths as (select conv_id, p d, list(sha256(length(r) || ':' || r || x)) over (partition by conv_id order by p) q, x from turns
  union all select conv_id, 0, [], '' from ids),
n as (select q, min(conv_id) conv_id, any_value(d) depth, count(*) n_convs, (count(*) - 1) * any_value(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) saved from paths group by 1),
l as (select conv_id, max(d) d from paths group by 1),
e as (select p.q, string_agg(conv_id::varchar, ',' order by conv_id) ids from paths p join l using (conv_id, d) group by 1),
c as (select q[1:len(q) - 1] q, count(*) c from n where depth > 0 group by 1),
s as (select a.q, count(*) filter (c.c is null) leaves, sum(b.saved) saved from n a join n b on b.q[1:a.depth] = a.q left join c on c.q = b.q group by 1)
select n.conv_id, n.depth, u.conv_id parent_conv_id, n.n_convs, coalesce(c.c, 0)::bigint n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens,
  sha256(coalesce(e.ids, '')) ends_sha256
from n join s on s.q = n.q left join e on e.q = n.q left join c on c.q = n.q left join n u on n.depth > 0 and u.q = n.q[1:n.depth - 1]
"""


@registry.query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared heads."""
    return rebuilt_trie(registry.table(spark, sf_dir, "conversations"))
