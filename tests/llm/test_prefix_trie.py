import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from netsift.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = {}, {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    children, leaves, saved = {}, {}, {}
    for q in sorted(members, key=len, reverse=True):
        leaves[q] = leaves.get(q, 0) or 1
        saved[q] = saved.get(q, 0) + (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
        if q:
            children[q[:-1]] = children.get(q[:-1], 0) + 1
            leaves[q[:-1]] = leaves.get(q[:-1], 0) + leaves[q]
            saved[q[:-1]] = saved.get(q[:-1], 0) + saved[q]
    sha = lambda q: hashlib.sha256(",".join(str(c) for c in sorted(ends.get(q, []))).encode()).hexdigest()
    return sorted(
        (min(m), len(q), min(members[q[:-1]]) if q else -1, len(m), children.get(q, 0), leaves[q], saved[q], sha(q)) for q, m in members.items()
    )


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def conversations(rng, n, turns):
    texts = ["a", "b c", "b  c\td", "", None, "É é"]
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(texts)) for c in range(n) for t in range(rng.choice([0, 1, turns, turns]))]
    return rows


def test_odd_conversations_in_rounds(spark, monkeypatch):
    """Components of over 6 nodes are split over the table, bands and blocks of ids are narrow."""
    for name, value in (("BAND", 3), ("IDS", 4)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(8)
    rows = conversations(rng, 130, 5) + [(None, 1, "user", "no id"), (7, None, None, "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, None, "tie")]
    rows += [(-3, 0, "user", "a"), (-21, 0, "user", "b c"), (-20, 0, "user", "a"), (1000, t := 0, "user", "a")] + [(1010, t, "user", "a") for t in range(40)]
    rows += [(2_000_000 + k, t, "user", "long " * 3) for k in range(0, 60, 20) for t in range(25)]
    frame = spark.createDataFrame(rows, KIND).selectExpr("*", "1 k1", "'x' depth", "2 pos", "3 t1", "4 _at", "5 n")
    want = brute(rows)
    assert got(P.rebuilt_trie(frame, part=6)) == want
    assert got(P.rebuilt_trie(frame)) == want
    assert any(r[0] == min(x[0] for x in rows if x[0] is not None) and r[1] == 0 for r in want)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 5, 7, 11)]  # without the base conversation some lose their turn
    assert any(not v for v in rebuilt(rows).values())
    frame = spark.createDataFrame(rows, KIND)
    assert got(P.rebuilt_trie(frame)) == brute(rows)
    assert got(P.rebuilt_trie(frame.limit(0))) == []
    nothing = spark.createDataFrame([(None, 1, "user", "x")], KIND)
    assert got(P.rebuilt_trie(nothing)) == []


def test_one_deep_conversation_among_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "BAND", 16)
    rows = [(0, t, "user", f"t{t}") for t in range(400)] + [(20 * c, t, "user", f"t{t}") for c in range(1, 60) for t in range(c % 4 + 1)]
    assert got(P.rebuilt_trie(spark.createDataFrame(rows, KIND), part=30)) == brute(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random", "comb"])
def test_centroid_sums(shape):
    rng = np.random.default_rng(2)
    n = 700
    parent = {
        "path": np.arange(n) - 1, "star": np.where(np.arange(n), 0, -1), "random": np.array([-1] + [rng.integers(0, k) for k in range(1, n)]),
        "comb": np.where(np.arange(n) % 2, np.arange(n) - 1, np.arange(n) - 2),
    }[shape]
    parent[0] = -1
    parent[350:] = np.where(parent[350:] < 350, -1, parent[350:])  # several components
    depth = np.zeros(n, np.int64)
    for k in range(n):
        depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else rng.integers(0, 5)
    order = rng.permutation(n)
    back = np.argsort(order)
    parent, depth = np.where(parent[order] >= 0, back[parent[order]], -1), depth[order]
    value = rng.integers(0, 100, n)
    want, size = value.copy(), np.ones(n, np.int64)
    for k in np.argsort(-depth, kind="stable"):
        if parent[k] >= 0:
            want[parent[k]] += want[k]
            size[parent[k]] += size[k]
    assert (P.centroid_sums(parent, depth, size, [value, np.ones(n, np.int64)])[0] == want).all()
    assert (P.centroid_sums(parent, depth, size, [np.ones(n, np.int64)])[0] == size).all()
