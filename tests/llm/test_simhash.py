import random

import numpy as np
import xxhash

from netsift.llm import simhash as S

LOWER = {k: k + 32 for k in range(65, 91)}


def plain(text):
    found = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))]
    if not found:
        return 0
    shingles = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, distance=3):
    """The smallest index of each code's component, by all pairs."""
    codes, label = np.array(codes, np.uint64), np.arange(len(codes))
    for k in range(len(codes)):
        near = set(label[np.bitwise_count(codes ^ codes[k]) <= distance].tolist())
        label[np.isin(label, list(near))] = min(near)
    return label.tolist()


def dense_codes(rng, n):
    """Families of close codes, and a cube of codes that agree in most bits."""
    heads = [rng.getrandbits(64) for _ in range(n // 10)]
    codes = [rng.choice(heads) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for _ in range(n // 2)]
    far = rng.getrandbits(64) >> 24 << 24
    return [c & (1 << 64) - 1 for c in codes] + [far | rng.getrandbits(24) for _ in range(n // 2)]


def expected(rows):
    """(doc_id, fingerprint, component_id) by all pairs of rows."""
    codes = [plain(t) for _, t in rows]
    linked = [k for k, (i, _) in enumerate(rows) if i is not None]
    label = dict(zip(linked, classes([codes[k] for k in linked]), strict=True))
    least = {}
    for k, c in label.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted(((i, f"{codes[k]:016x}", least[label[k]] if k in label else None) for k, (i, _) in enumerate(rows)), key=str)


def got(frame):
    assert frame.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_fingerprint(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one two", "A b\x0bC", "é É x y z", " ".join(rng.choice("abc") for _ in range(5_000))]
    want = [plain(t) for t in texts]
    assert [S.fingerprint(t) for t in texts] == want and want[:3] == [0, 0, 0]
    monkeypatch.setattr(S, "BLOCK", 7)
    assert [S.fingerprint(t) for t in texts] == want


def test_index_finds_all_pairs(monkeypatch):
    rng = random.Random(3)
    codes = np.array(sorted(set(dense_codes(rng, 1_500))), np.uint64)
    rng_np = np.random.default_rng(1)
    group = np.sort(rng_np.integers(0, 4, len(codes)))
    order = np.lexsort((S.gray_rank(codes), group))
    index = S.GrayIndex(codes[order], group[order])
    i, j = index.near(np.arange(len(codes)), 3)
    c, g = codes[order], group[order]
    a, b = np.nonzero((np.bitwise_count(c[:, None] ^ c) <= 3) & (g[:, None] == g))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y}
    assert len(index.levels) == 3 and len(i) > 500
    monkeypatch.setattr(S, "FRONTIER", 50)
    first = [set(map(tuple, np.stack(S.batch_links(codes, np.stack([np.zeros_like(group), np.zeros_like(group)], 1), 3), 1).tolist()))]
    label = classes(codes.tolist())
    at = {int(x): k for k, x in enumerate(codes.tolist())}
    assert all(label[at[x]] == label[at[y]] for x, y in first[0]) and len(first[0]) == len(codes) - len(set(label))


def test_gray_rank_counts_gray_codes():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_wide_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 32)
    rng = random.Random(6)
    codes = sorted(set(dense_codes(rng, 2_000)))
    frame = spark.createDataFrame([(S.signed(c),) for c in codes], "code bigint")
    work = S.Work(spark)
    labels = {r.node: r.label for r in S.components(S.near_codes(frame, work, 3), work).collect()}
    want = classes(codes)
    by_label = {}
    for c, w in zip(codes, want, strict=True):
        by_label.setdefault(labels.get(S.signed(c), S.signed(c)), set()).add(w)
    assert all(len(s) == 1 for s in by_label.values()) and len(by_label) == len(set(want))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(S.op13_simhash(spark, folder)) == expected(rows)


def test_odd_and_no_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert got(S.near_duplicates(odd_documents)) == expected(rows)
    assert got(S.near_duplicates(no_documents)) == []
