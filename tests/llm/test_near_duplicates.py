import random
import re

import numpy as np
import pytest

from netsift.llm import near_duplicates as N


def brute(rows, shingle, percent):
    """All pairs of sets, by id; rows without id or words are alone."""
    lower = {k: k + 32 for k in range(65, 91)}
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(x for x in (least.get(root(k)), i) if x is not None) if i is not None else None
    out = [(i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def found(frame, **how):
    return sorted(((r[0], r[1], r[2], r[3]) for r in N.near_duplicates(frame, **how).collect()), key=repr)


def edited(words, share, rng):
    return [rng.choice("pqrstuv") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("bucket, chunk", [(4096, 256), (6, 5)])
def test_groups_chains_and_shared_passages(spark, monkeypatch, bucket, chunk):
    """Copies, edited copies around the threshold, chains, and texts that share one passage; also with tiny buckets."""
    monkeypatch.setattr(N, "BUCKET", bucket)
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "COLUMNS", 100 * chunk)
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    docs, passage = [], text(60)
    for n in (6, 9, 15, 40, 120, 400):
        base = text(n)
        docs += [base] * 3 + [edited(base, share, rng) for share in (0.01, 0.02, 0.03, 0.05, 0.05, 0.08) for _ in range(3)]
        chain = base
        for _ in range(6):
            chain = edited(chain, 0.02, rng)
            docs.append(chain)
    docs += [passage + text(rng.randint(5, 90)) for _ in range(40)]
    rng.shuffle(docs)
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(frame, shingle=3, percent=85) == brute(rows, 3, 85)


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(odd_documents) == brute(rows, 5, 80)
    assert N.near_duplicates(no_documents).collect() == []


def test_drop_keeps_one_of_each(odd_documents, no_documents):
    out = N.drop_near_duplicates(odd_documents)
    assert out.columns == odd_documents.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({*ids} - {None})
    assert {0, 1, 2, 8, 9} <= {*ids} and len({5, 6} & {*ids}) == 1
    assert N.drop_near_duplicates(no_documents).collect() == []


def test_estimate_is_fair():
    """Registers estimate the similarity of random sets without bias."""
    rng = np.random.default_rng(2)
    for size, level in ((30, 0.8), (300, 0.5), (3000, 0.9), (3000, 0.0)):
        errors = []
        for _ in range(40):
            both = int(2 * size * level / (1 + level))
            h = rng.integers(0, 2**64, 2 * size - both, dtype=np.uint64)
            one, two = np.sort(h[:size]), np.sort(h[size - both :])
            regs = N.sketch([one, two])
            n = np.array([size])
            errors.append(N.estimated(np.array([(regs[0] == regs[1]).sum()]), n, n)[0] - both / (2 * size - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def test_wide_buckets_are_dealt_whole(spark, monkeypatch):
    """No group of a wide bucket holds much more than BUCKET rows, and all pairs of fitting size from two components meet."""
    monkeypatch.setattr(N, "BUCKET", 40)
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 50, 60, 61, 75, 100, 101, 170, 200]) for _ in range(400)]
    names = [7 if k < 250 else 1000 + k // 2 for k in range(400)]
    rows = [(k, sizes[k], bytes(512)) for k in range(400)]
    classes = spark.createDataFrame(rows, "node bigint, n bigint, registers binary")
    bands = spark.createDataFrame([(1, k) for k in range(400)] + [(2, k) for k in range(240, 260)], "key bigint, node bigint")
    labels = spark.createDataFrame(list(enumerate(names)), "node bigint, label bigint")
    groups = {}
    for key, node, label, part in N.swept(bands, classes, labels, 85).select("key", "node", "label", "part").collect():
        assert label == names[node]
        groups.setdefault(key, []).append((node, part))
    assert max(map(len, groups.values())) <= 80
    met = {(a, b) for g in groups.values() for a, p in g for b, q in g if p != q or p < 0}
    wanted = {
        (a, b) for a in range(400) for b in range(400)
        if names[a] != names[b] and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])
    }
    assert wanted <= met


def test_one_other_class_leaves_no_whole_bucket(spark, monkeypatch):
    """A wide bucket of one component and a single class of another: rows stay in proportion, no group holds it whole."""
    monkeypatch.setattr(N, "BUCKET", 40)
    classes = spark.createDataFrame([(k, 100, bytes(512)) for k in range(800)], "node bigint, n bigint, registers binary")
    bands = spark.createDataFrame([(1, k) for k in range(800)], "key bigint, node bigint")
    labels = spark.createDataFrame([(k, 0 if k else 5) for k in range(800)], "node bigint, label bigint")
    rows = N.swept(bands, classes, labels, 85)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= 80
    assert 800 <= rows.count() <= 2 * 800


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80), (1, 60)])
def test_small_sets_lose_no_link(spark, shingle, percent):
    """Very short texts, most of them one or two edits from another, against all pairs; a third holds one common phrase."""
    rng = random.Random(shingle)
    phrase = "the same few words open each of these notes".split()
    docs = [[rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randint(1, 18))] for _ in range(120)]
    for _ in range(480):
        d = list(rng.choice(docs))
        where = rng.choice([0, len(d), rng.randint(0, len(d))])
        docs.append(d[:where] + [rng.choice("wxyz")] * rng.randint(0, 2) + d[where + rng.randint(0, 1) :])
    docs += [phrase[: rng.randint(5, 9)] + [f"n{rng.randint(0, 60)}" for _ in range(rng.randint(1, 3))] for _ in range(300)]
    rows = [(k, " ".join(d)) for k, d in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(frame, shingle=shingle, percent=percent) == brute(rows, shingle, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_partners_cover_every_link_of_a_small_set(percent):
    """Each pair of sizes that some link can have is listed on both sides, with the least common count that links."""
    assert N.exact_size(percent) == N.EXACT and 0 < N.exact_size(20) < N.EXACT
    for a in range(1, N.EXACT + 1):
        for b in range(a, 40):
            linked = [c for c in range(a + 1) if 100 * c >= percent * (a + b - c)]
            for n in (a, b):
                if n <= 100 * N.EXACT // percent:
                    assert [c for x, y, c in N.partners(n, percent) if (x, y) == (a, b)] == linked[:1]
            assert not linked or b <= 100 * N.EXACT // percent
