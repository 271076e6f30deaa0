import random
import re

import pytest

from netsift.llm import decontamination as D


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def brute(docs, items, size):
    out = []
    for key, text in docs:
        w, hit, seen = words_of(text), set(), set()
        for item, passage in items:
            p = words_of(passage)
            windows = {tuple(p[a : a + size]) for a in range(max(len(p) - size + 1, 1))} if p else set()
            for window in windows:
                for a in range(len(w) - len(window) + 1):
                    if tuple(w[a : a + len(window)]) == window:
                        hit |= {*range(a, a + len(window))}
                        seen |= {str(item)} if item is not None else set()
        out.append((key, len(w), len(hit), sorted(seen)))
    return sorted(out, key=repr)


def found(docs, items, **how):
    rows = D.find_benchmark(docs, items, **how).collect()
    return sorted(((r[0], r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize("size, shingle, block", [(10, 3, 8 << 20), (4, 2, 200), (3, 5, 60), (1, 1, 100)])
def test_is_brute_force(spark, monkeypatch, size, shingle, block):
    """Few words, so windows repeat and overlap; also with several blocks, cut items and small expansions."""
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    monkeypatch.setattr(D, "EXPAND", 5)
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice(["a", "B", "c9", "é", "日本"]) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(k, text(rng.randint(0, 30))) for k in range(12)] + [(12, "a b"), (12, "B c9"), (3, None), (None, "a a a a"), (13, "..."), *[(14, "c9 é B")] * 9]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(40, None), (41, ""), (2, "a b"), (None, "a B c9")]
    passage = text(25)
    items.append((99, passage))
    docs += [(50 + k, text(5) + passage + text(3)) for k in range(5)]
    frames = [spark.createDataFrame(rows, f"{name} bigint, text string").selectExpr("*", "1 hits", "'x' items", "2 payload") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    assert found(*frames, size=size, shingle=shingle, block_bytes=block) == brute(docs, items, size)
    kept = D.drop_contaminated(*frames, size=size, shingle=shingle, block_bytes=block)
    assert kept.columns == frames[0].columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(docs, items, size) if not r[2]), key=repr)


def test_no_items_and_no_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r[2] == 0 for r in found(odd_documents, items))
    assert D.drop_contaminated(odd_documents, items).count() == odd_documents.count()
    assert found(no_documents, spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")) == []
