import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netsift.llm import labels
from netsift.llm import language_model as M


def brute(rows, order, mu=M.MU):
    """Counts and recursive probabilities in plain Python."""
    lower = {k: k + 32 for k in range(65, 91)}
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    counts, total = Counter(), 0
    for (_, words), out in zip(texts, held, strict=True):
        if not out:
            seq = (0, *words, 1)
            total += len(seq) - 1
            counts.update(seq[a : a + k] for k in range(1, order + 1) for a in range(len(seq) - k + 1))
    distinct = len({k for k in counts if len(k) == 1} - {(0,)})

    def p(h, w):
        if not h:
            return (counts[(w,)] + 1) / (total + distinct + 1)
        return (counts[(*h, w)] + mu * p(h[1:], w)) / (counts[h] + mu)

    out = []
    for (i, words), own in zip(texts, held, strict=True):
        seq = (0, *words, 1)
        score = sum(math.log10(p(seq[max(0, k - order + 1) : k], seq[k])) for k in range(1, len(seq)))
        base = sum(math.log10(p((), w)) for w in seq[1:])
        out.append((i, own, len(seq) - 1, sum(counts[(w,)] > 0 for w in seq[1:]), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def found(frame, order, **how):
    held = labels.remainder(F.col("id"), M.FOLDS) == M.HELD_OUT
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in M.score_texts(frame, held, order=order, **how).collect()), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_is_brute_force(spark, documents, order):
    rows = [(r.doc_id, r.text) for r in documents.where("doc_id < 200").select("doc_id", "text").collect()]
    frame = documents.where("doc_id < 200")
    assert found(frame, order) == brute(rows, order)


def test_cuts_change_nothing(odd_documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    want = brute(rows, 3)
    assert found(odd_documents, 3) == want
    assert found(odd_documents, 3, block_bytes=3000, bucket_bytes=2000) == want
    monkeypatch.setattr(M, "SEGMENT", 7)
    assert found(odd_documents, 3) == want


def test_no_texts(no_documents, odd_documents):
    assert found(no_documents, 2) == []
    only_held = odd_documents.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2)
    rows = [(r.doc_id, r.text) for r in only_held.select("doc_id", "text").collect()]
    assert rows and found(only_held, 2) == brute(rows, 2)


def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = M.op3_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
