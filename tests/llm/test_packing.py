import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsift.llm import packing as K

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def sound(rows, texts, size):
    """Every id lies in one piece, sequences have no gap, and little is padded; returns the padded share."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert {*pieces} == {*texts}
    for key, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    padded = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / total


@pytest.mark.parametrize("size, fan_in", [(2048, 64), (128, 2)])
def test_round_trip(documents, size, fan_in):
    part = documents.repartition(7, "doc_id") if fan_in == 2 else documents
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    assert sound(K.pack(part, size=size, fan_in=fan_in).collect(), texts, size) < 0.02


def test_odd_rows(odd_documents, no_documents):
    one = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in one.select("doc_id", "text").collect()}
    assert sound(K.pack(one).collect(), texts, 2048) == 0
    rows = K.pack(odd_documents).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) for r in odd_documents.select("text").collect())
    assert K.pack(no_documents).collect() == []


def test_strange_texts(spark):
    texts = [
        "it's they'RE I'll 'tis", "a<|endoftext|>b <|STARTOFTEXT|>", "é ́x Ķ", "no break　space\x1c\x85", "İstanbul ΣΑΣ ß ﬁ",
        "日本語 テスト 🙂🙂 12345", "...!!! a.b,c", "\x00\x01", "x" * 5000, "A a Aa aA",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sound(K.pack(frame).collect(), dict(enumerate(texts)), 2048) == 0


def test_memory_of_words_is_bounded(documents, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "REMEMBER", 50)
    monkeypatch.setattr(K.WordIds, "_made", {})
    texts = [r.text for r in documents.limit(30).collect()]
    got = list(K.document_ids(pa.array(texts), K.TOKENIZER))
    assert all(np.array_equal(a, ids_of(t)) for a, t in zip(got, texts, strict=True))
