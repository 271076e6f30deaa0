import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from netsift.llm import words

LOWER = {k: k + 32 for k in range(65, 91)}


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
def test_words_are_those_of_the_expressions(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for kind, form in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for _, _, w in words.column_words(pa.array(texts, pa.string()), kind, 20):
            found += [[w.word(k).decode() for k in range(w.rows[r], w.rows[r + 1])] for r in range(len(w.rows) - 1)]
        assert found == [re.findall(form, (t or "").translate(LOWER)) for t in texts]


def test_hash_depends_on_the_word_alone(monkeypatch):
    texts = pa.array(["aa bb cc aa", None, "x " * 50 + "bb", "abc" * 400])
    whole = [w.hashes.tolist() for _, _, w in words.column_words(texts)]
    monkeypatch.setattr(words, "HASH_BYTES", 7)
    cut = [w.hashes.tolist() for _, _, w in words.column_words(texts, size=5)]
    assert sum(whole, []) == sum(cut, [])
    assert whole[0][0] == whole[0][3] and len({*whole[0][:3]}) == 3


def test_shingle_sets():
    (_, _, w), = words.column_words(pa.array(["a b c d", "a b", "", "a b c a b c a b c"]))
    sets = words.shingle_sets(w, 3)
    assert [len(s) for s in sets] == [2, 1, 0, 3]
    assert sets[0][0] in sets[3] or sets[0][1] in sets[3]


def test_words_with_one_polynomial_have_different_hashes():
    """These two collide under any polynomial modulo a power of two."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 12))
    (_, _, w), = words.column_words(pa.array([one, one.translate({97: 98, 98: 97})]))
    assert len(set(w.hashes.tolist())) == 2
    a, b = words.shingle_sets(w, 3)
    assert a[0] != b[0]
