import random
import re
import zlib
from collections import Counter

from netsift.llm import spelling as S


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, every):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}
    found, form = {}, {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        found[w] = (n, len(others))
    out = set()
    for w, (n, n_near) in found.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near, words.get(form[w])))
    return out


def result(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(rng, letters, count):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(count)]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]]
    return words


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = vocabulary(rng, "abÿç", 60) + vocabulary(rng, "abcdefghij", 30)
    rows = [(k, " ".join(rng.choice(words).title() for _ in range(80)) + rng.choice([".", "×÷ Łódź naïve"])) for k in range(60)]
    rows += [(None, None), (None, rows[0][1]), (5, ""), (5, rows[0][1]), (5, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' word", "1 n", "2 key", "3 shift")
    want = brute(rows, 7)
    assert len({r for r in want if r[1]}) > 50
    assert result(S.spelling_variants(docs, every=7)) == want
    monkeypatch.setattr(S, "GROUP", 3)
    assert result(S.spelling_variants(docs, every=7)) == want


def test_common_half_and_long_words(spark, monkeypatch):
    """All words share their first half, so the group of that chunk is dealt again by the other half."""
    monkeypatch.setattr(S, "GROUP", 8)
    rng = random.Random(1)
    tails = {"".join(rng.choice("abc") for _ in range(rng.choice([7, 7, 7, 8]))) for _ in range(500)}
    long = "z" * 5_000
    counts = {"commonhalf" + t: rng.randint(3, 40) for t in tails} | {long: 3, long + "a": 6, "b" + long: 5, "c" + long[1:]: 3, "y" * 5_002: 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = result(S.spelling_forms(words))
    for word, form, _, n, n_near, form_n in got:
        others = sorted((-counts[v], v) for v in counts if near(word, v))
        best = others[0] if others and -others[0][0] >= 2 * n else (None, None)
        assert (n, n_near, form, form_n) == (counts[word], len(others), best[1], best[0] and -best[0])
    assert len(got) == len(counts)


def test_chain_of_forms_and_no_rows(spark, no_documents, odd_documents):
    counts = {"aaaaa": 4, "aaaab": 8, "aaabb": 16, "aabbb": 32, "abbbb": 64, "zzzzz": 5}
    rows = {r.word: r.root for r in S.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert rows == {w: "zzzzz" if w == "zzzzz" else "abbbb" for w in counts}
    assert result(S.spelling_variants(no_documents)) == set()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert result(S.spelling_variants(odd_documents)) == brute(rows, 97)
