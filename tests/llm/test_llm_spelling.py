"""Spelling variants against all pairs of a small vocabulary, and the cases the docstring defines."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import spelling


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plainly(words):
    near = {w: [o for o in words if is_near(w, o)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    """Many words that differ by one letter, over few letters and over many, with chains of growing counts."""
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("ab"), int(n))) for n in rng.integers(6, 10, 250)}
    words |= {"".join(rng.choice(list("eényz"), int(n))) for n in rng.integers(6, 9, 150)}
    base = "tionanderzüge"
    words |= {base, base[1:], base[:-1], base + "n", "x" + base, base[:5] + base[6:], base[:5] + "ÿ" + base[6:], base[:4] + base[5] + base[4] + base[6:], "zzzzzz", "zzzzzzz", "zzzzzzzz"}
    return {w: int(rng.choice([5, 6, 25, 30, 125, 700, 4000])) for w in sorted(words)}


@pytest.mark.parametrize("frequent", [0, 20, 10**6])
def test_variants_equal_all_pairs(spark, vocabulary, frequent):
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    got = {tuple(r) for r in spelling.variants(words, frequent=frequent).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plainly(vocabulary)


@pytest.mark.parametrize("frequent", [0, 20, 10**6])
def test_near_words_share_the_grams_that_bounds_promise(spark, vocabulary, frequent):
    """No edit affects all grams of a word, and near words share at least the larger difference of number and most affected."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    extended, inner = spelling.gram_dictionary(words, frequent)
    known = {w: spelling.bounds(w, extended, inner) for w in vocabulary}
    assert all(n > most for n, most in known.values())

    def grams(w):
        d = spelling.Decomposed(w, extended, inner)
        return Counter(w[p : p + d.size[p]] for p in d.kept)

    for a in list(vocabulary)[::3]:
        for b in vocabulary:
            if is_near(a, b):
                assert sum((grams(a) & grams(b)).values()) >= max(n - most for n, most in (known[a], known[b])), (a, b)


def test_words_equal_a_plain_count(spark):
    rng = np.random.default_rng(5)
    own = ["information", "Straße", "élève×été", "größer", "abcdef", "abcde", "ÀÉÎÕÜß", "TIONAL"]
    texts = ["; ".join(str(x) for x in rng.choice(own, 200)) for _ in range(60)] + [None, "", " 12 ", "x" * 50_000, "日本語informationĀabcdef\x00TIONAL_größer"]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(3, texts[3], "k", 1), (None, texts[4], "k", 1)]
    expected = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    assert any(n < 30 for n in got.values())  # a planted misspelling is among them


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(docs)).collect() == []
