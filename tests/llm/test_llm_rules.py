"""Repetition rules against a plain reading of the text, and the cases the docstring defines."""

import re
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars"]


def covered(words, n):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    times = Counter(grams)
    return {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + n)}


def plainly(text):
    words = WORD.findall(text or "")
    size = sum(map(len, words))
    seen, lines, again = set(), 0, []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                again.append(line)
            seen.add(line)
    repeat = len(covered(words, 8))
    again_chars = sum(len(w) for line in again for w in WORD.findall(line))
    chars = {n: sum(len(words[k]) for k in covered(words, n)) for n in repetition.NGRAM_PERCENTS}
    base = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not (base or 100 * len(again) > 30 * lines or 100 * again_chars > 20 * size or any(100 * chars[n] > p * size for n, p in repetition.NGRAM_PERCENTS.items()))
    return (len(words), size, len(re.findall(r"[#*$%&|<>]", text or "")), len(again), repeat, base, kept, lines, again_chars, *chars.values())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    some = lambda n, k=400: [f"w{x}é" if x % 7 == 0 else f"w{x}" for x in rng.integers(0, k, n)]
    prose = [" ".join(some(int(rng.integers(1, 90)), k)) for k in (3, 6, 30, 400) for _ in range(12)]
    line = " ".join(some(9))
    at_limit = [f"a{i}" for i in range(70)] + [f"b{i}" for i in range(15)] * 2  # 30 of 100 words, two characters more or less
    return [
        *prose, None, "", " \t\n\r ", "one", "\n\n\n", f"{line}\n{line}\n{line} \n{' '.join(some(40))}", f"{line}\r\n{line}\r\n{line}", "#*$ %& |<> a\x00b a\x0bb c\x85d",
        " ".join(at_limit), "x " * 60_000, "A a " * 12, " ".join(["aa " * 3 + f"n{i}" for i in range(30)]), "日本 語 " * 15, "😀 é" * 20, "one\ntwo\none\n two\ntwo",
    ]


def test_counts_and_verdict_equal_a_plain_reading(spark, texts):
    rows = [(i, t, "x", 5, "k") for i, t in enumerate(texts)] + [(0, texts[0], "x", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed string, n_words int, key string").repartition(3)
    found = repetition.verdict(repetition.repetition(docs)).collect()
    assert len(found) == len(rows)
    names = [*COLUMNS, *(f"chars_{n}" for n in repetition.NGRAM_PERCENTS)]
    for r in found:
        assert tuple(r[c] for c in names) == plainly(texts[r.doc_id]), (r.doc_id, (texts[r.doc_id] or "")[:60])
        assert r.kept == (r.failed == "")


def test_steps_do_not_matter(texts):
    """Texts measured together and alone give the same: windows and lines never reach into the next text."""
    import pyarrow as pa

    lengths = tuple(repetition.NGRAM_PERCENTS)
    data, offsets = repetition.utf8(pa.array(texts))
    together = repetition.measure(data, offsets, lengths)
    for i, t in enumerate(texts):
        alone = repetition.measure(*repetition.utf8(pa.array([t], pa.string())), lengths)
        assert {k: v[0] for k, v in alone.items()} == {k: v[i] for k, v in together.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repetition.verdict(repetition.repetition(docs)).collect() == []
