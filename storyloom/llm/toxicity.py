"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps homoglyphs and digit substitutions to plain letters, drops accents' combining marks and lower-cases;
then one Aho-Corasick pass finds lexicon entries at word beginnings. An entry is a whole word or a word's
beginning (``*`` at its end); at each word the longest match counts. A hit inside an exception phrase (the
words around it make it harmless) doesn't count. The sum of the hits' weights, normalised by length, goes
through a logistic curve, fitted on labelled texts, to a score from 0 to 1.

The lexicon is learned from labelled rows: a bounded sample (``sample_rows`` of each class) gives each
candidate's contexts, that is distinct neighbour words, in toxic and in clean texts. Support counts contexts,
not texts, so that many copies of one text prove no more than the one. Exception phrases are learned alike: a
neighbour that stands with an entry in clean texts only. The sample bounds what is learned; lexicon and exceptions
hold every entry that passes the tests, whatever their number.

Null and empty texts score as a text without hits. Very long texts are matched whole. Empty tables give no
rows, repeated rows equal scores; of several texts under one labelled id the smallest is learned from, of several
labels the largest counts. Limits include their own value, so ties at a limit pass alike. Without labelled rows of
both classes the lexicon is empty and all scores are next to 0. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import bounded_sample, held_out, lean, one_text, table, written

SAMPLE_ROWS = 3000
#: Least distinct contexts in toxic texts: this many, or this share of the toxic texts in the sample.
MIN_CONTEXTS = 5
MIN_SHARE = 0.006
#: Least ratio of toxic to clean contexts.
ODDS = 8
THRESHOLD = 0.3
PREFIX_LENGTHS = (4, 5, 6)

#: Homoglyphs of Latin letters in other scripts.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Digits and signs that stand for letters, within words only.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FOLDS = str.maketrans(HOMOGLYPHS)
SWAPS = str.maketrans(SUBSTITUTIONS)
FOREIGN = re.compile(r"[^\x00-\x7F]")
#: Combining marks, soft hyphens and characters without width.
INVISIBLE = re.compile("[\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE00-\uFE0F\uFE20-\uFE2F\u00AD\u061C\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F\uFEFF]")
SWAPPED = re.compile(r"[0-9@$!][^\W\d_]|[^\W\d_][0-9@$]")
#: A run of letters, digits, @ and $ with one of the latter three; ! counts between them, and apart before them.
MIXED = re.compile(r"(?<![^\W_])(?<![@$])(!?)((?:(?<=!)[^\W\d_]|[^\W\d_]*+(?:[0-9@$]|(?<=[^\W_])!(?=[^\W_]|[@$])))(?:[^\W_]|[@$]|!(?=[^\W_]|[@$]))*)")
LETTER = re.compile(r"[^\W\d_]")
#: Substitutions at a word's end: letters ("idio7"), or a number or sign behind it ("idiot1").
TAIL = re.compile(r"(?<=[^\W\d_])[013457@$]+$")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None, size: Callable[[str], int] | None = None) -> str:
    """Lower case, homoglyphs, accented letters and full-width forms to plain letters, digit substitutions inside mixed words.

    With ``size``, the length of the lexicon's longest match at a word, a word that can be read with or without its
    last substitutions, or a ! before it, is read as what matches longest.
    """
    text = (text or "").lower()
    if FOREIGN.search(text):
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).translate(FOLDS)
    if not SWAPPED.search(text):
        return text

    def read(m: re.Match) -> str:
        mark, run = m[1], m[2]
        if not LETTER.search(run):
            return m[0]
        full, stem = run.translate(SWAPS), TAIL.sub("", run).translate(SWAPS)
        if size is None:
            return mark + full
        return max([mark + stem, mark + full, *([f"i{stem}", f"i{full}"] if mark else [])], key=size)

    return MIXED.sub(read, text)


@dataclass
class Lexicon:
    words: dict[str, float]
    prefixes: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)  # (entry, neighbour word)
    intercept: float = -4.0
    by_sum: float = 1.0
    by_density: float = 1.0

    def machine(self) -> ahocorasick.Automaton:
        """Entries with a leading blank, as they stand in the padded text; an entry's value says what it is."""
        out = ahocorasick.Automaton()
        for name, weight in self.prefixes.items():
            out.add_word(" " + name, (name + "*", weight, len(name)))
        for name, weight in self.words.items():
            out.add_word(" " + name + " ", (name, weight, len(name)))
        if len(out):
            out.make_automaton()
        return out

    def hits(self, text: str | None, machine: ahocorasick.Automaton) -> tuple[float, int, int]:
        """Sum of weights, number of hits, number of words."""
        size = lambda word: max((n for _, (_, _, n) in machine.iter(f" {' '.join(WORD.findall(word))} ")), default=0) if len(machine) else 0
        words = WORD.findall(fold(text, size))
        if not words or not len(machine):
            return 0.0, 0, len(words)
        line = " " + " ".join(words) + " "
        best: dict[int, tuple[int, float, str]] = {}
        for end, (name, weight, size) in machine.iter(line):
            start = end - size - (not name.endswith("*"))
            if start not in best or size > best[start][0]:
                best[start] = (size, weight, name)
        total, n = 0.0, 0
        for start, (_, weight, name) in best.items():
            if self.exceptions:
                end = line.find(" ", start + 1)
                before, after = line[line.rfind(" ", 0, start) + 1 : start], line[end + 1 : max(end + 1, line.find(" ", end + 1))]
                if (name, before) in self.exceptions or (name, after) in self.exceptions:
                    continue
            total, n = total + weight, n + 1
        return total, n, len(words)

    def score(self, total: float, words: int) -> float:
        z = self.intercept + self.by_sum * min(total, 20.0) + self.by_density * min(10.0, 100 * total / (words + 50))
        return 1 / (1 + math.exp(-z))


def plain(word: str) -> int:
    """No lexicon yet: substitutions at a word's end are left off."""
    return 0


def candidates(words: list[str]) -> list[tuple[str, int]]:
    """Each word as an entry, and its beginnings, with the word's place."""
    return [(w, i) for i, w in enumerate(words)] + [(w[:k] + "*", i) for i, w in enumerate(words) for k in PREFIX_LENGTHS if len(w) > k]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")).filter(~held_out("k") & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Lexicon({}, {}, intercept=-20.0)
    picked = bounded_sample(marks.filter("y = 1"), "k", sample_rows, counts[1]).unionByName(bounded_sample(marks.filter("y = 0"), "k", sample_rows, counts[0]))
    # at most about 2 x sample_rows labels, so a broadcast; the texts they pick are written once and read by each step
    rows = written(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k"), "toxicity-rows")
    rows = written(one_text(rows, "k", "t").select("t", "y"), "toxicity-sample")

    def frequencies(batches):
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[int(y == 1)].update({c for c, _ in candidates(list(set(WORD.findall(fold(t, plain)))))})
            for y, own in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([y] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["entry", "y", "n"])

    by_entry = rows.mapInArrow(lean(frequencies), "entry string, y int, n long").groupBy("entry").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    scale = min(counts[0], sample_rows) / min(counts[1], sample_rows)
    least = max(MIN_CONTEXTS, MIN_SHARE * min(counts[1], sample_rows))
    kept = by_entry.filter((F.col("bad") >= max(2, least / 3)) & (F.col("bad") * scale >= ODDS * F.col("good")))
    names = {r["entry"] for r in kept.select("entry").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def contexts(batches):
        known = shared.value
        for batch in batches:
            found = set()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(fold(t, plain))
                found |= {(c, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "", words[i], int(y == 1)) for c, i in candidates(words) if c in known}
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int32() if j == 4 else pa.string()) for j in range(5)], ["entry", "before", "after", "word", "y"])

    seen = rows.mapInArrow(lean(contexts), "entry string, before string, after string, word string, y int")
    support = seen.groupBy("entry").agg(
        F.least(F.countDistinct(F.when(F.col("y") == 1, F.col("before"))), F.countDistinct(F.when(F.col("y") == 1, F.col("after")))).alias("bad"),
        F.countDistinct(F.when(F.col("y") == 0, F.struct("before", "after"))).alias("good"),
        F.countDistinct(F.when(F.col("y") == 1, F.col("word"))).alias("forms"),
    )
    chosen = support.filter((F.col("bad") >= least) & (F.col("bad") * scale >= ODDS * (F.col("good") + 0.5))).collect()
    weight = {r["entry"]: (math.log((r["bad"] * scale + 0.5) / (r["good"] + 0.5)), r["bad"], r["forms"]) for r in chosen}
    words = {e: w[0] for e, w in weight.items() if not e.endswith("*")}
    prefixes: dict[str, float] = {}
    for entry in sorted((e for e in weight if e.endswith("*")), key=len):  # a longer beginning adds nothing to a shorter one; one with a single form is that word
        if weight[entry][2] >= 3 and not any(entry[:k] in prefixes for k in range(1, len(entry) - 1)):
            prefixes[entry[:-1]] = weight[entry][0]
    lexicon = Lexicon(words, prefixes)
    lexicon.exceptions = _exceptions(seen, lexicon)
    return _calibrated(lexicon, rows)


def _exceptions(seen: DataFrame, lexicon: Lexicon, least: int = 3) -> set[tuple[str, str]]:
    """(entry, neighbour) pairs that at least ``least`` distinct clean contexts hold and no toxic text."""
    entries = [(e,) for e in [*lexicon.words, *(p + "*" for p in lexicon.prefixes)]]
    if not entries:
        return set()
    sides = seen.join(F.broadcast(seen.sparkSession.createDataFrame(entries, "entry string")), "entry", "left_semi")  # as many rows as the lexicon has entries
    both = sides.select("entry", F.col("before").alias("near"), F.col("after").alias("other"), "y").unionByName(sides.select("entry", F.col("after").alias("near"), F.col("before").alias("other"), "y"))
    found = both.filter("near <> ''").groupBy("entry", "near").agg(F.countDistinct(F.when(F.col("y") == 0, F.col("other"))).alias("good"), F.max("y").alias("y")).filter((F.col("y") == 0) & (F.col("good") >= least))
    return {(r["entry"], r["near"]) for r in found.collect()}


def _calibrated(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """The logistic curve over sum and density of the hits, by Newton steps on the sample."""
    got = _sums(rows.select(F.col("y").alias("key"), F.col("t").alias("text")), lexicon, "int").groupBy("key", "total", "words").count().toArrow()
    y = (got.column("key").to_numpy() == 1).astype(float)
    n = got.column("count").to_numpy().astype(float)
    total, words = got.column("total").to_numpy(), got.column("words").to_numpy()
    x = np.stack([np.ones(len(y)), np.minimum(total, 20), np.minimum(10, 100 * total / (words + 50))], axis=1)
    beta, ridge = np.zeros(3), np.diag([0.01, 0.5, 0.5])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    lexicon.intercept, lexicon.by_sum, lexicon.by_density = float(beta[0]), float(max(beta[1], 0.05)), float(max(beta[2], 0.0))
    return lexicon


def _sums(rows: DataFrame, lexicon: Lexicon, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        own = shared.value
        machine = own.machine()
        for batch in batches:
            found = [own.hits(t, machine) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([own.score(f[0], f[2]) for f in found], pa.float64())], ["key", "total", "hits", "words", "score"])

    return rows.mapInArrow(lean(run), f"key {kind}, total double, hits long, words long, score double")


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, total, hits, words, score) of every row."""
    return _sums(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), lexicon, dict(docs.dtypes)[key]).withColumnRenamed("key", key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
