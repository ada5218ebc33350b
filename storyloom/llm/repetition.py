"""Quality rules: how much of a text stands in repeated word n-grams and repeated lines.

Words are runs without white space, as they are. A rolling hash gives the key of every window of n words from one
prefix sum, whatever n is: H(j, n) = (P[j + n] - P[j]) / B^j modulo 2^64, B odd. Windows of one text with equal keys
are copies of each other; the words under any of them, the first included, are covered, and their characters count
once for each n. A window of n words can only be a copy if the two windows of the next shorter length in it are, so
each length sorts only what the one before left. Lines are hashed alike; a line that holds a word and equals an
earlier one of its text is a duplicate.

A text fails if it has too few words, or more than a share of its word characters (or of its lines) is repeated.
The shares are whole percents. Those for lines are the published repetition rules'. Those for n-grams of 5 to 10 words
are twice the published ones, as these count a passage's later copies alone, and here its first one counts too.
Nothing depends on other texts, and nothing is learned. All is done in numpy over whole texts, several
texts a step; a step's texts are told apart by a part of the key.

Null and empty texts have no words: all counts are 0, and they fail for too few words. Very long texts are a step
of their own and read whole. Repeated rows give equal results, an empty table none; only the named columns are read,
so others may have any name. A share that is exactly the limit passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import AS_IS, MULTIPLIER, NOT_SPACE, byte_set, lean, mix, steps, table, utf8, word_hashes, word_spans

#: Fewest words of a text that may stay, and the length and most percent of the base rule.
LEAST_WORDS = 20
BASE_LENGTH, BASE_PERCENT = 8, 30
#: Most percent of word characters inside repeated windows of so many words.
NGRAM_PERCENTS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Most percent of the lines with a word that equal an earlier one, and of the word characters in those.
LINE_PERCENT, LINE_CHARS_PERCENT = 30, 20

SYMBOLS = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values between consecutive places of at."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Windows:
    """Rolling hashes over the words of several texts; ``at`` says where each text's words begin."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        self.size = len(hashes)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.last = at[1:][doc]
        self.salt = mix((doc + 1).astype(np.uint64))
        powers = np.cumprod(np.full(self.size, MULTIPLIER, np.uint64))
        self.prefix = np.zeros(self.size + 1, np.uint64)
        np.cumsum(hashes * powers, out=self.prefix[1:])
        self.unshift = np.cumprod(np.full(self.size, INVERSE, np.uint64))

    def copies(self, n: int, starts: np.ndarray) -> np.ndarray:
        """Those of the starts whose window of n words occurs again in the same text."""
        starts = starts[starts + n <= self.last[starts]]
        keys = mix((self.prefix[starts + n] - self.prefix[starts]) * self.unshift[starts] ^ self.salt[starts])
        return starts[repeated(keys)]

    def covered(self, n: int, starts: np.ndarray) -> np.ndarray:
        """Which words stand in a window of n words that begins at one of the starts."""
        edge = np.zeros(self.size + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + n, -1)
        return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of every text; ``chars_n`` are the word characters in repeated windows of n words."""
    begins, ends, at = word_spans(data, offsets, NOT_SPACE)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[begins]
    out = {"n_words": np.diff(at), "word_chars": sums(chars, at), "n_symbols": sums(SYMBOLS[data], offsets)}

    breaks = np.flatnonzero(data == 0x0A)
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))  # the end of a text ends its last line
    line_begins = np.sort(np.concatenate([breaks + 1, offsets[:-1]]))
    first, past = np.searchsorted(begins, line_begins), np.searchsorted(begins, line_ends)
    real = past > first
    line_begins, line_ends, first, past = line_begins[real], line_ends[real], first[real], past[real]
    line_doc = np.searchsorted(offsets, line_begins, "right") - 1
    keys = mix(word_hashes(data, line_begins, line_ends, AS_IS) ^ mix((line_doc + 1).astype(np.uint64)))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    line_chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
    n = len(offsets) - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[again], weights=(line_chars[past] - line_chars[first])[again], minlength=n).astype(np.int64)

    windows = Windows(word_hashes(data, begins, ends, AS_IS), at)
    starts, before = np.arange(len(begins)), 0
    for length in sorted({*lengths, BASE_LENGTH}):
        if before:  # a copy's first and last part of the shorter length are copies too
            held = np.zeros(len(begins) + length, bool)
            held[starts] = True
            starts = starts[held[starts + length - before]]
        starts, before = windows.copies(length, starts), length
        under = windows.covered(length, starts)
        if length in lengths:
            out[f"chars_{length}"] = sums(chars * under, at)
        if length == BASE_LENGTH:
            out["n_repeat_words"] = sums(under, at)
    return out


def repetition(docs: DataFrame, text: str = "text", key: str = "doc_id", lengths: tuple[int, ...] = tuple(NGRAM_PERCENTS)) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, dup_line_chars, n_repeat_words, chars_n of every length), all long."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"chars_{n}" for n in lengths)]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in steps(offsets):
                found = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[c], pa.int64()) for c in names)], ["key", *names])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, {', '.join(f'{c} long' for c in names)}").withColumnRenamed("key", key)


def _over(part: str, whole: str, percent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


def verdict(measured: DataFrame, ngram_percents: dict[int, int] | None = None) -> DataFrame:
    """measured with base_failed, the names of all failed rules, and kept."""
    rules = {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeat_words": _over("n_repeat_words", "n_words", BASE_PERCENT),
        "dup_lines": _over("n_dup_lines", "n_lines", LINE_PERCENT),
        "dup_line_chars": _over("dup_line_chars", "word_chars", LINE_CHARS_PERCENT),
    } | {f"ngrams_{n}": _over(f"chars_{n}", "word_chars", p) for n, p in (ngram_percents or NGRAM_PERCENTS).items()}
    failed = F.concat_ws(",", *(F.when(rule, F.lit(name)) for name, rule in rules.items()))
    return measured.withColumns({"base_failed": rules["few_words"] | rules["repeat_words"], "failed": failed}).withColumn("kept", F.col("failed") == "")


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict for every document."""
    found = verdict(repetition(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars", *(f"chars_{n}" for n in NGRAM_PERCENTS), "failed")


def _oracle() -> str:
    """The same counts by windows of words as strings; a chain of lead() makes one window function do for each length."""
    grams, covers, joins = [], [], []
    for n in NGRAM_PERCENTS:
        said = " || ' ' || ".join(f"lead(w, {k}) OVER p" if k else "w" for k in range(n))
        grams.append(f"g{n} AS (SELECT rid, i, {said} AS gram FROM words WINDOW p AS (PARTITION BY rid ORDER BY i))")
        twice = f"SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g{n} WHERE gram IS NOT NULL) WHERE n > 1"
        last = f"max(t.i) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        covers.append(f"c{n} AS (SELECT rid, sum(size)::BIGINT AS chars, count(*) AS words FROM (SELECT w.rid, w.size, {last} AS seen FROM words w LEFT JOIN ({twice}) t ON w.rid = t.rid AND w.i = t.i) WHERE seen IS NOT NULL GROUP BY rid)")
        joins.append(f"LEFT JOIN c{n} USING (rid)")
    chars = ", ".join(f"coalesce(c{n}.chars, 0) AS chars_{n}" for n in NGRAM_PERCENTS)
    rules = {"few_words": f"n_words < {LEAST_WORDS}", "repeat_words": f"100 * n_repeat_words > {BASE_PERCENT} * n_words"}
    rules |= {"dup_lines": f"100 * n_dup_lines > {LINE_PERCENT} * n_lines", "dup_line_chars": f"100 * dup_line_chars > {LINE_CHARS_PERCENT} * word_chars"}
    rules |= {f"ngrams_{n}": f"100 * chars_{n} > {p} * word_chars" for n, p in NGRAM_PERCENTS.items()}
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + ")"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, length(unnest(ws)) AS size FROM lists),
split AS (SELECT rid, string_split(text, chr(10)) AS ls FROM docs),
every_line AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
lines AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) AS k FROM every_line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
of_lines AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (k > 1)::BIGINT AS dup_line_chars FROM lines GROUP BY rid),
of_words AS (SELECT rid, count(*) AS n_words, sum(size)::BIGINT AS word_chars FROM words GROUP BY rid),
{", ".join(grams)},
{", ".join(covers)},
counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c{BASE_LENGTH}.words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {chars}
  FROM docs LEFT JOIN of_words USING (rid) LEFT JOIN of_lines USING (rid) {" ".join(joins)})
SELECT *, ({rules["few_words"]} OR {rules["repeat_words"]}) AS base_failed, {failed} AS failed, {failed} = '' AS kept FROM counted
"""


ORACLE = _oracle()
