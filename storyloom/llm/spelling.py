"""Spelling variant grouping: a variable-length gram index over the vocabulary of a corpus.

1. Words. Runs of Latin letters of every text; of some runs, by a hash of document and run, one letter is taken out
   (a planted misspelling). Words are counted over all documents with a map-side combine.
2. Gram dictionary. Grams of 2 letters whose list of words is long are extended to 3; rare ones stay short. The
   dictionary comes down to the frequent pairs and the pairs that can end a longer gram. Both are sets of pairs
   of the pattern's 90 letters: at most 8100 entries, whatever the corpus, so they go to every task.
3. Decomposition. At every place of a word stands the longest gram of the dictionary; a gram inside the gram before it
   is left out.
4. Affected grams. An edit at one place can change only the grams that read that place, and of those after it the one
   that a new gram could swallow. These are neighbours; all grams before and after them stay, at the same
   distance from the word's start and end, in the other word too. ``bounds`` gives a word's number of grams and the most that one edit
   affects: two near words share at least as many grams as the larger difference of the two.
5. List merging. Two near words are in the lists of all unaffected grams of one edit. Reading the lists gram by gram and
   counting would read lists that grow with the vocabulary. Instead, a word is posted, for each edit place and kind,
   once under all its unaffected grams: the intersection of their lists. Short grams next to the edit are what keeps it selective.
6. Verification. Within a posting list, words are near if what precedes and what follows the edit is equal, the edit being at the
   first letter in which they differ. So each pair is found in one list only, and each list gives for each of its words a count and the best
   near word, never pairs.

A list holds words that agree but for at most 4 letters, so none grows with the corpus beyond the words there are.
Forms grow by a factor along a chain; roots are found by pointer jumping, in about log2 of the longest chain rounds.

Null and empty texts have no runs; very long texts are read whole; rows of one id are separate rows; a row without an id counts
as one with an empty id in the hash. Equal counts of near words fall to the smaller word in code-point order. An empty
table gives no words. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import lean, table, written

#: Letters of a run, after A-Z became a-z.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One letter goes where this divides the hash of document and run.
DROP = 199
LEAST_LETTERS, LEAST_TIMES = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: A pair of letters in more places of the vocabulary than this is extended by a third.
FREQUENT = 64


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of all words with that many letters and occurrences."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"),
    )
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (mark % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(mark % DROP == 0, without).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> tuple[frozenset[str], frozenset[str]]:
    """(pairs that are extended by a third letter, pairs that end such a longer gram)."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(3)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    # a word's last gram here is its last pair
    pairs = grams.groupBy(F.substring("gram", 1, 2).alias("pair")).agg(F.sum("n").alias("n")).filter(F.col("n") > frequent)
    extended = frozenset(r.pair for r in pairs.collect())
    ends = grams.filter(F.length("gram") == 3).select(F.substring("gram", 1, 2).alias("pair"), F.substring("gram", 2, 2).alias("end")).distinct()
    inner = frozenset(r.end for r in ends.collect() if r.pair in extended)
    return extended, inner


class Decomposed:
    """A word's variable grams: for each place, the gram's length, how many letters it reads, and whether it is kept."""

    def __init__(self, word: str, extended: frozenset[str], inner: frozenset[str]):
        n = self.length = len(word)
        pairs = [word[p : p + 2] for p in range(n - 1)]
        self.reads = [3 if pair in extended else 2 for pair in pairs]
        self.size = [min(r, n - p) for p, r in enumerate(self.reads)]
        self.kept = [p for p in range(n - 1) if not (p and self.size[p] == 2 and self.size[p - 1] == 3)]
        #: Kept grams that no new gram before them can swallow.
        self.firm = {p for p in self.kept if self.size[p] == 3 or pairs[p] not in inner}

    def before(self, edit: int) -> list[int]:
        """Kept grams that read only letters before the edit."""
        return [p for p in self.kept if p + self.reads[p] <= edit]

    def after(self, rest: int) -> list[int]:
        """Kept grams of the letters from ``rest`` on, which follow the edit, but for one that the edit can swallow."""
        return [p for p in self.kept if p > rest or p == rest and p in self.firm]

    def around(self, edit: int, rest: int) -> tuple[int, int]:
        """Where the unaffected grams before the edit end, and where those after it begin."""
        before, after = self.before(edit), self.after(rest)
        return max((p + self.size[p] for p in before), default=0), after[0] if after else self.length


def bounds(word: str, extended: frozenset[str], inner: frozenset[str]) -> tuple[int, int]:
    """(number of grams, most grams that one edit affects)."""
    d = Decomposed(word, extended, inner)
    edits = [(i, i + 1) for i in range(d.length)] + [(i, i) for i in range(d.length + 1)]
    return len(d.kept), max(len(d.kept) - len(d.before(i)) - len(d.after(rest)) for i, rest in edits)


def postings(word: str, extended: frozenset[str], inner: frozenset[str]) -> list[tuple[str, str, str, str, str]]:
    """(list, side, head, letter, tail) for each edit place: replaced (r), deleted (d, of the longer word), inserted (i, into the shorter)."""
    d, out = Decomposed(word, extended, inner), []
    n = d.length
    for i in range(n + 1):
        if i < n:
            a, b = d.around(i, i + 1)
            grams = f"{i},{word[:a]},{word[b:]}"
            head, letter, tail = word[:i], word[i], word[i + 1 :]
            out += [(f"r{n},{grams}", "r", head, letter, tail), (f"d{n - 1},{grams}", "d", head, letter, tail)]
        a, b = d.around(i, i)
        out.append((f"d{n},{i},{word[:a]},{word[b:]}", "i", word[:i], word[i : i + 1], word[i:]))
    return out


def posted(words: DataFrame, extended: frozenset[str], inner: frozenset[str]) -> DataFrame:
    """(list, side, head, letter, tail, n) of all words; a list is known by its hash, as verification compares all letters."""

    def run(batches):
        for batch in batches:
            rows = [(*p, n) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in postings(word, extended, inner)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.int64())], ["list", "side", "head", "letter", "tail", "n"])

    found = words.select("word", "n").mapInArrow(lean(run), "list string, side string, head string, letter string, tail string, n long")
    return found.withColumn("list", F.xxhash64("list"))


def _word(p: Column) -> Column:
    return F.concat(p["head"], F.when(p["side"] == "i", F.lit("")).otherwise(p["letter"]), p["tail"])


def near_words(posts: DataFrame) -> DataFrame:
    """(word, n_near, best struct of (-n, word)) of every word with a near one."""

    def near(a: Column, b: Column) -> Column:
        sides = ((a["side"] == "r") & (b["side"] == "r")) | ((a["side"] == "d") & (b["side"] == "i")) | ((a["side"] == "i") & (b["side"] == "d"))
        return sides & (a["letter"] != b["letter"]) & (a["head"] == b["head"]) & (a["tail"] == b["tail"])

    lists = posts.groupBy("list").agg(F.collect_list(F.struct("side", "head", "letter", "tail", "n")).alias("words")).filter(F.size("words") > 1)
    found = F.transform("words", lambda a: F.struct(_word(a).alias("word"), F.transform(F.filter("words", lambda b: near(a, b)), lambda b: F.struct((-b["n"]).alias("less"), _word(b).alias("form"))).alias("near")))
    each = lists.select(F.explode(F.filter(found, lambda x: F.size(x["near"]) > 0)).alias("x")).select("x.word", F.size("x.near").cast("long").alias("n_near"), F.array_min("x.near").alias("best"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form), by pointer jumping; a form occurs more often than its word, so there are no cycles."""
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(found.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, times: int = TIMES, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of the table (word, n)."""
    near = near_words(posted(words, *gram_dictionary(words, frequent)))
    joined = words.join(near, "word", "left").withColumn("most", -F.col("best.less"))
    formed = F.col("most") >= F.col("n") * times
    linked = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, F.col("most")).alias("form_n")), "spelling-linked")
    rooted = linked.join(roots(linked.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants among the words of all documents."""
    return variants(written(word_counts(table(spark, sf_dir, "documents")), "spelling-words"))


#: The hash, its table of 256 made by the rule, over the bytes of letters up to U+00FF; near words by the letters around each place.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM counted),
marked AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
changed AS (SELECT CASE WHEN h % {DROP} = 0 THEN substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM marked),
words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_TIMES}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
linked AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS at FROM linked UNION ALL SELECT c.word, l.form FROM chain c JOIN linked l ON c.at = l.word WHERE l.form IS NOT NULL)
SELECT l.word, l.form, c.at AS root, l.n, l.n_near, l.form_n FROM linked l JOIN chain c USING (word) JOIN linked e ON e.word = c.at AND e.form IS NULL
"""
