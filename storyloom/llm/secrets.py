"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Base spans come from three patterns (assignments, access keys, long hex). The method adds spans of kind
``random``: runs of key-like characters whose characters-per-token ratio under a byte-pair vocabulary is low.
Natural words and names reach three or more characters per token, random strings less than two. Known digests
(hex of a digest's length after a digest's name) and runs that are a UUID, with nothing beside it but a name, are
left out. Of a random run that overlaps base spans the parts outside them are added, but for a name before a mark.

Offsets are code points, ends exclusive. Null texts count as empty: no spans, the digest of an empty string.
Very long texts are scanned whole. Empty tables give no rows, repeated rows equal results; only the named
columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import lean, table, token_ranks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A candidate of the method: this many key-like characters, letters among them.
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CHARS_PER_TOKEN = 2.1
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:md5|sha-?\d+|sha|digest|checksum|etag|commit|integrity|blake\w*)\W{0,4}(?:\w{0,8}\W{0,2})$", re.IGNORECASE)
DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
PARTS = re.compile(r"[+/_=-]+")
KEYWORDS = ("passw", "secret", "token", "api")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def name(text: str, path: str) -> bool:
    """Whether all parts of a text are letters and words: one token, or few for their length."""
    parts = [p for p in PARTS.split(text) if p]
    return all(p.isalpha() and ((n := len(token_ranks(path).encode_ordinary(p))) == 1 or len(p) >= CHARS_PER_TOKEN * n) for p in parts)


def known(text: str, start: int, run: str, path: str) -> bool:
    """Whether a run is a digest that says so, or a UUID with at most a name beside it."""
    if UUID.search(run) and name(UUID.sub("=", run), path):
        return True
    return len(run) in DIGEST_SIZES and all(c in "0123456789abcdefABCDEF" for c in run) and bool(DIGEST.search(text[max(0, start - 24) : start]))


def random_spans(text: str, taken: list[tuple[int, int, int]], path: str, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    found = []
    for m in RANDOM.finditer(text):
        run = m[0]
        if not any(c.isalpha() for c in run) or known(text, m.start(), run, path):
            continue
        if len(run) >= chars_per_token * len(token_ranks(path).encode_ordinary(run)):
            continue
        at = m.start()
        for s, e in sorted((s, e) for s, e, _ in taken if s < m.end() and m.start() < e):
            if s > at and not (text[s - 1] in "+/_=-" and name(text[at:s], path)):
                found.append((at, s, 3))
            at = max(at, e)
        if at < m.end():
            found.append((at, m.end(), 3))
    return found


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """(key, base array, spans array) of every row; a span is kind:start:end."""
    path = path or vocabulary()

    def run(batches):
        for batch in batches:
            base, every = [], []
            for t in batch.column(1).to_pylist():
                own = base_spans(t or "")
                base.append(own)
                every.append(sorted(own + random_spans(t or "", own, path, chars_per_token), key=lambda s: (s[0], s[2])))
            count = lambda k: pa.array([sum(s[2] == k for s in own) for own in base], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array([named(b) for b in base]), pa.array([named(e) for e in every])], ["key", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {kind}, n_assign long, n_access long, n_hex long, base string, spans string").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars", mark: str = "[secret]", path: str | None = None) -> DataFrame:
    """docs with every span of the text replaced; the size column, if there is one, follows. Other columns stay."""
    path = path or vocabulary()
    names = docs.columns

    def clean(t: str) -> str:
        own = base_spans(t)
        spans = sorted(own + random_spans(t, own, path))
        out, at = [], 0
        for start, end, _ in spans:
            if end <= at:
                continue
            if start >= at:
                out += [t[at:start], mark]
            at = end
        return "".join([*out, t[at:]])

    def run(batches):
        for batch in batches:
            at = names.index(text)
            new = pa.array([None if t is None else clean(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = list(batch.columns)
            changed = pc.fill_null(pc.not_equal(new, batch.column(at).cast(pa.string())), False)
            columns[at] = new.cast(batch.schema.field(at).type)
            if size in names:
                i = names.index(size)
                columns[i] = pc.if_else(changed, pc.cast(pc.utf8_length(new), columns[i].type), columns[i])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are cut out of the texts; every document stays, repeated rows too.

    A null text stays null, an empty one empty; very long texts are scanned whole. ``n_chars``, if there is such a
    column, follows a changed text; all other columns stay, whatever their names. An empty table gives no rows.
    """
    return redact(docs)
