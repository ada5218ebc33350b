"""A pluggable batch model stage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.Series], list[tuple[str | None, int, int, str | None]]]

#: What parts words; vertical tabs and the wide spaces of Unicode are parts of words.
SPACES = "\t\n\f\r\x1c\x1d\x1e\x1f \x85\xa0"
WORDS = re.compile(f"[^{SPACES}]+")
#: What Python's split, which is faster, parts besides.
SPLIT = [chr(c) for c in (0x0B, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
DIGIT = re.compile("[0-9]")
STAGED = pa.schema([("output", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())])


def model_stage(rows: DataFrame, key: str, text: str, model: Model, blank: str | None = None) -> DataFrame:
    """(key, output, input_tokens, output_tokens, error) in the rows' order; the model gives a tuple for each text.

    Null or blank texts aren't sent and cost nothing; a null one's output is null, a blank one's ``blank``. A failing row
    keeps its tokens, so its cost is billed, and goes to quarantine by its error. Keys stay as they are, nulls beside large numbers too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sent = [t is not None and t.strip(SPACES) != "" for t in texts]
            got = iter(model(pd.Series(texts, dtype=object)[sent]))
            staged = [next(got) if s else (None if t is None else blank, 0, 0, None) for t, s in zip(texts, sent, strict=True)]
            columns = [pa.array([r[i] for r in staged], kind) for i, kind in enumerate(STAGED.types)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *STAGED.names])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, output string, input_tokens long, output_tokens long, error string").withColumnRenamed("key", key)


def first_words(texts: pd.Series) -> list[tuple[str | None, int, int, str | None]]:
    """A deterministic stand-in for a model: the first five words; a text with a digit (0 to 9) in them fails."""
    out: list[tuple[str | None, int, int, str | None]] = []
    for text in texts:
        words = WORDS.findall(text) if any(c in text for c in SPLIT) else text.split()
        head = " ".join(words[:5])
        out.append((None, len(words), 5, "digit") if DIGIT.search(head) else (head, len(words), min(5, len(words)), None))
    return out
