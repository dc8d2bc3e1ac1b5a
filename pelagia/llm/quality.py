"""Quality rules by repetition coverage.

Every text is one numpy job: words become integers, rolling hashes of several n-gram lengths are built one
from the other (h[n] = h[n-1] * B + next word), and sorting finds those that repeat. The share of word
characters inside n-grams seen before, and inside lines seen before, is the document's repetition coverage.
The DataFrame side is a single mapInArrow without any shuffle, so hot sources and large inputs split freely.

Defined results: a null text counts as having no words (it fails the base rule); an empty or blank text
likewise. Repeated rows and null ids give a row each. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import table

MIN_WORDS = 10
BASE_NGRAM = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: n-gram length -> largest share of word characters that may lie in n-grams seen before
LIMITS = {3: 0.30, 5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.30

BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in LIMITS)
)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = (x + BASE).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(hashes: np.ndarray, n: int, n_words: int, first_too: bool) -> np.ndarray | None:
    """Mask of the words inside windows found twice or more; None if there are none."""
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    if first_too:
        again[order[:-1][same]] = True
    edges = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> tuple:
    """All measures of one text, in the order of SCHEMA without the id."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if bare := line.strip():
            if line in seen:
                n_dup_lines += 1
                dup_chars += len(b"".join(bare.split()).decode("utf-8", "surrogatepass"))
            else:
                seen.add(line)
    n_repeat, coverage = 0, dict.fromkeys(LIMITS, 0.0)
    if n_words > min(*LIMITS, BASE_NGRAM):
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(index.__getitem__, words), np.uint64, n_words)
        mixed = _mix(ids)
        sizes = None
        rolled = mixed
        for n in range(2, min(max(LIMITS), n_words - 1) + 1):
            rolled = rolled[:-1] * BASE + mixed[n - 1 :]
            if n not in LIMITS and n != BASE_NGRAM:
                continue
            if n == BASE_NGRAM and (mask := _covered(rolled, n, n_words, True)) is not None:
                n_repeat = int(mask.sum())
            if n in LIMITS:
                mask = _covered(rolled, n, n_words, False)
                if mask is None:
                    if n >= BASE_NGRAM:
                        break  # without a repeated n-gram there is no longer one
                    continue
                if sizes is None:
                    sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in index), np.int64, len(index))[ids.astype(np.int64)]
                coverage[n] = float(sizes[mask].sum() / word_chars)
    line_coverage = dup_chars / word_chars if word_chars else 0.0
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    bad = line_coverage > LINE_LIMIT or any(coverage[n] > limit for n, limit in LIMITS.items())
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, not base_failed and not bad, line_coverage, *coverage.values())


def quality(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of measures and verdicts for each document."""
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(LIMITS))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    out = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
    return out if id_column == "doc_id" else out.withColumnRenamed("doc_id", id_column)


def keep(documents: DataFrame) -> DataFrame:
    """The rows of documents whose text passes; all columns as they were, no shuffle."""

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([measure(t)[6] for t in texts], dtype=bool)

    return documents.where(passes(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
