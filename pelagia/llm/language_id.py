"""Language identification, word first with backoff to character n-grams.

Training is a Spark aggregation of word counts by language over a sample of labelled documents, about
MAX_TRAIN_DOCS of them (chosen by a hash of the id) and of each language at least about MIN_LANG_DOCS, or all
where it has no more. All (language, word) pairs of that sample, and the character n-grams counted from
them in Spark, reach the driver as 64-bit hashes in Arrow columns. The model is broadcast (its size is bounded by the sample)
and prediction is one mapInArrow without a shuffle.

A known word adds its log frequency in each language. An unseen one is looked up by its character n-grams
of 5, then 4, 3, 2 and 1 letters, at the first length of which any n-gram is known.

Words of any length are learned; scripts that write no blanks have runs of letters without end, which are known by their n-grams.

Defined results: a null text or one without letters gives ``und`` with score 0. Text of which nothing is
known gives the most frequent language with score 1 / number of languages. Without any labelled document
every text is ``und``. Ties go to the language that is more frequent in training, then by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import crc_remainder, table, written

MAX_TRAIN_DOCS = 8_000
MIN_LANG_DOCS = 200
MEMO_CHARS = 40
TEXTS_AT_ONCE = 64
PIECE = 64
NGRAM_LENGTHS = (5, 4, 3, 2, 1)
UNDETERMINED = "und"
MEMO_ENTRIES = 100_000
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, lang_pred string, score double"


def words_of(lowered: str) -> Counter:
    """Maximal runs of letters (Unicode category L) with their numbers, as training has them."""
    words = Counter(WORD.findall(lowered))
    for odd in [w for w in words if not w.isalpha()]:  # other numerals, such as fractions and Roman ones, are no letters
        n = words.pop(odd)
        for part in "".join(c if c.isalpha() else " " for c in odd).split():
            words[part] += n
    return words


def key_of(text: str) -> int:
    """The 64-bit key of a word or n-gram, as Spark's xxhash64 gives it."""
    key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return key - (1 << 64) if key >> 63 else key


class Table:
    """Log frequencies by language (columns) of keys, which are sorted: a few bytes each, in arrays that workers give back."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        self.keys, row = np.unique(keys, return_inverse=True)
        matrix = np.full((len(self.keys), langs), 0.5)
        np.add.at(matrix, (row, lang), n)
        self.logs = np.log(matrix / matrix.sum(axis=0)).astype(np.float32) if len(matrix) else matrix.astype(np.float32)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's row, and whether it is known."""
        asked = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts), np.uint64, len(texts)).view(np.int64)
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return at, self.keys[at] == asked

    def rows(self, texts: list[str]) -> np.ndarray:
        """Rows of those that are known."""
        at, known = self.find(texts)
        return at[known]


class Model:
    """The languages, most frequent first, and the tables of words and of the n-grams of each length."""

    def __init__(self, words: pa.Table, grams: pa.Table):
        """words are (lang, key, n), grams (lang, key, size, n)."""
        names, lang = self._numbers(words.column("lang"))
        total = np.bincount(lang, words.column("n").to_numpy(), len(names)) if names else []
        self.langs = [name for _, name in sorted(zip(total, names, strict=True), key=lambda x: (-x[0], x[1]))]
        place = np.array([self.langs.index(name) for name in names], np.int64)
        self.words = Table(words.column("key").to_numpy(), place[lang], words.column("n").to_numpy(), len(names))
        names, lang = self._numbers(grams.column("lang"))
        place = np.array([self.langs.index(name) for name in names], np.int64)
        sizes, keys, n = (grams.column(c).to_numpy() for c in ("size", "key", "n"))
        self.grams = [Table(keys[sizes == k], place[lang[sizes == k]], n[sizes == k], len(self.langs)) for k in NGRAM_LENGTHS]

    @staticmethod
    def _numbers(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
        """The distinct values and each row's place among them."""
        coded = column.combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)

    def of_words(self, words: list[str]) -> np.ndarray:
        """Known words' log frequencies, else the mean of the n-grams of the first length of which any is known."""
        at, known = self.words.find(words)
        logs = np.zeros((len(words), len(self.langs)), np.float32)
        logs[known] = self.words.logs[at[known]]
        open_ = np.flatnonzero(~known)
        marked = [f"<{words[i]}>" for i in open_]
        for level, n in zip(self.grams, NGRAM_LENGTHS, strict=True):
            if not marked:
                break
            counts = np.array([max(0, len(m) - n + 1) for m in marked])
            at, hit = level.find([m[j : j + n] for m, k in zip(marked, counts.tolist(), strict=True) for j in range(k)])
            owner, at = np.repeat(np.arange(len(marked)), counts)[hit], at[hit]
            hits = np.bincount(owner, minlength=len(marked))
            done = hits > 0
            if done.any():
                starts = np.concatenate(([0], np.cumsum(hits[done])[:-1]))
                logs[open_[done]] = np.add.reduceat(level.logs[at], starts, axis=0) / hits[done][:, None]
            open_, marked = open_[~done], [m for m, d in zip(marked, done.tolist(), strict=True) if not d]
        return logs


class Predictor:
    """Predicts texts; remembers the log frequencies of up to MEMO_ENTRIES words as rows of one table."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.logs = np.zeros((MEMO_ENTRIES, len(model.langs)), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.many([text])[0]

    def many(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; new words of TEXTS_AT_ONCE texts are looked up together."""
        texts, out = list(texts), []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            counted = [words_of(t.lower()) if t else Counter() for t in texts[start : start + TEXTS_AT_ONCE]]
            if self.model.langs:
                self._remember(counted)
            out += map(self._of, counted)
        return out

    def _remember(self, counted: list[Counter]) -> None:
        short = lambda: {w for words in counted for w in words if w not in self.memo and len(w) <= MEMO_CHARS}
        fresh = short()
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo.clear()
            fresh = short()
        fresh = list(fresh)[:MEMO_ENTRIES]  # the rest is looked up again where it stands
        if fresh:
            first = len(self.memo)
            self.logs[first : first + len(fresh)] = self.model.of_words(fresh)
            self.memo.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def _of(self, words: Counter) -> tuple[str, float]:
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        at = np.fromiter((self.memo.get(w, -1) for w in words), np.int64, len(words))
        times = np.fromiter(words.values(), float, len(words))
        scores = times[at >= 0] @ self.logs[at[at >= 0]]
        if (at < 0).any():
            rest = [(w, n) for (w, n), r in zip(words.items(), at.tolist(), strict=True) if r < 0]
            scores = scores + np.array([n for _, n in rest], float) @ self.model.of_words([w for w, _ in rest])
        best = int(np.argmax(scores))
        # the evidence of many words is not independent: its weight grows with the root of their number
        odds = np.exp((scores - scores[best]) / math.sqrt(words.total()))
        return self.model.langs[best], float(1 / odds.sum())


def fit(documents: DataFrame, training: Column | None = None, max_docs: int = MAX_TRAIN_DOCS, min_lang_docs: int = MIN_LANG_DOCS) -> Model:
    """Learns from the rows with a language and text that training (a condition) admits."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if training is not None:
        rows = rows.where(training)
    by_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    n = sum(by_lang.values())
    if n > max_docs:
        # a language with few rows gives all of them
        every = 1 << 30
        shares = {lang: min(1.0, max(max_docs / n, min_lang_docs / m)) for lang, m in by_lang.items()}
        limit = F.lit(int(every * max_docs / n))
        raised = {lang: share for lang, share in shares.items() if share > max_docs / n}
        if raised:
            limit = F.coalesce(F.create_map(*(F.lit(x) for lang, share in raised.items() for x in (lang, int(every * share))))[F.col("lang")], limit)
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(every)) < limit)
    counts = (
        rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("key"))
        .groupBy("lang", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return learned(written(counts, "language-words"))


def learned(counts: DataFrame) -> Model:
    """A model of word counts (lang, key, n); n-grams are counted here, from the words between brackets."""
    marked = counts.select("lang", "n", F.concat(F.lit("<"), "key", F.lit(">")).alias("marked"))
    # long runs go in pieces, each with the n-grams that start in its first PIECE letters, so that a run costs what its length does
    piece = F.transform(F.sequence(F.lit(1), F.length("marked"), F.lit(PIECE)), lambda i: F.substring("marked", i, F.lit(PIECE + max(NGRAM_LENGTHS) - 1)))
    pieces = marked.select("lang", "n", F.explode(piece).alias("piece"))
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("piece") - k + 1)), lambda i: F.substring("piece", i, F.lit(k)))
    long_enough = [F.when(F.length("piece") >= k, of_length(k)).otherwise(F.array().cast("array<string>")) for k in NGRAM_LENGTHS]
    grams = pieces.select("lang", "n", F.explode(F.concat(*long_enough)).alias("key")).where(~F.col("key").isin("<", ">"))
    grams = grams.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return Model(counts.select("lang", F.xxhash64("key").alias("key"), "n").toArrow(), grams.select("lang", F.xxhash64("key").alias("key"), F.length("key").alias("size"), "n").toArrow())


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(shared.value)
        for batch in batches:
            found = predict.many(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(documents: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """The rows in a recognisable language, with all their columns as they were."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def recognised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = Predictor(shared.value)
        for texts in batches:
            found = predict.many(texts)
            yield pd.Series([lang != UNDETERMINED and score >= min_score for lang, score in found], dtype=bool)

    return documents.where(recognised(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, crc_remainder(F.col("doc_id"), 3) != 1)
    found = identify(documents, model)
    return found.select("doc_id", (F.coalesce(crc_remainder(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
