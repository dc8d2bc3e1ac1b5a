"""Best-fit packing of tokenised documents by length patterns.

Only lengths decide the packing, so the plan is made from the histogram of piece lengths (at most CAPACITY
rows, however many documents there are): patterns of one to three lengths that fill a sequence are
enumerated, non-negative least squares fits how often each is used, the counts are rounded down, and what is
left in the histogram is packed best-fit decreasing, still by length and count. The plan is a list of runs
(length, first rank) -> (first sequence, offset); each piece finds its place by its rank among the pieces of
its length. Ranks come from windows over (length, salt) whose size is bounded, plus the counts of the
salts before, so a length that a third of all rows share doesn't meet in one task.

Defined results: a null text counts as empty (its only token is the end id). Equal rows are packed each for
itself. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END_ID = 0
RANK_GROUP = 50_000
BATCH_TOKENS = 1 << 21
SWEEPS = 30
BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
BLANK_RUN = re.compile(r"\s{200}")
LONGEST_WORD = 500


class Encoder:
    """Ids of texts exactly as the tokenizers library gives them, as little-endian 32-bit bytes.

    The default tokenizer's vocabulary is also there as ranks for tiktoken, which gives the same ids several
    times faster. It takes texts of Latin letters without overlong words (its merging is quadratic in a word)
    and without anything like a special token; all other texts go through tokenizers itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        self.path = path
        self.quick = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Loaded with the first text that needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not BEYOND_LATIN.search(text)) and "<|" not in text and max(map(len, text.split()), default=0) <= LONGEST_WORD and not BLANK_RUN.search(text)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.quick is not None and self._plain(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return self._encode([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def pieces(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces of at most capacity tokens.

    row numbers the pieces by task and is one piece's own only once the result is written.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    ranks_path = None if tokenizer_path else public_tokenizers.path(RANKS)
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(path) or Encoder(path, ranks_path)
        _ENCODERS[path] = encode
        row = TaskContext.get().partitionId() << 40
        rows, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
                parts.clear()
            out = pa.RecordBatch.from_arrays(columns, names)
            rows.clear()
            held = 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text) + tail
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = data[4 * a : 4 * b]
                    rows.append((row, doc_id, i, a, b - a, zlib.crc32(part)))
                    if with_ids:
                        parts.append(part)
                    row, held = row + 1, held + b - a
                    if held >= BATCH_TOKENS:
                        yield flush()
        if rows:
            yield flush()

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def patterns(lengths: list[int], capacity: int, partners: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to three of these lengths (ascending) that fill the capacity as far as the lengths allow."""
    found = set()

    def largest(room: int) -> int | None:
        i = bisect.bisect_right(lengths, room)
        return lengths[i - 1] if i else None

    spread = lengths[:: max(1, len(lengths) // partners)]
    for a in lengths:
        b = largest(capacity - a)
        found.add((a,) if b is None else tuple(sorted((a, b))))
        for second in spread:
            if a + second <= capacity and (c := largest(capacity - a - second)) is not None:
                found.add(tuple(sorted((a, second, c))))
    return sorted(found, key=lambda p: (sum(p) - capacity, p), reverse=True)


def fit_counts(histogram: dict[int, int], shapes: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares of repeat counts to the histogram, by coordinate descent."""
    left = {k: float(v) for k, v in histogram.items()}
    counts = [0.0] * len(shapes)
    forms = [[(x, shape.count(x)) for x in set(shape)] for shape in shapes]
    norms = [sum(m * m for _, m in form) for form in forms]
    for _ in range(sweeps):
        moved = 0.0
        for i, form in enumerate(forms):
            step = max(-counts[i], sum(m * left[x] for x, m in form) / norms[i])
            if step:
                counts[i] += step
                moved += abs(step)
                for x, m in form:
                    left[x] -= m * step
        if moved < 0.5:
            break
    return counts


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over lengths with counts: (pattern, how many sequences have it)."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(room: int, shape: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([shape, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = order[i]
            shape, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            used = min(n, left)
            if n > used:
                put(room, shape, n - used)
            put(room - length, (*shape, length), used)
            left -= used
    return [(shape, n) for found in rooms.values() for shape, n in found]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences of which pattern hold exactly the histogram's pieces."""
    left = {k: v for k, v in histogram.items() if v}
    chosen = []
    if left.get(capacity):
        chosen.append(((capacity,), left.pop(capacity)))
    lengths = sorted(left)
    shapes = patterns(lengths, capacity)
    counts = fit_counts(left, shapes)
    for i in sorted(range(len(shapes)), key=lambda i: (-counts[i], i)):
        n = min(int(counts[i]), *(left[x] // shapes[i].count(x) for x in shapes[i]))
        if n > 0 and sum(shapes[i]) >= 0.999 * capacity:
            chosen.append((shapes[i], n))
            for x in shapes[i]:
                left[x] -= n
    return chosen + best_fit({k: v for k, v in left.items() if v}, capacity)


def runs(chosen: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (length << 40 | first rank), first sequences and offsets of the runs, by key."""
    used: dict[int, int] = {}
    found, sequence = [], 0
    for shape, n in chosen:
        offset = 0
        for length in shape:
            rank = used.get(length, 0)
            found.append((length << 40 | rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    found.sort()
    a = np.array(found, np.int64).reshape(-1, 3)
    return a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy()


def pack(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces with sequence_id and offset; ids are joined back by row at the end, so ranking doesn't move them."""
    parts = written(pieces(documents, tokenizer_path, capacity, end_id, with_ids), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    keys, sequences, offsets = runs(plan(histogram, capacity))
    salts = max(1, -(-max(histogram.values(), default=1) // RANK_GROUP))
    salted = parts.drop("ids").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64)
        i = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[i] + (key - keys[i]), "offset": offsets[i]})

    placed = ranked.withColumn("place", place("length", "rank"))
    # places are a hundredth of the ids, which so needn't be sorted
    placed = placed.hint("shuffle_hash").join(parts.select("row", "ids"), "row") if with_ids else placed
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"), *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
