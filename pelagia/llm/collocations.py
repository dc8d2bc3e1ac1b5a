"""Phrases that occur far more often than their parts would by chance, by language.

Words are counted first. Each word of a language is then known by a 64-bit hash, of which it is proved over all counted
words that no frequent one shares it (else the next hash is taken), and texts are written once as hashes of
frequent words, with everything else as breaks. Which words are frequent is told by a bitmap of at most
2 ** BITMAP_BITS bits (16 MB): what it lets through too many is counted and then dropped.

A phrase is a candidate if all its pairs can be frequent, by sums over fingerprints of 64 bits that are never less than the pairs'
own, and if tasks have seen it often enough together, which keeps tries small. While tasks are fewer than the least count, each keeps
back what it has seen a few times only, so most rare phrases are never moved. Candidates go, in shards of at most about
TRIE_PHRASES, into double-array tries. Each is broadcast in turn, and a task moves the states of all positions of its texts one
level at a time and adds up accepting states; Spark sums the tasks. More candidates mean more tries, not larger ones. Shards are
by the first two words, so a place in a text is walked in one trie only, however many there are.
Scores, cuts and the phrases that longer ones stand for are joins and aggregations in decimals of 38 digits.

Defined results: null and empty texts have no words; a null language counts as `und`. Rows that repeat count each time. Null and
repeated ids don't matter, as ids are not read, nor are other columns. Texts of any length are counted whole. Ties
are broken by count, then by the phrase's bytes. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import table, written
from pelagia.llm.word_trie import Trie

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
BITMAP_BITS, BITS_EACH = 27, 256
TRIE_PHRASES = 1 << 19
SUM_BLOCK, SUM_SALTS = 1024, 256
HELD_PHRASES = 1 << 21
MEMO_WORDS = 200_000
BATCH_CODES, BATCH_TEXTS = 3_000_000, 1_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(BREAKS) + b" ")
MASK = (1 << 64) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)
CODES = [f"c{i}" for i in range(1, MAX_WORDS + 1)]
Sums = dict[int, tuple[np.ndarray, np.ndarray]]


def tokens(text: str) -> list[bytes]:
    """Words in order, with a line feed for each run of breaks, also at both ends."""
    return [b"\n", *(w for w in text.encode("utf-8", "surrogatepass").translate(FOLDED).replace(b"\n", b" \n ").split(b" ") if w), b"\n"]


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 * BATCH_TEXTS):
            by_lang: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang[lang].update(tokens(text))
            for lang, counts in by_lang.items():
                counts.pop(b"\n", None)
                words = pa.array(counts.keys(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])

    counts = documents.mapInArrow(run, "lang string, word binary, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed(words: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """Words with a code that no frequent word shares with any other, and the hash's seed."""
    for attempt in range(8):
        coded = words.withColumn("code", F.xxhash64(F.lit(attempt), "lang", "word"))
        alike = coded.groupBy("code").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
        if alike.where((F.col("words") > 1) & (F.col("n") >= min_count)).isEmpty() and coded.where((F.col("n") >= min_count) & (F.col("code") == 0)).isEmpty():
            return coded, words.sparkSession.range(1).select(F.xxhash64(F.lit(attempt))).first()[0] & MASK
    raise RuntimeError("no hash without collisions")


def fingerprint(codes: np.ndarray) -> np.ndarray:
    """64 bits for single words' codes."""
    return codes.view(np.uint64) * MIX


def extended(prints: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases from those of all words but the last, and the last one's codes."""
    mixed = (prints ^ (prints >> np.uint64(29))) + codes.view(np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))) * MIX


class Bitmap:
    """Which fingerprints are in a set, by their first bits; tells of some others that they are, too."""

    def __init__(self, prints: DataFrame, n: int):
        """prints: one column of n fingerprints."""
        self.bits = min(BITMAP_BITS, max(15, (BITS_EACH * n).bit_length()))
        place = F.shiftrightunsigned("print", 64 - self.bits)
        parts = prints.toDF("print").groupBy(F.bitmap_bucket_number(place + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("map"))
        self.map = np.zeros((1 << self.bits) // 8, np.uint8)
        for row in parts.toLocalIterator():  # 4 KB each, 16 MB together at most
            start = (row["part"] - 1) * 4096
            self.map[start : start + 4096] = np.frombuffer(row["map"], np.uint8)

    def has(self, prints: np.ndarray) -> np.ndarray:
        places = (prints >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.map[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def encode(documents: DataFrame, seed: int, frequent: Bitmap) -> DataFrame:
    """(codes array<long>) of each text: runs of two or more frequent words, a zero after each."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        memos: dict[str, dict[bytes, int]] = {}
        for batch in slices(batches):
            parts, lengths = [], []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                memo = memos.setdefault(lang, {})
                words = tokens(text)
                fresh = [w for w in set(words) if w not in memo]
                if fresh:
                    if sum(map(len, memos.values())) > MEMO_WORDS:
                        memos.clear()
                        memo, fresh = memos.setdefault(lang, {}), list(set(words))
                    start = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
                    codes = np.array([xxhash.xxh64_intdigest(w, start) for w in fresh], np.uint64).view(np.int64)
                    codes[~known.has(fingerprint(codes))] = 0
                    memo.update(zip(fresh, codes.tolist(), strict=True))
                    memo[b"\n"] = 0
                codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                word = codes != 0
                pair = word[1:] & word[:-1]
                inside = np.zeros(len(codes), bool)
                inside[1:] |= pair
                inside[:-1] |= pair
                ends = np.zeros(len(codes), bool)  # the break behind a run
                ends[1:] = inside[:-1] & ~inside[1:]
                codes[~inside] = 0
                parts.append(codes[inside | ends])
                lengths.append(len(parts[-1]))
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts or [np.zeros(0, np.int64)])))], ["codes"])

    return documents.mapInArrow(run, "codes array<long>").where(F.size("codes") > 0)


def prints_of(words: DataFrame) -> DataFrame:
    """(print) of words (code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(fingerprint(batch.column(0).to_numpy()).view(np.int64))], ["print"])

    return words.select("code").mapInArrow(run, "print long")


def streams(batches: Iterator[pa.RecordBatch], most: int = BATCH_CODES) -> Iterator[np.ndarray]:
    """Codes of whole runs, about `most` at a time."""
    held, n = [], 0
    for batch in batches:
        codes = batch.column(0).flatten().to_numpy()
        while n + len(codes) >= most:
            end = max(1, most - n)
            end += int(np.argmax(codes[end - 1 :] == 0))  # each text ends with a zero
            yield np.concatenate([*held, codes[:end]])
            held, n, codes = [], 0, codes[end:]
        held.append(codes)
        n += len(codes)
    if n:
        yield np.concatenate(held)


def frequent_pairs(encoded: DataFrame, min_count: int) -> DataFrame:
    """(print) that neighbours share min_count times or more; never less often than a pair itself is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in streams(batches):
            at = np.flatnonzero((codes[1:] != 0) & (codes[:-1] != 0))
            found, n = np.unique(extended(fingerprint(codes[at]), codes[at + 1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["print", "n"])

    counts = encoded.mapInArrow(run, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count).select("print")


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of one length (rows of codes), and the sum of n for each."""
    prints = fingerprint(np.ascontiguousarray(rows[:, 0]))
    for i in range(1, rows.shape[1]):
        prints = extended(prints, np.ascontiguousarray(rows[:, i]))
    order = np.argsort(prints)
    alike = rows[order]
    first = np.ones(len(rows), bool)
    first[1:] = (alike[1:] != alike[:-1]).any(axis=1)
    if np.count_nonzero(first[1:]) > np.count_nonzero(np.diff(prints[order])):  # phrases that share a fingerprint
        order = np.lexsort(rows.T)
        alike = rows[order]
        first[1:] = (alike[1:] != alike[:-1]).any(axis=1)
    return alike[first], np.add.reduceat(n[order], np.flatnonzero(first)) if len(n) else n


def candidates(encoded: DataFrame, pairs: Bitmap, min_count: int, held: int = HELD_PHRASES, batch_codes: int = BATCH_CODES) -> DataFrame:
    """(c1, ... c5) of phrases of which all pairs are in the bitmap, and that may be found min_count times; zeros behind.

    A task adds up what it reads and takes `unsaid` off each sum. All tasks together take less than min_count off a phrase, so
    each frequent one is told by some task, and its sum reaches min_count with what may have been taken off. A task that holds
    more than `held` phrases takes a part of it at once, and tells what it holds if that doesn't halve them.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pairs)
    tasks = 2 * encoded.sparkSession.sparkContext.defaultParallelism
    unsaid = (min_count - 1) // tasks

    def lessened(sums: Sums, by: int) -> Sums:
        return {size: (rows[n > by], n[n > by] - by) for size, (rows, n) in sums.items()}

    def told(sums: Sums) -> Iterator[pa.RecordBatch]:
        for size, (rows, n) in sums.items():
            columns = [pa.array(np.ascontiguousarray(rows[:, i]) if i < size else np.zeros(len(n), np.int64)) for i in range(MAX_WORDS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*CODES, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, left = {}, unsaid
        for codes in streams(batches, batch_codes):
            if sum(len(n) for _, n in sums.values()) > held:
                if left:
                    sums, left = lessened(sums, 1), left - 1
                if sum(len(n) for _, n in sums.values()) > held // 2:
                    yield from told(sums)
                    sums = {}
            chain = (codes[1:] != 0) & (codes[:-1] != 0)
            at = np.flatnonzero(chain)
            chain[at] = shared.value.has(extended(fingerprint(codes[at]), codes[at + 1]))
            at = np.flatnonzero(chain)
            for size in range(2, MAX_WORDS + 1):
                inside = at + size - 2 < len(chain)
                inside[inside] = chain[at[inside] + size - 2]
                at = at[inside]
                rows, n = np.stack([codes[at + i] for i in range(size)], axis=1), np.ones(len(at), np.int64)
                if size in sums:
                    rows, n = np.concatenate((sums[size][0], rows)), np.concatenate((sums[size][1], n))
                sums[size] = summed(rows, n)
        yield from told(lessened(sums, left))

    found = encoded.coalesce(tasks).mapInArrow(run, ", ".join(f"{c} long" for c in [*CODES, "n"])).groupBy(*CODES).agg(F.sum("n").alias("n"))
    return found.where(F.col("n") + tasks * unsaid >= min_count).drop("n")


def shard_of(first: np.ndarray, second: np.ndarray, shards: int) -> np.ndarray:
    """The shard of phrases, by their first two words."""
    return extended(fingerprint(first), second) % np.uint64(shards)


def in_shards(phrases: DataFrame, shards: int) -> DataFrame:
    """phrases (c1, ... c5, phrase) with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(*(batch.column(c).to_numpy() for c in CODES[:2]), shards)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*CODES, "phrase"]), pa.array(shard.astype(np.int64))], [*CODES, "phrase", "shard"])

    return phrases.select(*CODES, "phrase").mapInArrow(run, ", ".join(f"{c} long" for c in [*CODES, "phrase", "shard"]))


def trie_counts(encoded: DataFrame, phrases: pa.Table, shard: int = 0, shards: int = 1) -> DataFrame:
    """(phrase, n) for phrases (phrase, c1, ... c5), all of one shard: how often each occurs.

    Of several shards, each looks only at places where phrases of its own may begin. A task gives its sums as arrays of SUM_BLOCK phrases, which are added up in two steps, so no group holds many.
    """
    codes = np.stack([phrases[c].to_numpy() for c in CODES], axis=1)
    names = np.unique(codes[codes != 0])

    def labels_of(names: np.ndarray, codes: np.ndarray) -> np.ndarray:
        label = np.minimum(np.searchsorted(names, codes), len(names) - 1)
        return np.where(names[label] == codes, label + 1, 0)

    trie = Trie(np.where(codes == 0, 0, np.searchsorted(names, codes) + 1))
    shared = encoded.sparkSession.sparkContext.broadcast((trie, names, phrases["phrase"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, _ = shared.value
        counts = np.zeros(len(trie.check), np.int64)
        for codes in streams(batches):
            if shards == 1:
                states = trie.steps(labels_of(names, codes), MAX_WORDS)
            else:
                at = np.flatnonzero((codes[1:] != 0) & (codes[:-1] != 0))
                at = at[shard_of(codes[at], codes[at + 1], shards) == shard]
                states = trie.steps(lambda place, codes=codes: labels_of(names, codes[place]), MAX_WORDS, at, len(codes))
            counts += np.bincount(np.concatenate(list(islice(states, 1, None))), minlength=len(counts))  # no phrase has one word
        found = counts[trie.ends]
        salt = TaskContext.get().partitionId() % SUM_SALTS
        for block, start in enumerate(range(0, len(found), SUM_BLOCK)):
            part = found[start : start + SUM_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([part], pa.list_(pa.int64()))})

    def summed(part: pa.Table) -> np.ndarray:
        return part["counts"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).sum(axis=0)

    def some(part: pa.Table) -> pa.Table:
        return pa.table({"block": part["block"][:1], "counts": pa.array([summed(part)], pa.list_(pa.int64()))})

    def all_(part: pa.Table) -> pa.Table:
        start, n = part["block"][0].as_py() * SUM_BLOCK, summed(part)
        return pa.table({"phrase": shared.value[2][start : start + len(n)], "n": n})

    sums = encoded.mapInArrow(run, "block int, salt int, counts array<long>").groupBy("block", "salt").applyInArrow(some, "block int, counts array<long>")
    return sums.groupBy("block").applyInArrow(all_, "phrase long, n long")


def phrase_counts(documents: DataFrame, min_count: int = MIN_COUNT, trie_phrases: int = TRIE_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, words array<string>, a) of phrases of one to five words found min_count times or more."""
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    coded, seed = hashed(written(word_counts(texts), "phrase-words"), min_count)
    totals = written(coded.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    frequent = written(coded.where(F.col("n") >= min_count).select("code", "lang", F.col("word").cast("string").alias("word"), "n"), "frequent-words")
    encoded = written(encode(texts, seed, Bitmap(prints_of(frequent.select("code")), frequent.count())), "phrase-codes")
    pairs = written(frequent_pairs(encoded, min_count), "pair-prints")
    seen = written(candidates(encoded, Bitmap(pairs, pairs.count()), min_count).withColumn("phrase", F.monotonically_increasing_id()), "phrase-candidates")
    shards = -(-seen.count() // trie_phrases)
    parts = [seen.select(*CODES, F.lit(0).cast("long").alias("n")).limit(0)]
    sharded = written(in_shards(seen, shards), "phrase-shards") if shards > 1 else seen.withColumn("shard", F.lit(0))
    for i in range(shards):
        mine = sharded.where(F.col("shard") == i).drop("shard").toArrow()
        if not mine.num_rows:
            continue
        found = written(trie_counts(encoded, mine, i, shards).where(F.col("n") >= min_count), "trie-counts")
        parts.append(seen.join(found, "phrase").select(*CODES, "n"))
    together = parts[0]
    for part in parts[1:]:
        together = together.union(part)
    phrases = written(together.withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    cells = phrases.select("phrase", "n", F.posexplode(F.filter(F.array(*CODES), lambda c: c != 0)).alias("pos", "code"))
    spelled = cells.join(frequent.select("code", "lang", "word"), "code", "left").groupBy("phrase").agg(
        F.max("lang").alias("lang"), F.count(F.lit(1)).alias("size"), F.count("word").alias("known"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"), F.max("n").alias("a")
    )  # what a bitmap let through has a word that isn't frequent
    spelled = spelled.where(F.col("size") == F.col("known")).select("lang", F.transform("words", lambda w: w["word"]).alias("words"), "a")
    return totals, written(frequent.select("lang", F.array("word").alias("words"), F.col("n").alias("a")).union(spelled), "counted-phrases")


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases."""
    totals, counts = phrase_counts(documents, min_count, trie_phrases)
    phrases = counts.where(F.size("words") > 1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))))
    longer = phrases.where(F.size("words") > 2).select("lang", F.explode(inner).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 100)).drop("longer")
    cuts = kept.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    part = lambda words, n: counts.select("lang", F.col("words").alias(words), F.col("a").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = cuts.withColumn("up", wide(F.col("a") * 1000) * wide(F.col("n"))).withColumn("down", wide(F.col("l")) * wide(F.col("r"))).withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", first.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
