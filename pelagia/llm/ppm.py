"""Language-model scores: prediction by partial matching over bytes, beside a unigram base score.

The model is a pretrained context trie of ORDER bytes. Escape estimation is method C (escape weight = number
of distinct symbols), and symbols that a longer context has already offered are excluded from the shorter
ones; below order 0 stands the uniform distribution over bytes not seen. Byte 0xFF, which UTF-8 never uses,
ends a text and pads its first contexts. Scores are log10 probabilities of the whole lower-cased text.

Jobs: (1) each task counts (context, symbol) codes of the training texts with sorts, and one aggregation adds
them up; (2) each task scores its texts with the broadcast trie and writes, for each block of about
BLOCK_BYTES of text, the block's distinct words and its documents as word numbers; (3) word counts over the
whole corpus come from the blocks' words, go back to the blocks by a join, and give the base scores. So a
frequent word is one row for each block, whatever its key.

No code is left out of the model. Only if all of them are at most MAX_NODES is the trie collected and
broadcast. Otherwise blocks also hold their distinct codes and their texts; code counts over the corpus come
from the blocks, the log probability of every code is found in tasks that each have all codes of some pairs of
last context bytes (at most 65,536 for a pair; orders 0 and 1, 65,792 codes at most, are broadcast), and these
go back to the blocks by a join. Both ways give the same scores.

Defined results: a null text is empty (one end token); with no training text every byte costs log10(256)
and the base score is 0 per token (N = V = 0). A null id is a training row. Repeated rows each get a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import crc_remainder, table, written

ORDER = 3
MAX_NODES = 1 << 19
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
PART_CODES = 1 << 19
END = b"\xff"
PAD = END * ORDER
END_TOKEN = b"\n"
EMPTY_SLOT = np.uint32(0)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (context bytes, then the symbol) of all positions of the texts, and where each text begins in them."""
    data = np.frombuffer(b"".join([PAD + t + END for t in texts]), np.uint8).astype(np.uint32)
    code = np.zeros(len(data) - ORDER, np.uint32)
    for k in range(ORDER + 1):
        code <<= np.uint32(8)
        code |= data[k : len(data) - ORDER + k]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + ORDER)[:-1]))
    keep = np.ones(len(code), bool)
    for k in range(1, ORDER + 1):
        keep[begin[1:] - k] = False  # these end in the padding of the next text
    return code[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.diff(np.append(edge, len(codes)))


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[edge], np.add.reduceat(counts, edge) if len(codes) else counts


class HashTable:
    """Fixed keys to float values by open addressing; all probes of an array at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.used, self.values = np.zeros(size, np.uint32), np.zeros(size, bool), np.zeros(size, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = ~self.used[at]
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]], self.used[at[first]] = keys[left[first]], values[left[first]], True
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the positions of the keys that are not there."""
        at = self._slot(keys)
        values = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) | ~self.used[at])
        missing, at = [], at[open_]
        while len(open_):
            gone = ~self.used[at]
            same = (self.keys[at] == keys[open_]) & ~gone
            values[open_[same]] = self.values[at[same]]
            missing.append(open_[gone])
            go_on = ~(same | gone)
            open_, at = open_[go_on], (at[go_on] + 1) & (len(self.keys) - 1)
        return values, np.sort(np.concatenate(missing)) if missing else open_


class Level:
    """Codes of one order with their counts, and sums by context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes.astype(np.uint32), counts.astype(np.float64)
        self.contexts, start = np.unique(self.codes >> np.uint32(8), return_index=True)
        ends = np.append(start, len(codes))
        self.of = np.repeat(np.arange(len(self.contexts)), np.diff(ends))
        self.total = np.add.reduceat(self.counts, start) if len(codes) else np.zeros(0)
        self.distinct = np.diff(ends).astype(np.float64)
        self.excluded = np.zeros(len(self.contexts))

    def exclude_from(self, shorter: Level, order: int) -> None:
        """What the next shorter context's counts of this level's symbols add up to, by context."""
        n = shorter.count(self.codes & np.uint32((1 << 8 * order) - 1))
        self.excluded = np.bincount(self.of, n, len(self.contexts)) if len(self.codes) else self.excluded

    def count(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[i] == codes, self.counts[i], 0.0)

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """Places of the contexts, -1 for those that never occurred."""
        if not len(self.contexts):
            return np.full(len(contexts), -1)
        i = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[i] == contexts, i, -1)


class Trie:
    """The pretrained model: levels[k] has contexts of k bytes."""

    def __init__(self, codes: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = [Level(*x) for x in codes]
        for k in range(ORDER, 0, -1):
            self.levels[k].exclude_from(self.levels[k - 1], k)
        top = self.levels[ORDER]
        self.seen = HashTable(top.codes, np.log10(top.counts / (top.total + top.distinct)[top.of]))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        values, missing = self.seen.get(codes)
        out = values.astype(np.float64)
        if len(missing):
            out[missing] = self._escaped(codes[missing])
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """The general case, order by order, for all codes at once."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        gone_total, gone_distinct = np.zeros(len(codes)), np.zeros(len(codes))  # what longer contexts exclude here
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            own = codes[open_] & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else codes[open_]
            at = level.context(own >> np.uint32(8))
            known = at >= 0
            total = np.where(known, level.total[at] if len(level.total) else 0.0, 0.0) - gone_total[open_]
            distinct = np.where(known, level.distinct[at] if len(level.total) else 0.0, 0.0) - gone_distinct[open_]
            weight = total + distinct
            offers = known & (distinct > 0)
            count = np.where(offers, level.count(own), 0.0)
            hit = count > 0
            done = open_[hit]
            out[done] += np.log10(count[hit] / weight[hit])
            past = offers & ~hit
            out[open_[past]] += np.log10(distinct[past] / weight[past])
            if k:
                place = np.where(known, at, 0)
                gone_total[open_] = np.where(known, level.excluded[place] if len(level.total) else 0.0, 0.0)
                gone_distinct[open_] = np.where(known, level.distinct[place] if len(level.total) else 0.0, 0.0)
            open_ = open_[~hit]
        unseen = 256 - (self.levels[0].distinct[0] if len(self.levels[0].distinct) else 0)
        out[open_] -= np.log10(max(1.0, unseen))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        codes, begin = codes_of(texts)
        return np.add.reduceat(self.log_probabilities(codes), begin)


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= SLICE_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def code_counts(training: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(code, n) of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            for part in _slices([lowered(t) for t in batch.column(0).to_pylist()]):
                more, n = counted(codes_of(part)[0])
                codes, counts = added(np.concatenate((codes, more)), np.concatenate((counts, n)))
                if len(codes) > 4 * max_nodes:
                    yield pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int64)), "n": pa.array(counts)})
                    codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int64)), "n": pa.array(counts)})

    return written(training.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "ppm-codes")


def _level(grams: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order k that training has, in order, with their counts."""
    level = grams if k == ORDER else grams.groupBy((F.col("code") % (1 << 8 * (k + 1))).alias("code")).agg(F.sum("n").alias("n"))
    got = level.where("n > 0").toArrow()
    codes, n = got.column("code").to_numpy().astype(np.uint32), got.column("n").to_numpy().astype(np.int64)
    order = np.argsort(codes)
    return codes[order], n[order]


def fit(training: DataFrame, max_nodes: int = MAX_NODES) -> Trie:
    """The trie of all training texts, for use where it is small; raises beyond max_nodes codes, where score still works."""
    grams = code_counts(training, max_nodes)
    n = grams.count()
    if n > max_nodes:
        raise ValueError(f"{n} codes are too many for one task's memory")
    return Trie([_level(grams, k) for k in range(ORDER + 1)])


def code_logs(grams: DataFrame) -> DataFrame:
    """(code, log) of every row of grams (code, n): n is 0 for codes that occur in held-out texts only."""
    low = grams.sparkSession.sparkContext.broadcast([_level(grams, k) for k in range(2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("code").to_numpy().astype(np.uint32), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        codes, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        top = codes[n > 0], n[n > 0]
        logs = Trie([*low.value, added(top[0] & np.uint32((1 << 24) - 1), top[1]), top]).log_probabilities(codes)
        for a in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + 100_000].astype(np.int64)), pa.array(logs[a : a + 100_000])], ["code", "log"])

    last_two = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    return grams.repartition(max(1, -(-grams.count() // PART_CODES)), last_two).mapInArrow(run, "code long, log double")


ROWS = "block long, doc_id long, held_out boolean, n_tokens long, score double, words binary, text binary, token binary, local int, train_n long, code long"


def _in_blocks(documents: DataFrame, model: Trie | None) -> DataFrame:
    """Document rows (words set), word rows (token set) and, without a model, code rows (code set) of every block."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, block, held = shared.value, TaskContext.get().partitionId() << 24, 0
        index: dict[bytes, int] = {}
        learned: Counter = Counter()
        coded = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def document_rows(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)), *(pa.nulls(len(rows), t) for t in types[7:])], names)

        def add_codes(texts: list[bytes], times: int) -> None:
            nonlocal coded
            for part in _slices(texts):
                codes, counts = counted(codes_of(part)[0])
                coded = added(np.concatenate((coded[0], codes)), np.concatenate((coded[1], counts * times)))

        def code_rows() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(coded[0]), 50_000):
                codes, counts = coded[0][a : a + 50_000], coded[1][a : a + 50_000]
                n = len(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *(pa.nulls(n, t) for t in types[1:9]), pa.array(counts), pa.array(codes.astype(np.int64))], names)

        def word_rows() -> Iterator[pa.RecordBatch]:
            tokens = list(index)
            for a in range(0, len(tokens), 50_000):
                part = tokens[a : a + 50_000]
                n = len(part)
                none = [pa.nulls(n, t) for t in types[1:7]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *none, pa.array(part, pa.binary()), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array([learned.get(t, 0) for t in part], pa.int64()), pa.nulls(n, types[10])], names)

        for batch in batches:
            texts = [lowered(t) for t in batch.column(1).to_pylist()]
            scores = np.concatenate([trie.score(part) for part in _slices(texts)]) if texts and trie else [None] * len(texts)
            rows, fresh = [], ([], [])
            for doc_id, held_out, text, score in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, scores, strict=True):
                counts = Counter(text.split())
                counts[END_TOKEN] = 1
                numbers = [index.setdefault(t, len(index)) for t in counts]
                words = np.array([numbers, list(counts.values())], np.uint32).tobytes()
                if not held_out:
                    learned.update(counts)
                rows.append((block, doc_id, held_out, counts.total(), score, words, None if trie else text))
                fresh[not held_out].append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    if not trie:
                        add_codes(fresh[0], 0)
                        add_codes(fresh[1], 1)
                    yield document_rows(rows)
                    yield from word_rows()
                    yield from code_rows()
                    rows, fresh, held, block = [], ([], []), 0, block + 1
                    index.clear()
                    learned.clear()
                    coded = coded[0][:0], coded[1][:0]
            if rows:
                if not trie:
                    add_codes(fresh[0], 0)
                    add_codes(fresh[1], 1)
                yield document_rows(rows)
        if index:
            yield from word_rows()
            yield from code_rows()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("held_out")).mapInArrow(run, ROWS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Scores of all rows of documents, whose boolean held_out says which rows the model must not learn from."""
    grams = code_counts(documents.where(~F.col("held_out")))
    model = Trie([_level(grams, k) for k in range(ORDER + 1)]) if grams.count() <= max_nodes else None
    rows = written(_in_blocks(documents, model), "ppm-blocks")
    words = rows.where(F.col("token").isNotNull())
    counts = written(words.groupBy("token").agg(F.sum("train_n").alias("c")), "ppm-words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    train_tokens, scale = int(total["n"]), float(total["n"] + total["v"] + 1)
    back = words.select("block", "token", "local").join(counts, "token").select(F.col("block").alias("of_block"), "local", "c", F.lit(None).cast("double").alias("log"))
    if model is None:
        codes = rows.where(F.col("code").isNotNull()).select("block", "code", "train_n")
        logs = written(code_logs(written(codes.groupBy("code").agg(F.sum("train_n").alias("n")), "ppm-code-counts")), "ppm-code-logs")
        back = back.union(codes.join(logs, "code").select(F.col("block").alias("of_block"), F.lit(None).cast("int").alias("local"), F.col("code").alias("c"), "log"))

    def finish(docs: pa.Table, known: pa.Table) -> pa.Table:
        scores, of_code = docs.column("score"), known.column("log").is_valid()
        if of_code.to_numpy().any():
            found = known.filter(of_code)
            known = known.filter(known.column("local").is_valid())
            place = np.argsort(found.column("c").to_numpy())
            codes, code_log = found.column("c").to_numpy()[place].astype(np.uint32), found.column("log").to_numpy()[place]
            sums = []
            for part in _slices(docs.column("text").to_pylist()):
                own, begin = codes_of(part)
                sums.append(np.add.reduceat(code_log[np.searchsorted(codes, own)], begin))
            scores = pa.array(np.concatenate(sums))
        c = np.zeros(known.num_rows, np.int64)
        c[known.column("local").to_numpy()] = known.column("c").to_numpy()
        logs, seen = np.log10((c + 1) / scale), c > 0
        base, n_known = [], []
        for packed in docs.column("words").to_pylist():
            numbers, times = np.frombuffer(packed, np.uint32).reshape(2, -1)
            base.append(float(logs[numbers] @ times))
            n_known.append(int(times[seen[numbers]].sum()))
        n = docs.num_rows
        return pa.table([docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(n_known, pa.int64()), pa.array(np.full(n, train_tokens)), pa.array(base, pa.float64()), scores], [c.split()[0] for c in SCORES.split(", ")])

    docs = rows.where(F.col("words").isNotNull()).select(F.col("block").alias("own_block"), "doc_id", "held_out", "n_tokens", "score", "words", "text")
    return docs.groupBy("own_block").cogroup(back.groupBy("of_block")).applyInArrow(finish, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return score(documents.select("doc_id", "text", held_out.alias("held_out")))
