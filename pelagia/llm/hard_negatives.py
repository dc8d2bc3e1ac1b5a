"""Hard negatives by threshold joins with norm bounds.

Vectors become integers, and rows go to blocks of at most about BLOCK_BYTES by a hash of their id. Anchors are copied
to every block (slices of ANCHOR_SLICE, for each of which the block is read anew), and one task joins a block with a
slice. It holds an inverted index of the block for one threshold at a time: each row's postings stop at the dimension
from which the norm of the rest, times an anchor's norm, stays below the threshold, as a row without a
posting can't reach it. Anchors add up their postings, CHUNK dimensions at a time, and drop the rows whose
sums and remaining norms can't reach the threshold. What is left is scored exactly. The threshold
starts at an anchor's highest window and is lowered by LOWER until each window holds its rows or is passed; the last index
holds all postings. So a block gives exactly its best rows of each window, and the best of all blocks are ranked. Without
a cap on anchors or rows, the number of scores still grows with their product, as the task itself does.

Positives are searched first, in the same way, among the rows of an anchor's label, with a window without ends.

Of rows that share label and integers only the first few by id can be among the results, so no more are kept (a
ranking with a limit before its shuffle: a vector of a third of all rows is no hot group). All arithmetic that decides
is in 64-bit integers.

Defined results: rows with a null id, label or vector, or null or non-finite components, take no part. Of rows that
share an id the one with the smallest label and integers counts. Rows are compared only with rows of as many
components; empty vectors score 0. Components are taken within MAX_COMPONENT (beyond 4,096 before scaling), which keeps
sums exact. An anchor without positives, or whose windows are empty (negative positives), gives no rows. Ties go to
the smaller id. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.llm.common import table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
BLOCK_BYTES = 32 << 20
SMALL_BLOCK_ROWS, SMALL_BLOCKS = 2048, 32
ANCHOR_SLICE = 32_768
MAX_COMPONENT = 1 << 20
LOWER = 0.8
LAST_LEVEL = 0.05
CHUNK = 8
BATCH = 64
FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
LEAST_SCORE = -(1 << 62)


class Block:
    """A block's rows, dimensions by descending weight, and the inverted index of one level at a time.

    Rows stand in descending order of the dimension at which their postings stop, so the postings of CHUNK dimensions are
    the first rows' part of a matrix. Sums are whole numbers in doubles where they stay below 2 ** 52, else in int64.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, order: np.ndarray):
        self.ids, self.labels = ids, labels
        self.vectors = np.ascontiguousarray(vectors[:, order])
        self.rest = rest_norms(self.vectors)
        self.norm = float(self.rest[:, 0].max(initial=0.0))

    def index(self, level: float) -> None:
        """Each row's postings stop where the norm of what follows is below level: less can't matter."""
        size = self.vectors.shape[1]
        cut = np.minimum(-(-(self.rest[:, :-1] >= level).sum(axis=1) // CHUNK) * CHUNK, size)
        self.rows = np.argsort(-cut, kind="stable")
        self.rows = self.rows[cut[self.rows] > 0] if level > 0 else self.rows
        self.cut = cut[self.rows]
        self.omitted = self.rest[self.rows, self.cut]

    def reach(self, anchors: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each anchor the rows with a score of at least `least`, and their scores."""
        norms = rest_norms(anchors)
        exact = float(norms[:, 0].max(initial=0.0)) * self.norm < 1 << 52
        kind = np.float64 if exact else np.int64
        rows, cut = self.rows, self.cut
        vectors, rest, asked = self.vectors[rows].astype(kind), self.rest[rows], anchors.astype(kind)
        omitted = norms[:, cut] * self.omitted + 1e-9 * norms[:, :1] * self.norm
        sums = np.zeros((len(anchors), len(rows)), kind)
        for d in range(0, vectors.shape[1], CHUNK):
            n = np.count_nonzero(cut > d)
            sums[:, :n] += asked[:, d : d + CHUNK] @ vectors[:n, d : d + CHUNK].T
            end = min(d + CHUNK, vectors.shape[1])
            live = (sums + np.maximum(norms[:, end, None] * rest[:, end], omitted) >= least[:, None]).any(axis=0)
            if np.count_nonzero(live) * 2 < len(live):
                rows, cut, vectors, rest, omitted, sums = rows[live], cut[live], vectors[live], rest[live], omitted[:, live], sums[:, live]
        out = []
        for i in range(len(anchors)):
            at = np.flatnonzero(sums[i] + omitted[i] >= least[i])
            scores = self.vectors[rows[at]] @ anchors[i]
            out.append((rows[at][scores >= least[i]], scores[scores >= least[i]]))
        return out


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """[i, d]: norm of row i from dimension d on; one more column of zeros."""
    squares = vectors.astype(np.float64) ** 2
    sums = np.zeros((len(vectors), vectors.shape[1] + 1))
    sums[:, :-1] = squares[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(sums)


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first by score, then id."""
    return np.lexsort((ids, -scores))[:n]


def windows_of(block: Block, ids: np.ndarray, labels: np.ndarray | None, anchors: np.ndarray, windows: list[list[tuple[int, int]]], n: int) -> list[list]:
    """For each anchor's windows (lowest, highest score) the n best rows, without the anchor and, if given, its label."""
    norms = rest_norms(anchors)[:, 0]
    tops = np.array([max(high for _, high in own) for own in windows], float)
    with np.errstate(divide="ignore"):
        start = np.where(norms > 0, tops / norms, 0.0)
    found: list[list] = [[] for _ in windows]
    open_ = np.arange(len(ids))
    level = block.norm
    while len(open_):
        last = level <= LAST_LEVEL * block.norm
        if last:
            level = 0.0
        now = open_ if last else open_[start[open_] >= level]
        if len(now):
            block.index(level)
        left = []
        for part in np.array_split(now, -(-len(now) // BATCH)) if len(now) else ():
            least = np.full(len(part), float(LEAST_SCORE)) if last else level * norms[part] * (1 + 1e-9)
            for i, limit, (at, scores) in zip(part, least, block.reach(anchors[part], least), strict=True):
                usable = block.ids[at] != ids[i]
                if labels is not None:
                    usable &= block.labels[at] != labels[i]
                at, scores = at[usable], scores[usable]
                found[i] = []
                for low, high in windows[i]:
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    inside = inside[best(block.ids[at[inside]], scores[inside], n)]
                    found[i].append((block.ids[at[inside]], scores[inside]))
                if not (last or all(len(own) == n or limit <= low for (own, _), (low, _) in zip(found[i], windows[i], strict=True))):
                    left.append(i)
        open_ = np.concatenate((np.setdiff1d(open_, now), np.array(left, np.int64)))
        level *= LOWER
    return found


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def weight_order(vectors: np.ndarray) -> np.ndarray:
    return np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")


def join_positives(n: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors, ids, labels = matrix(left["e"]), left["vec_id"].to_numpy(), left["label"].to_numpy()
            order, anchors = weight_order(vectors), matrix(right["anchor"])
            anchor_ids, anchor_labels = right["anchor_id"].to_numpy(), right["anchor_label"].to_numpy()
            for label in np.unique(anchor_labels):
                same, asking = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
                block = Block(ids[same], labels[same], vectors[same], order)
                found = windows_of(block, anchor_ids[asking], None, anchors[asking][:, order], [[(LEAST_SCORE, -LEAST_SCORE)]] * len(asking), n)
                for i, ((others, scores),) in zip(anchor_ids[asking], found, strict=True):
                    out += [(i, None, None, o, s) for o, s in zip(others, scores, strict=True)]
        return rows_of(out)

    return run


def join_negatives(n: int, low: int, high: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            vectors = matrix(left["e"])
            order = weight_order(vectors)
            block = Block(left["vec_id"].to_numpy(), left["label"].to_numpy(), vectors, order)
            # whole numbers: low * p <= 100 * s <= high * p; negative positives leave no window
            own = [[(p, -(-low * p["score"] // 100), high * p["score"] // 100) for p in ps if p["score"] >= 0] for ps in right["positives"].to_pylist()]
            some = np.array([i for i, ps in enumerate(own) if ps], np.int64)
            ids, labels, anchors = right["anchor_id"].to_numpy()[some], right["anchor_label"].to_numpy()[some], matrix(right["anchor"])[some][:, order]
            found = windows_of(block, ids, labels, anchors, [[w[1:] for w in own[i]] for i in some], n)
            for i, a, rows in zip(some, ids, found, strict=True):
                for (p, _, _), (others, scores) in zip(own[i], rows, strict=True):
                    out += [(a, p["id"], p["score"], o, s) for o, s in zip(others, scores, strict=True)]
        return rows_of(out)

    return run


def rows_of(found: list[tuple]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [[]] * 5
    names = ["anchor_id", "positive_id", "positive_score", "other_id", "score"]
    return pa.table([pa.array(list(map(lambda x: None if x is None else int(x), c)), pa.int64()) for c in columns], names)


def usable(embeddings: DataFrame, relabel: Column | None) -> DataFrame:
    """(vec_id, label, e) of the rows that take part, one for each id."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(float(MAX_COMPONENT))), F.lit(-float(MAX_COMPONENT)))).cast("int"))
    label = F.col("label") if relabel is None else relabel
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), scaled.alias("e")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.e")


def mine(embeddings: DataFrame, anchors: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors is a condition on vec_id.

    Negatives have another label and a score from low to high per cent of the positive's; relabel replaces label.
    """
    rows = written(usable(embeddings, relabel), "negatives-rows")
    copies = Window.partitionBy("label", "e").orderBy("vec_id")
    first = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("e")), F.lit(1)).alias("size"), F.count_if(anchors).alias("anchors")).first()
    blocks = max(1, -(-shape["n"] * 8 * max(1, shape["size"]) // block_bytes), min(SMALL_BLOCKS, shape["n"] // SMALL_BLOCK_ROWS))
    slices = -(-shape["anchors"] // ANCHOR_SLICE)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    placed = first.select(F.size("e").alias("size"), block, every(slices).alias("slice"), "vec_id", "label", "e")
    asking = rows.where(anchors).select(F.size("e").alias("size"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(max(1, slices))).cast("int").alias("slice"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("e").alias("anchor"))
    key = ["size", "block", "slice"]

    def joined(asked: DataFrame, run) -> DataFrame:
        copied = asked.select("*", every(blocks).alias("block"))
        return placed.groupBy(*key).cogroup(copied.groupBy(*key)).applyInArrow(run, FOUND)

    best_of = lambda by: Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    chosen = joined(asking, join_positives(positives)).withColumn("place", F.row_number().over(best_of(["anchor_id"]))).where(F.col("place") <= positives)
    chosen = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", F.col("other_id").alias("id"))), asc=False).alias("positives"))
    chosen = written(asking.join(chosen, "anchor_id"), "negatives-positives")
    found = joined(chosen, join_negatives(negatives, low, high)).withColumn("rank", F.row_number().over(best_of(["anchor_id", "positive_id"]))).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)
