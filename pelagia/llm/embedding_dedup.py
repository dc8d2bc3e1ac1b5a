"""Near-duplicate vectors: a small-world graph for each shard, queried by every vector.

Equal vectors are collapsed first. The rest go to shards by a hash of the id: as many as the session has cores (of
LEAST_SHARD_ROWS vectors at least), and more only where one would exceed SHARD_BYTES. One task builds a shard's
graph and writes it, with its vectors, as a file in the shared folder. Then each pair of shards is a task that reads
two files and queries each graph with the vectors of the other, so vectors are shuffled once, whatever the number
of shards, and memory is bounded by two shards. The number of such tasks grows with the square of the number of
shards: that is the method's own cost.

A query whose beam ends full of links gets a wider one, and beyond MAX_BEAM one as wide as the shard, which is a scan.
Recall is audited against all of the shard: where it is built, with vectors of the shard moved to a cosine of
PLANTED, and in each pair, with queries spread over the other shard that have links. Half of AUDIT_QUERIES are those
with the fewest links of AUDIT_SAMPLE. Each query's recall counts alike, however many links it has, and links to itself
don't count; until the mean is AUDIT_RECALL the beam doubles. What was measured is returned. Cosines of all found pairs
are verified in double precision, and a pair that is found from one side counts for both. A task emits counts
and the smallest vector of each vector's part of the pair of shards, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
Vectors link only with vectors of their own length. Rows with a null id stay alone. Rows that share an id and
vector count as separate vectors. Ties are decided by the verified cosine. Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import shared_dir, table, written
from pelagia.llm.graph import components
from pelagia.llm.hnsw import Graph

LEAST = 0.95
SHARD_BYTES = 32 << 20
LEAST_SHARD_ROWS = 1024
MOST_TASKS = 8192
BEAM = 16
QUERY_BATCH = 512
MAX_BEAM = 512
AUDIT_SAMPLE = 256
AUDIT_QUERIES = 64
PLANTED = 0.96
SCAN_ROWS = 32
AUDIT_RECALL = 0.99
MARGIN = 1e-4
DOUBT = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale  # squares of very large or small components stay finite
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def valid(vector):
    """Condition that a vector can have links."""
    values = vector.cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False))


def _spread(n: int, most: int) -> np.ndarray:
    """At most so many of n places, evenly through all of them."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int64)) if n else np.zeros(0, np.int64)


@dataclass
class Shard:
    """Distinct vectors with their ids, how many rows each stands for, and the graph over them."""

    ids: np.ndarray
    ns: np.ndarray
    units: np.ndarray
    graph: Graph
    beam: int = BEAM

    @classmethod
    def build(cls, ids: np.ndarray, ns: np.ndarray, vectors: np.ndarray) -> Shard:
        units = _unit(vectors)
        shard = cls(ids, ns, units, Graph.build(units.astype(np.float32)))
        shard._audit_planted()
        return shard

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, ns=self.ns, units=self.units, beam=np.array(self.beam), graph=np.frombuffer(self.graph.to_bytes(), np.uint8))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data))
        return cls(x["ids"], x["ns"], x["units"], Graph.from_bytes(x["graph"].tobytes(), x["units"].astype(np.float32)), int(x["beam"]))

    def search(self, units: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified (query row, place) pairs of queries whose beam had room, and the rows of the others."""
        rows, places, open_ = [], [], np.arange(len(units)) if beam <= MAX_BEAM else np.zeros(0, np.int64)
        dense = np.zeros(0, np.int64) if beam <= MAX_BEAM else np.arange(len(units))
        while len(open_):
            full = []
            for a in range(0, len(open_), QUERY_BATCH):
                part = open_[a : a + QUERY_BATCH]
                ids, sims = self.graph.nearest(units[part].astype(np.float32), beam)
                near = (sims >= LEAST - MARGIN) & (ids >= 0)
                filled = near.all(axis=1)
                full.append(part[filled])
                r, c = np.nonzero(near & ~filled[:, None])
                rows.append(part[r])
                places.append(self.graph.order[ids[r, c]])
            open_, beam = np.concatenate(full), 4 * beam
            if beam > MAX_BEAM:
                dense, open_ = open_, open_[:0]
        r, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
        good = self._linked(units, r, c)
        return r[good], c[good], dense

    def _linked(self, units: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        good = np.zeros(len(rows), bool)
        for a in range(0, len(rows), 100_000):
            part = slice(a, a + 100_000)
            good[part] = np.einsum("rd,rd->r", units[rows[part]], self.units[places[part]]) >= LEAST
        return good

    def scan(self, units: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a few rows at a time which vectors of the shard they link with."""
        for a in range(0, len(rows), SCAN_ROWS):
            part = rows[a : a + SCAN_ROWS]
            cosines = units[part] @ self.units.T
            hit = cosines >= LEAST
            r, c = np.nonzero(np.abs(cosines - LEAST) < DOUBT)
            hit[r, c] = self._linked(units, part[r], c)
            yield part, hit

    def _audit_planted(self) -> None:
        rng = np.random.default_rng(len(self.ids))
        near = self.units[_spread(len(self.ids), AUDIT_SAMPLE)]
        away = rng.normal(size=near.shape)
        away -= (away * near).sum(axis=1, keepdims=True) * near
        if near.shape[1] > 1:
            self.beam, _, _ = self.audited(PLANTED * near + np.sqrt(1 - PLANTED**2) * _unit(away), None)

    def audit(self, units: np.ndarray, ids: np.ndarray) -> tuple[int, int, float]:
        some = _spread(len(ids), AUDIT_SAMPLE)
        return self.audited(units[some], ids[some])

    def audited(self, units: np.ndarray, ids: np.ndarray | None) -> tuple[int, int, float]:
        """The beam that these queries need, how many of them were judged and their mean recall; rounding decides nothing here."""
        pairs = [(part[r], c) for part, hit in self.scan(units, np.arange(len(units))) for r, c in [np.nonzero(hit)]]
        rows, places = (np.concatenate(x) for x in zip(*pairs, strict=True))
        sure = np.einsum("rd,rd->r", units[rows], self.units[places]) >= LEAST + DOUBT
        sure &= True if ids is None else self.ids[places] != ids[rows]
        rows, places = rows[sure], places[sure]
        n = np.bincount(rows, minlength=len(units))
        linked = np.flatnonzero(n)
        if not len(linked):
            return self.beam, 0, 1.0
        fewest = linked[np.argsort(n[linked], kind="stable")[: AUDIT_QUERIES // 2]]
        chosen = np.union1d(fewest, linked[_spread(len(linked), AUDIT_QUERIES // 2)])
        expected = (rows * len(self.ids) + places)[np.isin(rows, chosen)]
        beam = self.beam
        while True:
            r, c, dense = self.search(units[chosen], beam)
            got = np.intersect1d(chosen[r] * len(self.ids) + c, expected) // len(self.ids)
            share = np.bincount(got, minlength=len(units))[chosen] / n[chosen]
            share[dense] = 1.0  # these are scanned
            if share.mean() >= AUDIT_RECALL:
                return beam, len(chosen), float(share.mean())
            beam *= 2


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the parts of a and b in root, which holds the smallest place of each place's part."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def link_counts(a: Shard, b: Shard, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Rows that link with each vector of a and of b across the two, their parts, and the audits.

    Queries with many links are scanned; all other pairs are those that either side's search has found.
    """
    n = len(a.ids)
    audits, dense, codes = [], [], []
    for shard, asking in ((a, b),) if same else ((a, b), (b, a)):
        audits.append(shard.audit(asking.units, asking.ids))
        rows, places, full = shard.search(asking.units, audits[-1][0])
        dense.append(full)
        codes.append(places * len(b.ids) + rows if shard is a else rows * len(b.ids) + places)
    if same:
        dense.append(dense[0])
        codes.append(codes[0] % n * n + codes[0] // n)
    in_b, in_a = np.zeros(len(b.ids), bool), np.zeros(n, bool)
    in_b[dense[0]], in_a[dense[1]] = True, True
    code = np.unique(np.concatenate(codes))
    i, j = code // len(b.ids), code % len(b.ids)
    keep = ~in_a[i] & ~in_b[j] & ((i != j) | (not same))
    i, j = i[keep], j[keep]
    of_a = np.bincount(i, b.ns[j], n).astype(np.int64)
    of_b = of_a if same else np.bincount(j, a.ns[i], len(b.ids)).astype(np.int64)
    shift = 0 if same else n
    root = np.arange(n + (0 if same else len(b.ids)))
    merge(root, i, j + shift)
    for asking, shard, full, own, other, other_dense, at, to in ((b, a, dense[0], of_b, of_a, in_a, shift, 0), (a, b, dense[1], of_a, of_b, in_b, 0, shift))[: 1 if same else 2]:
        for part, hit in shard.scan(asking.units, full):
            if same:
                hit[np.arange(len(part)), part] = False
            own[part] = hit @ shard.ns
            add = asking.ns[part] @ hit
            other[~other_dense] += add[~other_dense]
            r, c = np.nonzero(hit)
            merge(root, part[r] + at, c + to)
    return of_a, of_b, root, audits


FOUND = "id long, links long, part long, queries long, recall double, beam int"
FILES = "size int, shard int, path string, n long"


def _found(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"id": pa.int64(), "links": pa.int64(), "part": pa.int64(), "queries": pa.int64(), "recall": pa.float64(), "beam": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], list(types))


@dataclass
class Links:
    """counts (id, links), parts (a, b) whose components are the classes, audits (queries, recall, beam)."""

    counts: DataFrame
    parts: DataFrame
    audits: DataFrame


def search(vectors: DataFrame, shards: int) -> Links:
    """Links among vectors (id, n, vector), which are distinct."""
    spark = vectors.sparkSession
    folder = shared_dir(spark, "vector-graphs")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, held = TaskContext.get(), None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                shard = Shard.build(rows.column("id").to_numpy(), rows.column("n").to_numpy(), _matrix(rows.column("vector")))
                store, top = fs.FileSystem.from_uri(folder)
                store.create_dir(top, recursive=True)
                name = f"{key[0]}-{key[1]}-{task.taskAttemptId()}.npz"
                with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(shard.to_bytes())
                yield pa.RecordBatch.from_pydict({"size": pa.array([key[0]], pa.int32()), "shard": pa.array([key[1]], pa.int32()), "path": [f"{folder}/{name}"], "n": [rows.num_rows]})
                held.clear()

        for batch in batches:
            keys = np.stack((batch.column("size").to_numpy(), batch.column("shard").to_numpy()), axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start < end:
                    if key != tuple(keys[start].tolist()):
                        yield from flush()
                        key = tuple(keys[start].tolist())
                    held.append(batch.slice(start, end - start))
        yield from flush()

    placed = vectors.select(F.size("vector").alias("size"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "vector")
    files = written(placed.repartitionByRange(shards, "shard").sortWithinPartitions("size", "shard", "id").mapInArrow(build, FILES), "vector-files")
    right = files.select("size", F.col("shard").alias("other"), F.col("path").alias("other_path"))
    pairs = files.select("size", "shard", "path").join(right, "size").where("shard <= other").select("path", "other_path")
    tasks = max(1, min(shards * (shards + 1) // 2, max(MOST_TASKS, shards)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Shard] = {}

        def load(path: str) -> Shard:
            if path not in held:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    held[path] = Shard.from_bytes(file.read())
            return held[path]

        for batch in batches:
            for first, second in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path in [p for p in held if p not in (first, second)]:
                    del held[path]
                a, b = load(first), load(second)
                of_a, of_b, root, audits = link_counts(a, b, first == second)
                ids, counts = (a.ids, of_a) if first == second else (np.concatenate((a.ids, b.ids)), np.concatenate((of_a, of_b)))
                some = np.flatnonzero(counts)
                yield _found(id=ids[some], links=counts[some], part=ids[root[some]])
                beams, queries, recall = zip(*audits, strict=True)
                yield _found(queries=queries, recall=recall, beam=beams)

    found = written(pairs.repartitionByRange(tasks, "path", "other_path").mapInArrow(compare, FOUND), "vector-links")
    linked = found.where(F.col("id").isNotNull())
    return Links(linked.groupBy("id").agg(F.sum("links").alias("links")), linked.select(F.col("id").alias("a"), F.col("part").alias("b")), found.where(F.col("id").isNull()).select("queries", "recall", "beam"))


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, vector: null where it can have no links), and (vector, id, n) of those that can."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid(F.col("embedding")), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))).alias("vector"))
    usable = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    return rows, written(usable.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")


def shard_number(vectors: DataFrame) -> int:
    """As many shards as cores where they are not too small, more where they would be too large."""
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("size")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, found["n"] // LEAST_SHARD_ROWS), -(-found["n"] * 8 * found["size"] // SHARD_BYTES))


def near_duplicates(embeddings: DataFrame, shards: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, embedding)."""
    rows, reps = distinct_vectors(embeddings)
    links = search(reps, shards or shard_number(reps))
    classes = components(links.parts, "vector-components").withColumnRenamed("component", "smallest")
    by_vector = reps.join(links.counts, "id", "left").join(classes, "id", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "id").alias("component"))
    can = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    linked = rows.where(can).join(by_vector, "vector").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
