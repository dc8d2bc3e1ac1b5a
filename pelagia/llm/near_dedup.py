"""Near-duplicate documents by a Chosen Path set similarity join.

A document is its set of 5-word shingles. In each of TREES independent trees a document follows, level by
level, the minwise tokens of its set (those below 1 / (similarity * size) in the level's hash order, and
always the smallest), so documents that share tokens share nodes. Nodes of at most NODE_LIMIT documents are
leaves; larger ones branch on, LEVELS deep, and are leaves then. Comparisons inside a leaf use 128-slot
one-permutation sketches with a margin of four standard deviations, and give a spanning forest, never pairs.
The likeliest edge of each document is then confirmed on the full sets. That settles most groups of copies,
whatever their size, in one pass; only documents that do not hang together yet are compared further: those
of large leaves across their blocks by sketches, then those of one candidate class by full sets. Of the links
confirmed there, too, a forest goes on.

Equal sets are collapsed first (one row for each, by a pre-aggregation), so exact copies never meet in a
group. Two documents of similarity 0.75 share a leaf of one tree with a chance of at least a half, so
twelve trees miss less than one pair in 4,000.

Cost: a leaf or class with one large settled part of g documents and r others takes g * r / block reads at
most. What stays quadratic is a leaf of many documents that share their minwise tokens at LEVELS levels and
are not near copies of each other.

Defined results: a null text, or one without words, has an empty set, links with nothing and is kept. Fewer
than five words are one shingle. Rows that share an id count as one document; a row with a null id stays
alone, with a null component, and is kept. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import table, written
from pelagia.llm.graph import Forest, components

WORDS = 5
PERCENT = 75
TREES, LEVELS = 12, 3
NODE_LIMIT = 64
BLOCK = 4096
CLUSTER_BLOCK = 512
MAP_BITS = 1 << 27
SLOTS = 128
SKETCH_MARGIN = 0.15

_RANDOM = np.random.Generator(np.random.PCG64(7))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
CHOOSERS = _RANDOM.integers(1, 1 << 63, TREES * LEVELS, np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 1 << 64)
EMPTY = np.uint16(0xFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_tables: dict[str, np.ndarray] = {"up": _powers(FACTOR, 1 << 12), "down": _powers(INVERSE, 1 << 12)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_tables[name]) < n:
        _tables[name] = _powers(FACTOR if name == "up" else INVERSE, 1 << (n - 1).bit_length())
    return _tables[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(parts), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power("up", len(data)), out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(data))
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n], ends[len(ends) - n :]
    return np.unique(mixed((sums[last] - sums[first]) * _power("down", len(data))[first]))


def choices(hashes: np.ndarray) -> list[list[list[int]]]:
    """For each tree and level the tokens that the document follows."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (PERCENT / 100 * len(hashes)))))
    signed = hashes.view(np.int64)
    out = []
    for t in range(TREES):
        levels = []
        for c in CHOOSERS[t * LEVELS : (t + 1) * LEVELS]:
            order = hashes * c
            levels.append(signed[order <= max(order.min(), bound)].tolist() if len(hashes) > 1 else signed.tolist())
        out.append(levels)
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation minwise sketch: the least of each of SLOTS slots, in 16 bits."""
    order = np.sort(hashes * np.uint64(FACTOR))
    slot = (order >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    out = np.full(SLOTS, EMPTY, np.uint16)
    out[slot[first]] = np.minimum((order[first] & np.uint64(0xFFFF)).astype(np.uint16), np.uint16(0xFFFE))
    return out.tobytes()


SKETCHES = "doc_id long, n_shingles long, fp1 long, fp2 long, choices array<array<array<long>>>, sketch binary"


def sketches(documents: DataFrame) -> DataFrame:
    token_type = pa.list_(pa.list_(pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = []
                for text in part.column(1).to_pylist():
                    h = shingles(text)
                    if len(h):
                        fp1 = int(np.add.reduce(mixed(h ^ np.uint64(FACTOR))).view(np.int64))
                        fp2 = int(np.bitwise_xor.reduce(mixed(h + np.uint64(INVERSE))).view(np.int64))
                        rows.append((len(h), fp1, fp2, choices(h), sketch(h)))
                    else:
                        rows.append((0, None, None, None, None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.int64(), token_type, pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [c.split()[0] for c in SKETCHES.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCHES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values of the first column, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long, score double"


def _edge_batch(pairs: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, score = zip(*pairs, strict=True) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], ["a", "b", "score"])


def _edges_of(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    pairs: list[tuple[int, int, float]] = []
    for group in _groups(batches):
        if group.num_rows > 1:
            pairs += compare(group)
        if len(pairs) > 20_000:
            yield _edge_batch(pairs)
            pairs = []
    yield _edge_batch(pairs)


def _roots(group: pa.Table) -> np.ndarray:
    """For each row the first row of the group that is known to hang together with it."""
    if "sub" not in group.column_names:
        return np.arange(group.num_rows)
    _, first, inverse = np.unique(group.column("sub").to_numpy(), return_index=True, return_inverse=True)
    return first[inverse]


def _partners(i: int, roots: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Rows after i that row i is still to be compared with; where two sides meet, only those of the other side."""
    rest = roots[i + 1 :] != roots[i]
    if side is not None:
        rest &= side[i + 1 :] != side[i]
    return i + 1 + np.flatnonzero(rest)


def _sides(group: pa.Table) -> np.ndarray | None:
    side = group.column("side").to_numpy() if "side" in group.column_names else None
    return side if side is not None and side.min() != side.max() else None


def _likely(group: pa.Table) -> list[tuple[int, int, float]]:
    """A spanning forest of the pairs whose sketches leave a similarity of PERCENT possible, with that estimate."""
    ids = group.column("rep").to_numpy()
    size = group.column("n_shingles").to_numpy().astype(float)
    slots = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
    filled = slots != EMPTY
    forest, out, side = Forest(len(ids)), [], _sides(group)
    forest.root = _roots(group)
    for i in range(len(ids) - 1):
        rest = _partners(i, forest.root, side)
        if not len(rest):
            continue
        equal = ((slots[rest] == slots[i]) & filled[i]).sum(axis=1)
        either = (filled[rest] | filled[i]).sum(axis=1)
        near = (equal >= (PERCENT / 100 - SKETCH_MARGIN) * either) & (100 * np.minimum(size[rest], size[i]) >= PERCENT * np.maximum(size[rest], size[i]))
        for j, score in zip(rest[near], (equal / np.maximum(either, 1))[near], strict=True):
            if forest.union(i, int(j)):
                out.append((int(ids[i]), int(ids[j]), float(score)))
    return out


def _linked(group: pa.Table) -> list[tuple[int, int, float]]:
    """Pairs that are linked by their full sets and, with what is known already, span all such pairs."""
    ids = group.column("rep").to_numpy()
    sets = [shingles(t) for t in group.column("text").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    forest, out, side = Forest(len(ids)), [], _sides(group)
    forest.root = _roots(group)
    for i in range(len(ids) - 1):
        rest = _partners(i, forest.root, side)
        if not len(rest):
            continue
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        width = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=len(ids))[rest]
        for j in rest[100 * common >= PERCENT * (size[rest] + size[i] - common)]:
            if forest.union(i, int(j)):
                out.append((int(ids[i]), int(ids[j]), 1.0))
    return out


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges whose ends are linked: a parent (kind 0) comes before its children, which are a stream."""
    meet, parent, sets = None, None, []
    for batch in batches:
        pairs = []
        for key, kind, rep, text in zip(*(batch.column(c).to_pylist() for c in ("meet", "kind", "rep", "text")), strict=True):
            if key != meet:
                meet, sets = key, []
            own = shingles(text)
            if kind == 0:
                parent = rep
                sets.append(own)
                continue
            for other in sets:
                common = np.intersect1d(own, other, assume_unique=True).size
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    pairs.append((parent, rep, 1.0))
                    break
        yield _edge_batch(pairs)


def _followed(depth: int):
    """From a path (tree, node) the nodes that a document's choices at this depth lead to."""

    def follow(path: Column) -> Column:
        tokens = F.get(F.get(F.col("choices"), path["tree"]), F.lit(depth))
        return F.transform(tokens, lambda x: F.struct(path["tree"].alias("tree"), F.xxhash64(path["node"], x).alias("node")))

    return follow


def _leaves(reps: DataFrame) -> DataFrame:
    """(node, rep, n): the documents of each leaf of all trees with n > 1 documents.

    A leaf is a node of at most NODE_LIMIT documents, or any at the last level. Leaves of the same documents
    are one. The join with the counts gives each row its count, so it has as many rows as before, however large
    a node is, and both sides are written, so that a hot node can be split. A document's paths (bounded by
    the number of trees and levels) follow its choices in one row.
    """
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.transform(F.get(F.get(F.col("choices"), t), F.lit(0)), lambda x: F.struct(t.alias("tree"), F.xxhash64(t, x).alias("node"))))
    level = reps.select("rep", F.explode(F.flatten(trees)).alias("x")).select("rep", "x.tree", "x.node")
    ready = None
    for depth in range(LEVELS):
        counts = written(level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1"), "path-counts")
        level = written(level.join(counts, "node", "left"), "path-level")
        last = depth == LEVELS - 1
        leaves = level.where("n > 1" if last else f"n > 1 and n <= {NODE_LIMIT}").select(F.xxhash64("n", "members").alias("node"), "rep", "n")
        ready = leaves if ready is None else ready.union(leaves)
        large = level.where(F.col("n") > NODE_LIMIT)
        if last or large.isEmpty():
            break
        paths = large.groupBy("rep").agg(F.collect_list(F.struct("tree", "node")).alias("paths")).join(reps.select("rep", "choices"), "rep")
        steps = F.array_distinct(F.flatten(F.transform("paths", _followed(depth + 1))))
        level = written(paths.select("rep", F.explode(steps).alias("x")).select("rep", "x.tree", "x.node"), "path-level")
    return ready


def _joined(rows: DataFrame, others: DataFrame) -> DataFrame:
    """The distinct rows (meet, rep, ...) with the columns of others: these are joined once for each rep, however often it meets."""
    meetings = F.struct(*(c for c in rows.columns if c != "rep"))
    once = rows.groupBy("rep").agg(F.collect_set(meetings).alias("meetings")).join(others, "rep")
    return once.select("rep", *(c for c in others.columns if c != "rep"), F.explode("meetings").alias("m")).select("m.*", "rep", *(c for c in others.columns if c != "rep"))


def _compare(rows: DataFrame, compare) -> DataFrame:
    """Edges of the groups with equal meet, each compared in one task."""
    return rows.repartition("meet").sortWithinPartitions("meet", "rep").mapInArrow(lambda batches: _edges_of(batches, compare), EDGES)


def _in_nodes(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """Likely edges inside leaves; those of more than BLOCK documents are dealt to blocks at random."""
    meet = F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") / BLOCK)))
    return _compare(_joined(leaves.select("rep", meet.alias("meet")), reps.select("rep", "n_shingles", "sketch")), _likely)  # at most one row for each path


def _across(rows: DataFrame, block: int) -> DataFrame:
    """(meet, rep, sub, side) so that documents of one key but different sub meet; rows are (key, rep, sub).

    Keys of one sub are done. In the others the largest sub, whose documents needn't meet each other, is dealt to
    blocks once for each block of the rest, so a key with a huge sub and few others costs its size.
    """
    subs = rows.groupBy("key", "sub").agg(F.count(F.lit(1)).alias("n"))
    split = subs.groupBy("key").agg(F.max_by("sub", F.struct("n", "sub")).alias("giant"), F.max("n").alias("most"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rows = rows.join(written(split, "near-split"), "key")
    large, rest = F.ceil(F.col("most") / block).cast("int"), F.ceil(F.col("others") / block).cast("int")
    in_giant = F.col("sub") == F.col("giant")
    own = F.pmod(F.xxhash64("rep", F.lit(11)), F.when(in_giant, large).otherwise(rest)).cast("int")
    with_giant = lambda g, o: F.xxhash64("key", F.lit(1), g, o)
    each_rest, each_large = F.sequence(F.lit(0), rest - 1), F.sequence(F.lit(0), large - 1)
    giants = F.transform(each_rest, lambda o: with_giant(own, o))
    others = F.concat(F.transform(each_large, lambda g: with_giant(g, own)), F.transform(each_rest, lambda o: F.xxhash64("key", F.lit(0), F.least(o, own), F.greatest(o, own))))
    return rows.select(F.explode(F.when(in_giant, giants).otherwise(others)).alias("meet"), "rep", "sub", F.when(in_giant, 1).otherwise(0).alias("side"))


def _maybe_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows without most of those whose id isn't among ids, by a bitmap of hashed ids of MAP_BITS / 8 = 16 MB at most.

    Only saves the shuffle of a join that follows; that join is what decides.
    """
    n = ids.count()
    bits = min(MAP_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(column, F.lit(3)), F.lit(bits))
    low = F.pmod(place, F.lit(1 << 15))
    bitmap = ids.select(F.shiftright(place, 15).alias("part"), low.alias("low")).groupBy("part").agg(F.bitmap_construct_agg("low").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(low, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("getbit", byte, F.pmod(low, F.lit(8)).cast("int")) == 1
    return rows.withColumn("part", F.shiftright(place, 15)).join(F.broadcast(bitmap), "part").where(there).drop("part", "bits")


def _with_texts(rows: DataFrame, documents: DataFrame) -> DataFrame:
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).where(F.col("rep").isNotNull() & F.col("text").isNotNull())
    return _joined(rows, _maybe_in(texts, rows.select("rep").distinct(), "rep"))


def _confirmed_parents(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Of each document's edges to smaller ids the likeliest, if full sets confirm it.

    The children of one document are dealt to blocks of about CLUSTER_BLOCK, each with the document's text.
    """
    best = written(edges.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")), "near-best")
    children = written(best.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-children")  # so that a hot parent can be split
    dealt = best.join(children, "a").select("a", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CLUSTER_BLOCK))).alias("meet"), "b")
    ends = dealt.select("meet", F.lit(1).alias("kind"), F.col("b").alias("rep")).union(dealt.select("meet", F.lit(0), F.col("a")).distinct())
    rows = _with_texts(written(ends, "near-parents"), documents)
    return rows.repartition("meet").sortWithinPartitions("meet", "kind", "rep").mapInArrow(_confirmed, EDGES)


def _known(ids: DataFrame, found: DataFrame) -> DataFrame:
    """ids with sub, the component that is known of each rep so far."""
    return ids.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*ids.columns, F.coalesce("component", "rep").alias("sub"))


def links(reps: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, component) of all ids that have links, from candidates to confirmed classes.

    Likely edges inside leaves give candidates; the likeliest edge of each document is confirmed on full sets,
    which settles groups of copies at the cost of their size. Only then do blocks of large leaves meet, without
    documents of one candidate class, as these meet next: documents of one class, each time without those that are known
    to hang together.
    """
    leaves = _leaves(reps)
    likely = written(_in_nodes(leaves, reps), "near-likely")
    parents = written(_confirmed_parents(likely, documents), "near-parent-links")
    found = components(parents.select("a", "b"), "near-found")
    classes = components(likely.select("a", "b"), "near-candidates")  # parents are among these edges
    large = leaves.where(F.col("n") > BLOCK).select(F.col("node").alias("key"), "rep").distinct()
    meeting = _joined(_across(written(_known(large, classes), "near-large"), BLOCK), reps.select("rep", "n_shingles", "sketch"))
    more = written(_compare(meeting, _likely), "near-more")
    if not more.isEmpty():
        classes = components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")), "near-candidates")
    unsettled = written(_known(classes.select(F.col("component").alias("key"), F.col("id").alias("rep")), found), "near-classes")
    rest = written(_across(unsettled, CLUSTER_BLOCK), "near-unsettled")
    last = written(_compare(_with_texts(rest, documents), _linked), "near-last")
    if last.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last.select("a", "b")), "near-links")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents."""
    rows = written(sketches(documents), "near-sketches")
    known = rows.where(F.col("fp1").isNotNull() & F.col("doc_id").isNotNull())
    first = F.min_by(F.struct("n_shingles", "choices", "sketch"), "doc_id").alias("first")  # partial results: a hot set is a row for each task
    reps = known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), first)
    reps = written(reps.select("rep", "fp1", "fp2", "first.*"), "near-reps")
    found = links(reps, documents)
    by_set = reps.select("fp1", "fp2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "fp1", "fp2").join(by_set, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep(documents: DataFrame) -> DataFrame:
    """documents without those that are not the first of their class; rows that share an id stay or go together."""
    doomed = classes(documents).where("not kept").select("doc_id").distinct()
    return documents.join(doomed, "doc_id", "left_anti").select(*(f"`{c}`" for c in documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
