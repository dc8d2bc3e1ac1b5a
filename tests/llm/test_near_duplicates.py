import random
from collections import Counter

import numpy as np

from pelagia.llm import embedding_dedup, near_dedup
from pelagia.llm.graph import components
from pelagia.llm.hnsw import Graph


def union(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = union(pairs, {x for p in pairs for x in p})
    assert got == {i: expected[i] for i in ids}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked_classes(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    pairs = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return union(pairs, {i for i, _ in sets})


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "Short one"), (4, "short ONE"), (None, "short one"), (5, "a b c d e"), (6, "a b c d e f")], 10
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(20, 200))
        for k in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(k * len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    common = rng.choices(vocabulary, k=60)
    rows += [(n + i, " ".join(common + rng.choices(vocabulary, k=90))) for i in range(120)]  # share a passage, no links
    base = rng.choices(vocabulary, k=300)
    for i in range(150):  # a large group of near copies
        words = list(base)
        words[rng.randrange(300)] = f"v{i}"
        rows.append((n + 200 + i, " ".join(words)))
    rows += [rows[-1]] * 3  # repeated rows
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    expected = linked_classes(list(dict.fromkeys(rows)))
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]], r
            assert r["n_shingles"] == len(shingle_set(texts[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, *expected.values()}
    assert near_dedup.classes(docs.where("false")).count() == 0


def test_large_nodes_branch_and_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(70)]
    got = {r["component_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_documents_of_one_class_do_not_meet_in_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    across, met = near_dedup._across, {}

    def counted(rows, block):
        out = across(rows, block)
        met.setdefault(block, (rows.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "_across", counted)
    base = [f"w{i}" for i in range(120)]
    loose = lambda i: [f"x{i}_{k}" if (k + i) % 24 == 0 else w for k, w in enumerate(base)]  # noqa: E731  alike, but with few links
    rows = [(i, " ".join(loose(i))) for i in range(60)] + [(100 + i, " ".join([*loose(i), f"y{i}"])) for i in range(60)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked_classes(rows)
    leaves, meetings = met[16]
    assert leaves > 500 and meetings <= leaves / 4, met


def brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = Counter(), []
    for n, (a, x) in enumerate(good):
        for b, y in good[n + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return links, union(pairs, {i for i, _ in rows if i is not None})


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(0, None), (1, [0.0] * 8), (2, [float("nan")] + [1.0] * 7), (3, [None] + [1.0] * 7), (4, [float("inf")] * 8), (None, [1.0] * 8), (5, []), (6, [1.0, 2.0])]
    centres = rng.normal(size=(30, 8))
    for i in range(500):
        v = centres[i % 30] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])
        rows.append((10 + i, [float(x) for x in v.astype(np.float32)]))
    rows += [(600 + i, rows[20][1]) for i in range(40)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int")
    links, classes = brute_vectors(rows)
    for shards in (1, 4):
        got = embedding_dedup.near_duplicates(table, shards).collect()
        assert len(got) == len(rows)
        wrong = [r for r in got if r["vec_id"] is not None and (r["n_links"] != links[r["vec_id"]] or r["component_id"] != classes[r["vec_id"]])]
        assert not wrong, wrong[:5]
        assert all(r["kept"] and r["n_links"] == 0 for r in got if r["vec_id"] is None)
    assert sum(links.values()) > 5000
    assert embedding_dedup.near_duplicates(table.where("false")).count() == 0
    _, reps = embedding_dedup.distinct_vectors(table)
    audits = embedding_dedup.search(reps, 4).audits.collect()
    assert sum(r["queries"] for r in audits) > 100 and all(r["recall"] >= 0.99 for r in audits)


def test_large_groups_of_vectors_over_several_shards(spark):
    rng = np.random.default_rng(12)
    hot = rng.normal(size=16) * 3 + rng.normal(size=(900, 16)) * 0.25
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((hot, rng.normal(size=(600, 16)))))]
    links, classes = brute_vectors(rows)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()
    wrong = [r for r in got if r["n_links"] != links[r["vec_id"]] or r["component_id"] != classes[r["vec_id"]]]
    assert max(links.values()) > 512 and len(wrong) <= 0.01 * len(rows), wrong[:5]
    assert sum(r["n_links"] for r in got) % 2 == 0  # each link counts on both sides


def test_graph_recall_on_a_dense_group():
    rng = np.random.default_rng(4)
    v = np.concatenate((rng.normal(size=(1500, 32)), rng.normal(size=32) * 3 + rng.normal(size=(700, 32)) * 0.3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph.build(v.astype(np.float32))
    again = Graph.from_bytes(graph.to_bytes(), v.astype(np.float32))
    shard = embedding_dedup.Shard(np.arange(len(v)), np.ones(len(v), np.int64), v, again)
    exact = v @ v.T >= 0.95
    rows, nodes, dense = shard.search(v, 32)
    found = np.zeros_like(exact)
    found[rows, nodes] = True
    for part, hit in shard.scan(v, dense):
        found[part] = hit
    assert (found & exact).sum() >= 0.995 * exact.sum() and not (found & ~exact).any()


def test_audit_sees_lost_links_of_small_groups(monkeypatch):
    rng = np.random.default_rng(7)
    hot = rng.normal(size=16) * 3 + rng.normal(size=(1500, 16)) * 0.1
    pairs = np.repeat(rng.normal(size=(60, 16)), 2, axis=0)
    pairs[1::2] += rng.normal(size=(60, 16)) * 0.1
    v = np.concatenate((rng.normal(size=(700, 16)), hot, pairs))  # the first of the block have no links
    ids, first_pair = np.arange(len(v)), 2200
    nearest = Graph.nearest

    def lossy(graph, queries, width):  # a search that, with narrow beams, finds large groups and the query itself only
        ids, sims = nearest(graph, queries, width)
        lost = (sims < 0.99999) & ((sims >= 0.9).sum(axis=1, keepdims=True) < 20) & (width < 128)
        return np.where(lost, -1, ids), np.where(lost, -2.0, sims)

    monkeypatch.setattr(embedding_dedup.Graph, "nearest", lossy)
    shard = embedding_dedup.Shard.build(ids, np.ones(len(v), np.int64), v)
    again = embedding_dedup.Shard.from_bytes(shard.to_bytes())
    counts, _, root, audits = embedding_dedup.link_counts(again, again, True)
    assert (counts[first_pair:] == 1).all() and (np.diff(root[first_pair:].reshape(-1, 2), axis=1) == 0).all()
    assert audits[0][0] >= 128 and audits[0][1] > 0


def test_parts_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    root = np.arange(400)
    embedding_dedup.merge(root, a, b)
    expected = union(list(zip(a.tolist(), b.tolist(), strict=True)), range(400))
    assert root.tolist() == [expected[i] for i in range(400)]
