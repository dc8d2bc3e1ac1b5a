"""What is moved between tasks grows no faster than the input and lands in no one task."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.llm import collocations
from pelagia.operators import mine, store, text_index, workflow
from pelagia.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_only_approved_terms_are_moved(spark):
    files = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "b"]), (3, None)], "id long, words array<string>")
    approved = spark.createDataFrame([("b",), ("c",), (None,), ("b",)], "term string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent, moved = (mine.postings(files, F.col("words"), approved, **most) for most in ({}, {"most": 1}))
        assert "SortMergeJoin" not in sent._jdf.queryExecution().toString() and "SortMergeJoin" in moved._jdf.queryExecution().toString()
        for rows in (sent, moved):
            assert sorted((r["id"], r["term"]) for r in rows.collect()) == [(1, "b"), (2, "b"), (2, "b"), (2, "c")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_files_without_a_group_are_not_moved_to_one_task(spark):
    plan = registry.QUERIES["full_records"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join LeftOuter" in line and "group_id" in line]


def test_terms_of_several_sources_are_counted_in_one_shuffle(spark):
    files = spark.createDataFrame([(1, ["a", "b"], ["b", "c"], ["b", "a"]), (2, ["b"], None, ["c"]), (3, [], ["c"], [])], "id long, x array<string>, y array<string>, z array<string>")
    found = mine.term_counts(files, {k: F.col(k) for k in "xyz"}, 1, ())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, "x,z"), ("b", 2, "x,y,z"), ("c", 3, "y,z")]


def test_words_are_runs_with_a_letter(spark):
    row = spark.createDataFrame([("12345, 12a b'c ab abc 007 abc\nx9 the 99 cat's", None)], "t string, n string").select(C.words_and_pairs(F.col("t")).alias("t"), C.words_and_pairs(F.col("n")).alias("n"), C.words_and_pairs(F.col("t"), (), 1).alias("all")).first()
    assert row["t"] == ["12a", "b'c", "abc", "12a b'c", "b'c abc", "abc abc", "cat's"] and row["n"] is None or row["n"] == []
    assert row["all"][:5] == ["12a", "b'c", "ab", "abc", "12a b'c"] and "x9 the" in row["all"] and "99" not in row["all"]


def test_rounds_of_walks_move_nothing(spark, monkeypatch):
    graph = '{"1": {"class_type": "KSampler", "inputs": {"positive": ["2", 0], "model": ["4", 0]}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": ["3", 0]}}, "3": {"class_type": "Reroute", "inputs": {"v": ["5", 0]}}, "4": {"class_type": "Reroute", "inputs": {"model": ["6", 0]}}, "5": {"class_type": "Text", "inputs": {"text": "a cat"}}, "6": {"class_type": "UNETLoader", "inputs": {"unet_name": "m.sft"}}}'
    moved, write = {}, store.bucketed

    def bucketed(df, name, key, buckets):
        moved.setdefault(name, []).append("Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, key, buckets)

    monkeypatch.setattr(store, "bucketed", bucketed)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = workflow.facts(spark.createDataFrame([(1, graph, "a.png", "")], "id int, graph string, filename string, stage string"), "id").first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (found["positive"], found["model"]) == ("a cat", "m.sft")
    assert len(moved["graph-round"]) > 2 and len(moved["text-round"]) > 1
    assert not any(any(moved[name]) for name in ("graph-links", "graph-moves", "graph-round", "graph-ends", "text-refs", "text-round", "graph-said"))


def test_walks_send_no_table_through_the_driver(spark, monkeypatch):
    graph = '{"1": {"class_type": "KSampler", "inputs": {"positive": ["2", 0], "seed": 5}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "a cat"}}, "3": {"class_type": "SaveImage", "inputs": {"images": ["1", 0], "filename_prefix": "a"}}}'
    plans, write = {}, store.bucketed

    def bucketed(df, name, key, buckets):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, key, buckets)

    monkeypatch.setattr(store, "bucketed", bucketed)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(name, None) for name in names]
    found = workflow.facts(spark.createDataFrame([(1, graph, "a.png", "")], "id int, graph string, filename string, stage string"), "id")
    plans["files"] = found._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(name, None) for name in names] == before
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]
    assert max(plan.count("Join") for plan in plans.values()) < 24
    assert (found.first()["positive"], found.first()["seed"]) == ("a cat", 5)


def test_the_saver_of_a_file_stands_once_in_the_plan(spark):
    savers = "array<struct<node:string,payload:string,literals:array<string>,names:array<string>>>"
    rows = spark.createDataFrame([([("1", "image", [], ["shot_"]), ("2", "image", ["raw"], []), ("3", "video", [], [])], f, stage) for f, stage in (("shot_1.png", ""), ("x.png", "raw"), ("x.mp4", ""), ("x.png", ""))], f"savers {savers}, filename string, stage string")
    found = rows.select(workflow.saver_of(F.col("savers"), F.col("filename"), F.col("stage"))["node"].alias("node"))
    assert [r["node"] for r in found.collect()] == ["1", "2", "3", None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("video") < 10


@pytest.mark.parametrize("most", [100, 0])
def test_postings_are_sorted_where_they_are_made(spark, monkeypatch, tmp_path, most):
    files = spark.createDataFrame([(i, f"b{i % 7} été a{i} {'long ' * (i % 3)}end", "m") for i in range(60)], "id long, positive string, model_name string").repartition(3)
    monkeypatch.setattr(type(files), "repartitionByRange", lambda *_: pytest.fail("a pass that tells ranges, and postings moved by them"))
    at = f"file://{tmp_path}/index"
    text_index.add(spark, at, files)
    text_index.add(spark, at, files.where("id < 20").withColumn("positive", F.lit("new end")), files.where("id = 30").select("id"))
    moved = []
    monkeypatch.setattr(text_index, "_write", lambda table, *rest, write=text_index._write: (moved.append("SortMergeJoin" in table._jdf.queryExecution().executedPlan().toString()), write(table, *rest)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text_index.compact(spark, at, most)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved[0] == (most == 0)
    for name in ("postings-000000000", "postings-000000002"):
        for part in (tmp_path / "index" / name).glob("*.parquet"):
            rows = [(r["token"], r["id"]) for r in spark.read.parquet(f"file://{part}").collect()]
            assert rows == sorted(rows)
    found = text_index.search(text_index.read(spark, at), ("end",), ("ete_a",)).collect()
    assert sorted(r["id"] for r in found) == list(range(20))
    assert text_index.search(text_index.read(spark, at), ("end",)).count() == 59


@pytest.mark.parametrize("held, batch_codes", [(1 << 21, 1 << 21), (900, 500)])
def test_rare_phrases_are_not_moved(spark, monkeypatch, held, batch_codes):
    rng, texts = random.Random(4), []
    for _ in range(300):
        codes = rng.choices(range(1, 31), k=120)
        for _ in range(3):
            at = rng.randrange(100)
            codes[at : at + 5] = [5, 9, 2, 9, 7]
        texts.append([*codes, 0])
    true = Counter(tuple(t[i : i + k]) for t in texts for k in range(2, 6) for i in range(len(t) - k))
    encoded = spark.createDataFrame([(t,) for t in texts], "codes array<long>").repartition(20)
    two = np.array([p for p, n in true.items() if len(p) == 2 and n >= 20])
    prints = collocations.extended(collocations.fingerprint(two[:, 0].copy()), two[:, 1].copy()).view(np.int64).tolist()
    pairs = collocations.Bitmap(spark.createDataFrame([(p,) for p in prints], "print long"), len(prints))
    moved, group = [], type(encoded).groupBy
    monkeypatch.setattr(type(encoded), "groupBy", lambda df, *by: (moved.append(df), group(df, *by))[1])
    small = {} if held > 1000 else {"held": held, "batch_codes": batch_codes}
    found = {tuple(c for c in row if c) for row in collocations.candidates(encoded, pairs, 20, **small).collect()}
    assert {p for p, n in true.items() if n >= 20} <= found
    assert not small and moved[0].count() < len(true) / 10 or small and len(found) < len(true) / 10


def test_phrases_that_share_a_fingerprint_are_summed_apart(monkeypatch):
    monkeypatch.setattr(collocations, "extended", lambda prints, codes: prints * np.uint64(0))
    rows, n = collocations.summed(np.array([[1, 2], [3, 4], [1, 2], [3, 2], [3, 4], [1, 2]]), np.array([1, 10, 1, 5, 10, 1]))
    assert sorted(zip(map(tuple, rows.tolist()), n.tolist())) == [((1, 2), 3), ((3, 2), 5), ((3, 4), 20)]
    assert len(collocations.summed(np.zeros((0, 2), np.int64), np.zeros(0, np.int64))[1]) == 0


def test_a_place_is_walked_in_one_trie_only(spark):
    rng = random.Random(7)
    texts = [rng.choices([0, *range(1, 13)], k=90) + [0] for _ in range(200)]
    true = Counter(tuple(t[i : i + k]) for t in texts for k in range(2, 6) for i in range(len(t) - k) if 0 not in t[i : i + k])
    rows = [(*p, *[0] * (5 - len(p)), i) for i, (p, n) in enumerate(sorted(true.items())) if n >= 3]
    phrases = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*collocations.CODES, "phrase"]))
    encoded = spark.createDataFrame([(t,) for t in texts], "codes array<long>").coalesce(2)
    dealt = collocations.in_shards(phrases, 4).collect()
    assert len({r["shard"] for r in dealt}) == 4 and len({(r["c1"], r["c2"], r["shard"]) for r in dealt}) == len({(r["c1"], r["c2"]) for r in dealt})
    for shard in range(4):
        mine = collocations.in_shards(phrases, 4).where(F.col("shard") == shard).drop("shard").toArrow()
        found = {r["phrase"]: r["n"] for r in collocations.trie_counts(encoded, mine, shard, 4).collect()}
        assert {i: found[i] for i in mine["phrase"].to_pylist()} == {r[5]: true[tuple(c for c in r[:5] if c)] for r in rows if r[5] in set(mine["phrase"].to_pylist())}
