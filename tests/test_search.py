"""Searches of the index of word positions against the scan of search texts."""

import pytest
from pyspark.sql import functions as F

from pelagia.operators import filters, store, text_index
from pelagia.operators.filters import FilterSpec

COLUMNS = "id long, positive string, model_name string, filename string, folder string, lyrics string"
ROWS = [
    (1, "a cat on a mat, a cat", "sdxl", "shot_1.png", "gen/a", None),
    (2, "The DOG and a cat", "sdxl", "shot_12.png", "gen/a", "Été indien"),
    (3, None, None, "", None, None),
    (4, "cat", "mat", "mat cat mat mat cat.png", "gen/b", "one two three four"),
    (5, "on a", "mat", "x.png", "", "été"),
    (6, "word " * 5000 + "a cat on", None, "shot_1.mp4", "gen", ""),
    (7, "", "", "___", "!!", "..."),
]
SEARCHES = [
    (("cat",), ()),
    (("a_cat",), ()),
    (("cat_on_a",), ()),
    (("on_a_m",), ()),  # never from one field into the next
    (("mat_mat",), ()),
    (("mat_mat_cat_p",), ()),
    (("shot_1", "ca"), ("dog",)),
    (("ETE",), ("indien",)),
    (("word_word_word",), ()),
    ((), ("cat", "shot_1")),
    ((), ("_",)),
    (("_",), ()),
    (("cat", "cat"), ("a_cat_on", "_")),
    ((), ()),
    (("nowhere",), ()),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, files):
    out = store.shared_dir(spark, "text-index")
    text_index.add(spark, out, files.where("id <= 3"))
    text_index.add(spark, out, files.where("id > 3"))
    return out


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("include, exclude", SEARCHES)
def test_index_finds_what_the_scan_finds(spark, files, folder, include, exclude):
    spec = FilterSpec(include=include, exclude=exclude)
    index = text_index.read(spark, folder)
    assert ids(text_index.search(index, include, exclude, files.select("id"))) == ids(filters.apply(files, spec))
    assert ids(text_index.apply(files, spec, index)) == ids(filters.apply(files, spec))


def test_a_search_pushes_words_and_prefixes_to_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = text_index.search(text_index.read(spark, folder), ("cat_on", "sho"), ("dog",))._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and "token" in line)
    assert "EqualTo(token,cat)" in pushed and "StringStartsWith(token,on)" in pushed and "StringStartsWith(token,dog)" in pushed
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_changes_replace_and_compaction_keeps(spark, files, tmp_path):
    at, now = f"file://{tmp_path}/index", files
    assert ids(text_index.search(text_index.read(spark, at), ("cat",))) == []  # nothing is committed yet
    text_index.add(spark, at, files)
    changes = [({2: "a cat walks"}, [1]), ({2: "no more", 4: None}, []), ({1: "a cat is back"}, [6, 99]), ({}, [2])]
    for texts, gone in changes:
        changed = spark.createDataFrame([(i, t, None, "n.png", "", None) for i, t in texts.items()], COLUMNS)
        text_index.add(spark, at, changed, spark.createDataFrame([(i,) for i in gone], "id long"))
        now = now.join(changed, "id", "left_anti").where(~F.col("id").isin(gone) if gone else F.lit(True)).select(*files.columns).unionByName(changed)
        index = text_index.read(spark, at)
        for include, exclude in ((("a_cat",), ()), (("cat",), ("back",)), ((), ("cat",))):
            assert ids(text_index.search(index, include, exclude, now.select("id"))) == ids(filters.apply(now, FilterSpec(include=include, exclude=exclude)))
    text_index.compact(spark, at)
    small = text_index.read(spark, at)
    assert small.retired.count() == 0 and small.postings.count() == text_index.postings(now).count()
    assert ids(text_index.search(small, ("cat",))) == ids(filters.apply(now, FilterSpec(include=("cat",))))


def test_an_addition_that_was_cut_off_leaves_the_index_as_it_was(spark, files, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/index"
    text_index.add(spark, at, files.where("id = 1"))
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
    with pytest.raises(RuntimeError):
        text_index.add(spark, at, files.where("id = 2"), files.where("id = 1").select("id"))
    monkeypatch.undo()
    assert ids(text_index.search(text_index.read(spark, at), ("cat",))) == [1]
    text_index.add(spark, at, files.where("id = 4"))
    assert ids(text_index.search(text_index.read(spark, at), ("cat",))) == [1, 4]


def test_a_search_without_include_terms_needs_all_ids(spark, folder):
    with pytest.raises(ValueError):
        text_index.search(text_index.read(spark, folder), (), ("cat",))
