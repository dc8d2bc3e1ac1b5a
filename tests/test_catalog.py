"""Scenarios on small hand-made catalogs."""

import pytest
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.operators import cards, curate, curation, facets, filters
from pelagia.operators.filters import FilterSpec
from pelagia.plans import registry

COLUMNS = "id long, root_id string, folder string, model_name string, model_type string, filename string, ext string, group_id string, set_stage string, mtime long, width int, height int, positive string, reward int, size long"


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for i in range(120):
        ext = ".mp4" if i % 23 == 0 else ".mp3" if i % 31 == 0 else ".png"
        model = [None, "sdxl_a", "pony_b", "flux_c"][i % 4]
        rows.append((i, f"r{i % 3}", f"gen/{i % 6:03}", model, model and model.split("_")[0].title(), f"f_{i}{ext}", ext, f"g{i // 4}" if i % 5 else None, ["Final", "raw", "", "First"][i % 4], 1000 + i, 1000, 1000 + i, f"café word{i % 7} blue_sky", i % 3 or None, 10 + i))
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(model="pony_b"), FilterSpec(model="(none)"), FilterSpec(mtype="flux", roots=("r1",)), FilterSpec(folder="gen/001", model="sdxl_a"), FilterSpec(include=("word3",), mtype="pony")])
def test_one_scan_facets_equal_one_query_each(files, spec):
    got = {(r["dim"], r["value"]): r["n"] for r in facets.facets(files, spec).collect()}
    expected = {}
    for dim, column in (("model", "model_name"), ("mtype", "model_type"), ("folder", "folder"), ("root", "root_id")):
        blind = {"root": {"roots": ()}}.get(dim, {dim: ""})
        value = F.coalesce(F.lower(column) if dim == "mtype" else F.col(column), F.lit("(none)"))
        narrowed = filters.apply(files, spec.without(*blind))
        expected |= {(dim, r["v"]): r["count"] for r in narrowed.groupBy(value.alias("v")).count().collect()}
    total = filters.apply(files, spec).count()
    if total:
        expected["total", ""] = total
    assert got == expected


@pytest.mark.parametrize("pairs", [True, False])
@pytest.mark.parametrize("sets", [True, False])
def test_counts_equal_the_cards_shown(files, pairs, sets):
    for spec in (FilterSpec(), FilterSpec(model="flux_c"), FilterSpec(kind="video")):
        matched = filters.apply(files, spec)
        row = cards.counts(matched, pairs, sets).first()
        shown = cards.collapse(cards.with_cards(matched, pairs, sets), sets_only=pairs != sets).collect()
        assert row["cards"] == len(shown) and row["files"] == sum(r["group_count"] for r in shown)


def test_songs_front_their_covers_and_hide_from_pair_views(spark):
    rows = [(1, "g1", "a.mp3", ".mp3"), (2, "g1", "a.png", ".png"), (3, "g2", "b.mp4", ".mp4"), (4, "g2", "b-audio.mp4", ".mp4"), (5, "g2", "b.png", ".png"), (6, None, "c.png", ".png")]
    files = spark.createDataFrame([(*r, None, 1, 1, None, 1, 1) for r in rows], "id long, group_id string, filename string, ext string, set_stage string, mtime long, size long, reward int, width int, height int")
    found = {r["card"]: r for r in cards.collapse(cards.with_cards(files)).collect()}
    assert (found["g1"]["id"], found["g2"]["id"], found["g2"]["video_id"], found["i6"]["group_count"]) == (1, 5, 4, 1)
    pairs_only = cards.collapse(cards.with_cards(files, True, False), sets_only=True).collect()
    assert [r["card"] for r in pairs_only] == ["g2"]
    assert cards.collapse(cards.with_cards(files, False, True), sets_only=True).count() == 0


def test_generic_song_names_are_told_by_all_files(spark, tmp_path):
    docs = [(62, "one two three\nfour", "aa"), (61, "x", "aa"), (124, "five six seven", "bb"), (127, "x", "bb")]  # 61 alone makes aa generic
    spark.createDataFrame([(i, t, lang, "src", len(t)) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.QUERIES["song_cards"](spark, str(tmp_path)).collect()
    assert {r["id"]: r["headline"] for r in found} == {62: "one two three", 124: "bb"}


def test_face_prefers_later_names_favourites_and_scores(spark):
    rows = [(1, "a.png", None), (2, "b.png", 1), (3, "b.png", 5), (4, "b.png", None)]
    files = spark.createDataFrame([(i, "g", n, ".png", "raw", 1, 1, r) for i, n, r in rows], "id long, card string, filename string, ext string, set_stage string, mtime long, size long, reward int")
    assert cards.collapse(files).first()["id"] == 3
    fav = spark.createDataFrame([(2,)], "image_id long")
    assert cards.collapse(files, favourites=fav).first()["id"] == 2


STAGES = [("Final", "a", 0), ("Upscale", "a", 1), ("Refine", "a", 2), ("Detail", "a", 3), ("Raw", "a", 4), ("Sketch", "a_final", 5), ("Detail9", "a", 5), ("main", "a", 4), ("det", "a", 3), ("", "b 3 Refine 7", 2), ("", "b 2 det 7", 3), ("", "b 1 MAIN 7", 4), (None, "nothing", 5)]


def test_face_rank_of_stages_and_names(spark):
    rows = spark.createDataFrame([(i, s, f"{n}.png", e) for i, (s, n, e) in enumerate(STAGES)], "id int, stage string, name string, expected int")
    got = rows.select("stage", "name", "expected", C.face_rank(F.col("stage"), F.col("name")).alias("rank"), C.stage_rank(F.col("stage")).alias("pane")).collect()
    assert all(r["rank"] == r["expected"] for r in got)
    assert [r["pane"] for r in got] == [4, 3, 2, 1, 0, -1, -1, 0, 1, 5, 5, 5, 5]


def test_typed_bounds_that_are_no_numbers_ask_for_nothing():
    spec = filters.from_params({"rmin": "x", "rmax": "2.5", "after": "", "before": "nan", "q": " a  b ", "tags": "X, y,", "unknown": "1", "coll": "7"})
    assert (spec.least_score, spec.most_score, spec.after, spec.before) == (None, 2.5, None, None)
    assert (spec.include, spec.tags, spec.collection) == (("a", "b"), ("X", "y"), 7)


def test_search_terms_end_at_anything_but_letters_digits_and_underscores(files):
    assert filters.from_params({"q": "cat,dog big_red (x)", "x": "_ a-b"}) == FilterSpec(include=("cat", "dog", "big_red", "x"), exclude=("_", "a", "b"))
    assert filters.apply(files, FilterSpec(include=("_",))).count() == 0
    assert filters.apply(files, FilterSpec(exclude=("_",))).count() == files.count()


def test_hidden_files_stay_hidden_in_matching_cards(files):
    spec = FilterSpec(model="flux_c", pending=(6,))
    shown = filters.cards_matching(files, filters.apply(files, spec), spec)
    assert {r["id"] for r in shown.where("card = 'g1'").collect()} == {4, 7}


def test_matching_member_admits_its_card_and_the_face_is_the_best(files):
    matched = filters.apply(files, FilterSpec(model="pony_b"))
    found = {r["card"]: r for r in cards.collapse(filters.cards_matching(files, matched)).collect()}
    assert found["g1"]["group_count"] == 3  # ids 4, 6, 7: id 5 has no group
    assert found["g1"]["id"] == 4  # Final before raw, blank and First


@pytest.mark.parametrize(("width", "height", "shape"), [(1000, 1000, "square"), (1024, 1004, "square"), (1024, 1045, "portrait"), (1045, 1024, "landscape"), (None, 5, None), (0, 5, None)])
def test_aspect(spark, width, height, shape):
    row = spark.createDataFrame([(width, height)], "w int, h int").select(C.aspect(F.col("w"), F.col("h")).alias("a")).first()
    assert row["a"] == shape


def test_text_search_rules(spark):
    row = spark.createDataFrame([("Café au lait, foo barista it's",)], "t string")
    hit = lambda term: row.select(C.has_term(C.search_text(F.col("t"), F.lit("next")), term).alias("h")).first()["h"]
    assert hit("CAFÉ") and hit("cafe") and hit("lai") and hit("foo_bar") and hit("it's")
    assert not hit("bar_foo") and not hit("ait") and not hit("not") and not hit("s_next") and not hit("_")


def test_dml_and_merges(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tag string")
    more = spark.createDataFrame([(2, "b"), (2, "c"), (2, "c")], "id long, tag string")
    assert sorted(map(tuple, curate.insert_ignore(stored, more, ["id", "tag"]).collect())) == [(1, "a"), (2, "b"), (2, "c")]
    notes = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 3, "x"), (1, 4, None), (2, 1, None)], "k long, t long, n string")
    assert [tuple(r) for r in curate.merge_notes(notes, "k", ["t"], "n", " | ").collect()] == [(1, "y | x")]
    newest = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2)], "id long, tag string, at int")
    assert [tuple(r) for r in curate.upsert(newest.where("false"), newest, ["id"], "at").collect()] == [(1, "y", 3)]
    empty = stored.where("false")
    assert curate.upsert(empty, stored, ["id"]).count() == 2 and curate.upsert(stored, empty, ["id"]).count() == 2


def test_rename_plan_avoids_names_on_disk(spark):
    names = {1: "a.png", 2: "b.png", 3: "A.png", 4: "new_b.png", 5: "x_a.png", 6: "x_A.png", 7: "x_c.png", 8: "x_C.PNG", 9: "x_a_4.png", 10: "Same.png"}
    disk = spark.createDataFrame([(i, "f", n) for i, n in names.items()] + [(11, "f", "a_2.png"), (12, "g", "a.png"), (13, "f", "a_007.png")], "id long, folder string, filename string")
    picked = disk.where("id >= 5 AND id <= 10")
    plan = {r["id"]: r["new_name"] for r in curate.rename_plan(picked, "x_", "", disk).collect()}
    # a.png and a_2.png exist, a_4.png is wanted by another file
    assert plan == {5: "a_3.png", 6: "A_5.png", 7: "c.png", 8: "C_2.PNG", 9: "a_4.png", 10: "Same.png"}
    case_only = spark.createDataFrame([(1, "f", "Cat.png"), (2, "f", "dog_Cat.png")], "id long, folder string, filename string")
    plan = {r["id"]: r["new_name"] for r in curate.rename_plan(case_only, "Cat", "cat").collect()}
    assert plan == {1: "cat.png", 2: "dog_cat.png"}


def test_saved_searches_keep_what_is_known():
    kept = filters.saved([{"name": "  a  b ", "params": {"q": "x", "bad": 1, "tags": ["a"] * 150, "fav": True, "sets": "0"}}, {"name": "", "params": {}}, {"name": "c", "params": None}])
    assert len(kept) == 1 and kept[0]["name"] == "a b"
    assert kept[0]["params"] == {"group": "1", "sets": "0", "q": "x", "tags": ",".join(["a"] * 100), "fav": "1"}


def test_selections_expand_to_whole_cards(files):
    picked = files.where("id in (4, 5)").select("id")
    assert [r["id"] for r in cards.expand(picked, files).collect()] == [4, 5, 6, 7]


def test_culls_follow_one_example(spark):
    rows = [(1, "g1", "r", "f", "a.png", ".png", "Raw"), (2, "g1", "r", "f", "b.png", ".png", "Final"), (3, "g2", "r", "f", "x_1 MAIN_1.png", ".png", ""), (4, "g2", "r", "f", "y.png", ".png", "final"), (5, "g3", "r", "f", "c.png", ".png", "Raw"), (6, "g3", "r", "other", "d.png", ".png", "Final"), (7, "g4", "r", "f", "e.mp4", ".mp4", "Raw"), (8, "g4", "r", "f", "e.png", ".png", "Final"), (9, "g5", "r", "f", "h.png", ".png", "Raw"), (10, "g5", "r", "f", "i.png", ".png", "Raw")]
    catalog = spark.createDataFrame(rows, "id long, group_id string, root_id string, folder string, filename string, ext string, set_stage string")
    plan = {r["id"]: r["keep"] for r in curation.cull_plan(catalog, 1, "FINAL").collect()}
    assert plan == {1: False, 2: True, 3: False, 4: True}
    tags = spark.createDataFrame([(1, "t", "user", None)], "image_id long, tag string, source string, score double")
    notes, quality = spark.createDataFrame([(3, "n")], "id long, note string"), spark.createDataFrame([(4, 1.0)], "image_id long, reward double")
    out = curation.cull(curation.cull_plan(catalog, 1, "final"), catalog.withColumn("mtime", F.col("id")), tags, notes, quality)
    assert {r["id"] for r in out["files"].collect()} == {2, 4, 5, 6, 7, 8, 9, 10}
    assert [(r["image_id"], r["tag"]) for r in out["tags"].collect()] == [(2, "t")] and [(r["id"], r["note"]) for r in out["notes"].collect()] == [(4, "n")]
    for anchor, role in ((1, "refine"), (9, "raw"), (99, "raw")):
        with pytest.raises(ValueError):
            curation.cull_plan(catalog, anchor, role)


def test_merging_keeps_what_the_keeper_has(spark):
    catalog = spark.createDataFrame([(i, float(10 - i)) for i in range(1, 6)], "id long, mtime double")
    tags = spark.createDataFrame([(1, "a", "user", 0.5), (2, "a", "user", 0.1), (2, "b", "ext:t", 0.2), (3, "label:refine", "user", None), (2, "label:publish", "user", None), (5, "label:explore", "user", None), (4, "label:video", "user", None)], "image_id long, tag string, source string, score double")
    notes = spark.createDataFrame([(1, "mine"), (2, " other "), (3, "mine"), (5, None)], "id long, note string")
    quality = spark.createDataFrame([(2, None), (3, 7.0)], "image_id long, reward double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "keeper long, doomed long")
    out = curation.merge_curation(pairs, catalog, tags, notes, quality)
    mine = sorted((r["tag"], r["score"]) for r in out["tags"].where("image_id = 1").collect())
    assert mine == [("a", 0.5), ("b", 0.2), ("label:refine", None)]  # 3 is older than 2
    assert [r["tag"] for r in out["tags"].where("image_id = 4").collect()] == ["label:video"]
    assert {r["id"]: r["note"] for r in out["notes"].collect()}[1] == "mine\n\n— merged from a deleted copy —\nother"
    assert {r["image_id"]: r["reward"] for r in out["quality"].collect()} == {1: 7.0, 2: None, 3: 7.0}


def test_gaps_are_those_between_neighbours(spark):
    rows = [("a", 0.0), ("a", 0.9), ("a", 1.8), ("a", 2.9), ("a", 3.79), ("b", 1.0), ("b", 1.0), ("b", 5.5), (None, 1.0), (None, 9.0), ("c", None), ("c", 1.0), ("c", 1.2)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, t double")
    got = {r["id"]: r["cluster"] for r in curate.gap_clusters(table, ["k"], F.col("t"), 1.0).collect()}
    assert [got[i] for i in range(13)] == [0, 0, 0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 0]


def test_band_pairs_of_a_frequent_key_are_those_near_in_time(spark):
    times = [-2.1, -2.0, -1.9, -1.05, -1.0, -0.95, -0.05, 0.0, 0.1, 0.1, 0.95, 1.0, 1.0999999, 1.1, 2.0, 2.9, 3.0, 3.05, None, float("nan")]
    rows = [(i, "hot" if i != 8 else None, t) for i, t in enumerate(times)]
    table = spark.createDataFrame(rows, "id long, k string, t double")
    anchors = table.where("id % 3 = 0 or id in (8, 11)")
    for gap in (1.0, 0.1, 30.0):
        found = sorted(map(tuple, curate.band_pairs(anchors, table, ["k"], "t", gap, "id").collect()))
        near = lambda x, y: x[1] == y[1] == "hot" and x[2] is not None and y[2] is not None and abs(x[2] - y[2]) < gap and x[0] != y[0]  # noqa: B023, E731
        assert found == [(x[0], y[0]) for x in rows if x[0] % 3 == 0 or x[0] in (8, 11) for y in rows if near(x, y)]
