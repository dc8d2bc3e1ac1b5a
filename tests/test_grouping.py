"""Groups and model families on names made up for each rule."""

from pelagia.operators import grouping

FILES = [
    # (expected group or None, root, folder, filename, set_id)
    ("roles", "r", "a", "Cat_1 MAIN_0001.png", None), ("roles", "r", "a", "Cat_2 DET_0001.png", None), ("roles", "r", "a", "cat_3 refine_0001.png", None),
    ("pair", "r", "a", "Dog_BASE_01.png", None), ("pair", "r", "a", "dog-interp 01.mp4", None),
    ("muxed", "r", "a", "run_Final_9.png", None), ("muxed", "r", "a", "run_Final_9-audio.mp4", None),
    ("set", "r", "b", "one.png", "S1"), ("set", "r", "c", "two.png", "S1"), ("set", "r", "b", "clip.mp4", "S1"),
    ("other root", "q", "b", "three.png", "S1"), ("other root", "q", "b", "four.png", "S1"),
    (None, "r", "b", "alone.png", "S2"), (None, "r", "b", "plain_7.png", None), (None, "r", "b", "", None),
    ("id first", "r", "e", "x_1 MAIN_1.png", "S4"), ("id first", "r", "e", "x_2 DET_1.png", "S4"),
    ("code", "r", "g", "M~vvk3n9x7_Final_1.png", None), ("code", "r", "h", "M~VVK3N9X7_Raw_3.png", None), ("code", "r", "g", "m~vvk3n9x7_9.mp4", None),
    ("code 1", "r", "h", "N~vva00001_1.png", None), ("code 1", "r", "h", "N~vva00001_1.mp4", None), ("code 2", "r", "h", "N~vva00002_1.png", None), ("code 2", "r", "h", "N~vva00002_1.mp4", None),
    ("tilde", "r", "j", "sea~side_1.png", None), ("tilde", "r", "j", "sea~side_1.mp4", None),
    (None, "r", "k", "solo~vvc00001_1.png", None),
    (None, "r", "l", "twice MAIN_1.png", None), (None, "r", "m", "twice DET_1.png", None),  # folders differ
    (None, "r", "n", "y 1999 MAIN.png", None), (None, "r", "n", "y 2000 DET.png", None),  # years are no ordinals
]


def test_groups(spark):
    rows = [(i, root, folder, name, "." + name.rpartition(".")[2] if name else "", set_id) for i, (_, root, folder, name, set_id) in enumerate(FILES)]
    files = spark.createDataFrame(rows, "id long, root_id string, folder string, filename string, ext string, set_id string")
    got = {r["id"]: r["group_id"] for r in grouping.regroup(files).collect()}
    assert len(got) == len(FILES) and all(g is None or len(g) == 12 for g in got.values())
    by_name = {}
    for i, (expected, *_) in enumerate(FILES):
        assert (got[i] is None) == (expected is None), FILES[i]
        by_name.setdefault(expected, set()).add(got[i])
    found = [v for k, v in by_name.items() if k]
    assert all(len(v) == 1 for v in found) and len(set.union(*found)) == len(found)
    assert grouping.regroup(files.where("false")).count() == 0


MODELS = [
    ("Pony\\a_sdxl.safetensors", "Pony"), ("SDXL/b.ckpt", "SDXL"), ("krea 2\\c.gguf", "Krea"), ("Krea/d.gguf", "Krea"), ("Krea/e.gguf", "Krea"), ("krea2/f.gguf", "Krea"), ("SD15/g.ckpt", "SD15"), ("SD/h.ckpt", "SD"), ("Qwen3/i.gguf", "Qwen"),
    ("flux_9.safetensors", "flux"), ("myPonyMix_v3.safetensors", "Pony"), ("a-wan.safetensors", "wan"), ("qwenEdit.gguf", "Qwen"), ("reflux.safetensors", ""), ("unknown.ckpt", ""),
]


def test_model_families(spark):
    rows = [(i, m, m) for i, (m, _) in enumerate(MODELS)] + [(99, None, None), (98, "", "x")]
    files = spark.createDataFrame(rows, "id long, model string, model_name string")
    got = {r["id"]: r["model_type"] for r in grouping.model_types(files).collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(MODELS)}
    assert grouping.model_types(files.where("false")).count() == 0
