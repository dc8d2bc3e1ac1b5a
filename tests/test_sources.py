import json
import os
import shutil
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import generation
from pelagia.operators import extensions, ingest, store
from pelagia.sources import containers, listing, walk
from pelagia.streaming import watch


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(texts):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0))
    body = b"".join(chunk(b"tEXt", k.encode() + b"\0" + v.encode("latin-1")) for k, v in texts.items())
    return b"\x89PNG\r\n\x1a\n" + head + body + chunk(b"zTXt", b"z\0\0" + zlib.compress(b"packed")) + chunk(b"iTXt", b"i\0\0\0en\0\0" + "é".encode()) + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(comment):
    mvhd = box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500) + bytes(80))
    track = box(b"trak", box(b"tkhd", bytes(76) + struct.pack(">II", 320 << 16, 240 << 16)))
    keys = box(b"keys", bytes(4) + struct.pack(">I", 1) + box(b"mdta", b"comment"))
    ilst = box(b"ilst", box(struct.pack(">I", 1), box(b"data", bytes(8) + comment.encode())))
    return box(b"ftyp", b"isom") + box(b"moov", mvhd + track + box(b"udta", box(b"meta", bytes(4) + keys + ilst))) + box(b"mdat", b"x")


def id3():
    frame = lambda k, b: k + struct.pack(">I", len(b)) + b"\0\0" + b
    body = frame(b"TIT2", b"\x03Title") + frame(b"TXXX", b"\x03prompt\0a cat")
    return b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body


def flac():
    info = bytes(10) + (44100 << 44 | 88200).to_bytes(8, "big") + bytes(16)
    comment = b"KEY=a\xc3\xa9"
    vorbis = struct.pack("<I", 1) + b"v" + struct.pack("<II", 1, len(comment)) + comment
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([132]) + len(vorbis).to_bytes(3, "big") + vorbis


def test_walk_and_containers(spark, tmp_path):
    for name, data in {"a/x.png": png({"parameters": "hi"}), "a/b/y.mp4": mp4("note"), "z.mp3": id3(), "q.flac": flac(), "bad.png": b"\x89PNG\r\n\x1a\n\0\0\0\0", "w.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = walk.walk_media(spark, f"file://{tmp_path}")
    assert {r["filename"] for r in files.collect()} == {"x.png", "y.mp4", "z.mp3", "q.flac", "bad.png"}
    assert walk.walk_folders(spark, [f"file://{tmp_path}/a"]).count() == 1
    assert {r["n"] for r in walk.folder_signature(files).collect()} == {1, 3}
    got = {r["path"].rsplit("/", 1)[1]: r for r in containers.extract(walk.contents(spark, f"file://{tmp_path}")).collect()}
    assert (got["x.png"]["width"], got["x.png"]["height"], got["x.png"]["texts"]) == (640, 480, {"parameters": "hi", "z": "packed", "i": "é"})
    assert (got["y.mp4"]["width"], got["y.mp4"]["duration"], got["y.mp4"]["texts"]) == (320, 2.5, {"comment": "note"})
    assert got["z.mp3"]["texts"] == {"TIT2": "Title", "prompt": "a cat"}
    assert got["q.flac"]["texts"] == {"key": "aé"} and got["q.flac"]["duration"] == 2.0
    assert got["bad.png"]["texts"] == {}


def test_sidecars_and_resolution(spark):
    files = spark.createDataFrame([("d/a.png",), ("d/b_00001.png",), ("d/c~vvabc123_x.png",), ("d/e.png",)], "path string")
    sidecars = spark.createDataFrame([("d/a.png.txt", "1"), ("d/a.txt", "2"), ("d/b.txt", "3"), ("d/c~vvabc123.txt", "4")], "path string, text string")
    assert {r["path"]: r["sidecar"] for r in walk.with_sidecars(files, sidecars).collect()} == {"d/a.png": "1", "d/b_00001.png": "3", "d/c~vvabc123_x.png": "4", "d/e.png": None}
    models = spark.createDataFrame([("m/x.safetensors",), ("n/x.safetensors",), ("k/y.ckpt",)], "path string")
    wanted = spark.createDataFrame([("n\\x.safetensors",), ("x.safetensors",), ("y",), ("nope",)], "raw string")
    assert {r["raw"]: r["path"] for r in walk.resolve(wanted, models).collect()} == {"n\\x.safetensors": "n/x.safetensors", "x.safetensors": "m/x.safetensors", "y": "k/y.ckpt", "nope": None}
    placed = spark.createDataFrame([("loras/a/x.pt",), ("checkpoints/x.pt",), ("unet/X.ckpt",)], "path string")
    found = walk.resolve(spark.createDataFrame([("x.pt",), ("a\\x.pt",), ("x",)], "raw string"), placed, ["unet", "checkpoints"])
    assert {r["raw"]: r["path"] for r in found.collect()} == {"x.pt": "checkpoints/x.pt", "a\\x.pt": "checkpoints/x.pt", "x": "unet/X.ckpt"}
    assert walk.reachable(spark, "file:///tmp") and not walk.reachable(spark, "file:///no/such/folder")


CAPTIONS = [
    (None, None, None, None, None),
    ("quiet", None, None, None, None),
    ("Global metadata: Drum and Bass / Jungle. It runs at 120 BPM in C# minor. Singer A (Female).", 120, "C♯ minor", "Drum and Bass / Jungle", "female"),
    ("Basic attributes. Vocal. bpm is 87; key is B flat, and scale is Minor. Slow Country. The vocals are soft and androgynous.", 87, "B♭ minor", "Slow Country", "androgynous"),
    ("A warm piece of music at 90 bpm. Vocal is female. Arrangement.", 90, None, None, "female"),
    ("Techno. One. Two. Three. Four. 99 BPM.", 99, None, "Three", None),
    ("The male lead of the story sits far away from any word about the singing of it all. " * 2 + "vocals", None, None, None, None),
]


def test_songs(spark):
    rows = spark.createDataFrame([(c,) for c, *_ in CAPTIONS], "c string")
    got = [tuple(r["f"]) for r in rows.select(generation.song_facts(F.col("c")).alias("f")).collect()]
    assert got == [tuple(x) for _, *x in CAPTIONS]


def test_side_files(spark, tmp_path):
    for name, text in {"a.txt": "cat\nNegative prompt: dog\nVV set id: S 1\n vv_set_stage : Final \n", "_ToRecycle/b.png": "x", "big.txt": "x" * 70_000, "c.png": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (found,) = walk.sidecars(spark, f"file://{tmp_path}").collect()
    assert (found["set_id"], found["set_stage"], found["text"].strip()) == ("S 1", "Final", "cat\nNegative prompt: dog")
    assert [r["filename"] for r in walk.walk_media(spark, f"file://{tmp_path}").collect()] == ["c.png"]
    files, bad = walk.walk_some(spark, [f"file://{tmp_path}", f"file://{tmp_path}/gone"])
    assert files.count() == 1 and bad == [f"file://{tmp_path}/gone"]


def tiff(entries, comment=b"", order="<"):
    """Two texts in the first folder and a comment in the second."""
    pack = lambda *x: struct.pack(order + "HHII", *x)
    at, head, tail = 8 + 2 + 12 * (len(entries) + 1) + 4, b"", b""
    for tag, value in entries:
        head += pack(tag, 2, len(value), at + len(tail))
        tail += value
    head += pack(containers.EXIF_PART, 4, 1, at + len(tail))
    tail += struct.pack(order + "H", 1) + pack(containers.USER_COMMENT, 7, len(comment), at + len(tail) + 18) + bytes(4) + comment
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + struct.pack(order + "H", len(entries) + 1) + head + bytes(4) + tail


def jpeg(exif):
    body = b"Exif\0\0" + exif
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40) + bytes(12) + b"\xff\xda"


def webp(*parts):
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("mark", "coding"), [(b"UNICODE\0", "utf-16-be"), (b"UNICODE\0", "utf-16-le"), (b"ASCII\0\0\0", "utf-8"), (b"", "utf-8")])
def test_texts_in_exif(order, mark, coding):
    exif = tiff([(containers.MAKE, b'prompt:{"1": {}}\0'), (containers.MODEL, b"workflow:none\0")], mark + "plain text, Steps: 2".encode(coding), order)
    for data in (jpeg(exif), webp((b"VP8X", bytes([2]) + bytes(3) + struct.pack("<I", 39)[:3] + struct.pack("<I", 29)[:3]), (b"EXIF", exif))):
        found = containers.describe(data)
        assert found["texts"] == {"prompt": '{"1": {}}', "parameters": "plain text, Steps: 2"}
        assert (found["width"], found["height"]) == (40, 30)
    assert found["animated"]


def test_damage_and_covers():
    bad = chunk(b"zTXt", b"bad\0\0broken")
    data = png({"a": "b"})
    at = data.index(b"IDAT") - 4
    found = containers.describe(data[:at] + bad + data[at:])
    assert found["texts"] == {"a": "b", "z": "packed", "i": "é"}
    gif = b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0, 0, 0) + (b"!\xf9\x04\0\0\0\0\0" + b"," + bytes(9) + b"\x02\x01x\0") * 2 + b";"
    assert containers.describe(gif) == {"width": 5, "height": 6, "animated": True, "texts": {}}
    frame = lambda k, b: k + struct.pack(">I", len(b)) + b"\0\0" + b
    body = frame(b"APIC", b"\0image/png\0\x00other\0XX") + frame(b"APIC", b"\x01image/jpeg\0\x03" + "c".encode("utf-16") + b"\0\0YY")
    assert containers.cover_of(b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body) == ("image/jpeg", b"YY")
    picture = struct.pack(">II", 3, 9) + b"image/png" + struct.pack(">I", 0) + bytes(16) + struct.pack(">I", 2) + b"ZZ"
    assert containers.cover_of(b"fLaC" + bytes([0x86]) + len(picture).to_bytes(3, "big") + picture) == ("image/png", b"ZZ")
    assert containers.cover_of(data) is None and containers.describe(b"") == {"texts": {}}
    for head in (data, mp4("x"), id3(), flac(), jpeg(tiff([])), gif):
        for n in range(0, len(head), 7):  # cut files give less, or an error of their own
            try:
                containers.describe(head[:n])
            except (ValueError, IndexError, struct.error):
                pass


def test_waves():
    sound = np.concatenate([np.full(100, i * 300, "<i2") for i in range(96)])
    data = b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(sound) * 2) + sound.tobytes()
    found = containers.describe(data)
    assert found["duration"] == 1.2 and found["peaks"] == [round(100 * i / 95) for i in range(96)]
    assert set(containers.describe(data[:44])["peaks"]) == {0} and containers.describe(data[:30]) == {"texts": {}}  # sound that is missing is silent


def test_png_export(spark):
    data = png({"parameters": "old", "prompt": "{}"})
    rows = spark.createDataFrame([("a.png", data, "neu ☃"), ("b.png", data, None), ("c.jpg", b"no", "x"), ("d.png", None, "x")], "path string, content binary, parameters string")
    got = {r["path"]: r["content"] for r in containers.export_png(rows).collect()}
    assert containers.describe(bytes(got["a.png"]))["texts"] == {"parameters": "neu ☃", "prompt": "{}", "z": "packed", "i": "é"}
    assert (bytes(got["b.png"]), bytes(got["c.jpg"]), got["d.png"]) == (data, b"no", None)
    assert bytes(got["a.png"]).endswith(data[data.index(b"IDAT") - 4 :])


def test_ingest_of_a_folder(spark, tmp_path):
    facts = "cat\nSteps: 4, Model: m"
    for name, data in {"a/x.png": png({"parameters": facts}), "a/y.mp4": mp4("note"), "bad.png": b"\x89PNG\r\n\x1a\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    walked = walk.walk_media(spark, f"file://{tmp_path}")
    fresh = ingest.file_facts(walked)
    first = ingest.scan(fresh.drop("error").where("false"), walked)
    got = {r["filename"]: r for r in first.files.collect()}
    assert (got["x.png"]["positive"], got["x.png"]["steps"], got["x.png"]["has_meta"], got["x.png"]["width"]) == ("cat", 4, 1, 640)
    assert {r["state"]: r["n"] for r in first.counters().collect()} == {"new": 3}
    stored = store.write_version(first.files, f"file://{tmp_path}/versions", 1)
    (tmp_path / "a/x.png").unlink()
    again = ingest.scan(stored, walk.walk_media(spark, f"file://{tmp_path}"))
    assert {r["state"]: r["n"] for r in again.counters().collect()} == {"unchanged": 2, "gone": 1} and again.files.count() == 2
    walked = walk.walk_media(spark, f"file://{tmp_path}")
    nothing = walked.where("false")
    assert ingest.scan(stored, nothing).files.count() == 3  # an empty walk removes nothing
    assert ingest.scan(stored, nothing.union(walked.where("filename = 'bad.png'")), folders=[f"file:{tmp_path}"]).files.count() == 3
    assert ingest.scan(stored, walked.where("filename = 'bad.png'"), complete=False).files.count() == 3


def test_a_file_that_fails_keeps_its_row(spark):
    columns = "path string, folder string, filename string, ext string, mtime double, size long, width int, duration double"
    stored = spark.createDataFrame([("a", "f", "a", ".png", 1.0, 1, 5, None)], columns)
    walked = spark.createDataFrame([("a", "f", "a", ".png", 2.0, 1, None, None), ("b", "f", "b", ".png", 1.0, 1, None, None)], columns)
    done = ingest.scan(stored, walked, lambda rows: rows.withColumn("error", F.lit("damaged")))
    assert [r["width"] for r in done.files.collect()] == [5]
    assert {r["state"]: r["n"] for r in done.counters().collect()} == {"changed": 1, "new": 1, "failed": 2}
    assert ingest.read_rate(500, 10, True) == 50 and ingest.read_rate(100, 1, True) is None and ingest.full_scan_due(None, 5)


def test_extension_settings_and_posts(spark):
    declared = [extensions.Setting("size", "number", 3), extensions.Setting("loud", "flag"), extensions.Setting("mode", "choice", "a", ("a", "b")), extensions.Setting("title", "text", "t")]
    assert extensions.settings_from(declared, {"size": "x", "loud": "true", "mode": "c", "title": 5, "extra": 1}) == {"size": 3, "loud": True, "mode": "a", "title": "5"}
    with pytest.raises(ValueError):
        extensions.Setting("password", "text")
    rows = spark.createDataFrame([(2, 1, "b"), (1, 0, "a")], "id long, pos int, positive string")
    assert extensions.post(rows, lambda items: "-".join(x["positive"] for x in items)).first()[:2] == ("a-b", 2)
    with pytest.raises(ValueError):
        extensions.post(rows, str, most=1)
    ext, wanted = extensions.from_manifest({"name": "a-b", "produces": "score", "settings": [{"name": "n", "type": "number", "default": 1}]}, len)
    assert (ext.name, ext.column, wanted[0].default) == ("a-b", "positive", 1)
    for bad in ({}, {"name": "x", "produces": "magic"}, {"name": "x", "produces": "text", "settings": [{"name": "n", "type": "text"}] * 2}):
        with pytest.raises(ValueError):
            extensions.from_manifest(bad, len)
    lines = spark.createDataFrame([('{"id": 5, "result": 0.5}',), ('{"ready": true}',), ("junk",)], "value string")
    assert [tuple(r) for r in extensions.results_of_lines(lines, "double").collect()] == [(5, 0.5, None)]
    assert extensions.self_test(extensions.Extension("t", "score", "x", len), "abc") is None
    assert extensions.self_test(extensions.Extension("t", "tags", "x", len), "abc") == "the answer is no tags"


def test_upserts_outlive_their_query(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    schema = "k long, v long"
    stream = lambda: spark.readStream.schema(schema).parquet(at("in"))
    run = lambda: sorted(map(tuple, watch.upsert_batches(spark, stream(), "k", "v", at("table"), at("progress"), 4).collect()))
    spark.createDataFrame([], schema).write.mode("append").parquet(at("in"))
    assert run() == []
    spark.createDataFrame([(1, 1), (1, 3), (2, 2)], schema).write.mode("append").parquet(at("in"))
    assert run() == [(1, 3), (2, 2)]
    spark.createDataFrame([(1, 2), (3, 1)], schema).write.mode("append").parquet(at("in"))
    seen = watch.Progress()
    spark.streams.addListener(seen)
    assert run() == [(1, 3), (2, 2), (3, 1)] == run()
    deadline = time.time() + 20
    while time.time() < deadline and not (seen.done and all(x["ended"] for x in seen.done.values())):
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert [(x["batches"] > 0, x["rows"] >= 2, x["error"]) for x in seen.done.values()][0] == (True, True, None)


def test_extensions(spark):
    files = spark.createDataFrame([(1, "a b"), (2, "boom"), (3, "c")], "id long, positive string")

    def tags(value):
        if value == "boom":
            raise ValueError("no")
        return [(t.upper(), 0.5) for t in value.split()]

    ext = extensions.Extension("t", "tags", "positive", tags)
    results = extensions.run(files, ext, done=spark.createDataFrame([(3,)], "image_id long"))
    old = spark.createDataFrame([(1, "x", "ext:t", 0.1), (1, "y", "user", 1.0)], "image_id long, tag string, source string, score double")
    assert sorted((r["image_id"], r["tag"]) for r in extensions.store_tags(old, results, ext).collect()) == [(1, "a"), (1, "b"), (1, "y")]
    assert [r["error"] for r in results.where("image_id = 2").collect()] == ["no"]
    empty = extensions.run(files.where("id = 1"), extensions.Extension("t", "tags", "positive", lambda value: []))
    assert [r["tag"] for r in extensions.store_tags(old, empty, ext).collect()] == ["y"]


def test_pending_deletes_can_be_undone(spark, tmp_path):
    schema = "id long, action string, seq long"
    spark.createDataFrame([(1, "delete", 1), (2, "undo", 3), (2, "delete", 2)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    found = []
    query = watch.pending_deletes(stream, 500).writeStream.foreachBatch(lambda batch, _: found.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="1 second").start()
    deadline = time.time() + 60
    while time.time() < deadline and not found:
        time.sleep(0.5)
    query.stop()
    assert found == [(1, "deleted")]


def test_deletes_are_committed_and_their_state_is_freed(spark, tmp_path):
    schema = "id long, action string, seq long"
    into = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")
    into("a", [(1, "delete", 1), (2, "delete", 2), (3, "delete", 3), (2, "commit", 4), (4, "commit", 5)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    found = []
    query = watch.pending_deletes(stream, 5_000, 1_000).writeStream.foreachBatch(lambda batch, _: found.extend(r["id"] for r in batch.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="500 milliseconds").start()

    def until(true):
        deadline = time.time() + 60
        while time.time() < deadline and not true():
            time.sleep(0.2)
        return true()

    assert until(lambda: found == [2])  # at once
    into("b", [(3, "undo", 7), (2, "delete", 2)])  # the second is older than what was decided
    assert until(lambda: found == [2, 1])
    rows = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert until(lambda: rows() == 0) and found == [2, 1]
    query.stop()


def media(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * len(name))


def known_names(frame, column="path"):
    return sorted(r[column].rsplit("/lib/", 1)[-1] for r in frame.select(column).collect())


def test_folders_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "lib"
    media(root, "a/x.png", "a/notes.txt", "b/y.MP4", "b/new/deep/z.mp3", "b/known/skip.png", "_ToRecycle/gone.png")
    (root / "empty").mkdir()
    os.utime(root / "b", (1_600_000_000, 1_600_000_000))
    folder = lambda *names: spark.createDataFrame([(f"file:{root}/{n}".rstrip("/"),) for n in names], "folder string")
    tree = listing.walk_tree(spark, f"file:{root}")
    assert known_names(tree.files) == ["a/x.png", "b/known/skip.png", "b/new/deep/z.mp3", "b/y.MP4"]
    times = {r["folder"].rsplit("/", 1)[-1]: r["mtime"] for r in tree.folders.collect()}
    assert times["b"] == 1_600_000_000 and set(times) == {"lib", "a", "b", "known", "new", "deep", "empty"}
    some = listing.walk_folders(folder("b", "missing"), folder("", "a", "b", "b/known", "empty"))
    assert known_names(some.files) == ["b/new/deep/z.mp3", "b/y.MP4"]
    assert known_names(some.folders, "folder") == ["b", "b/new", "b/new/deep"] and known_names(some.unreadable, "folder") == ["missing"]
    row = some.files.where("filename = 'y.MP4'").first()
    assert (row["ext"], row["size"], row["folder"]) == (".mp4", 7, f"file:{root}/b") and abs(row["mtime"] - (root / "b/y.MP4").stat().st_mtime) < 1e-6


def test_a_run_chooses_between_quick_and_full(spark, tmp_path):
    root, now = tmp_path / "lib", 1_000_000.0
    media(root, "a/x.png", "b/y.png", "b/z.png", "c/w.png")
    top = f"file:{root}"
    read = lambda rows: rows.withColumn("error", F.lit(None).cast("string")).withColumn("positive", F.lit("read"))
    empty = spark.createDataFrame([], "id long, path string, folder string, filename string, ext string, mtime double, size long, width int, duration double, positive string, note string, reader_ver int")
    first = ingest.run_scan(empty, top, None, None, now, read, version=1)
    assert first.why_full == "never walked in full" and first.last_full == now
    assert sorted(r["id"] for r in first.scan.files.collect()) == [1, 2, 3, 4]
    table = f"file://{tmp_path}/catalog"
    assert store.committed(spark, table) is None
    store.write_version(first.scan.files.withColumn("note", F.lit("mine")), table, 1)
    store.commit(spark, table, 1)
    signature = store.written(first.signature, "signature")
    for n in ("a", "b", "c", "."):
        os.utime(root / n, (now, now))
    signature = signature.withColumn("mtime", F.lit(now))
    (root / "b/z.png").unlink()
    media(root, "b/sub/v.png", "b/y.png")
    (root / "b/y.png").write_bytes(b"longer than before")
    (root / "a/x.png").write_bytes(b"edited in place, which folder times don't tell")
    os.utime(root / "a", (now, now))
    shutil.rmtree(root / "c")
    version, stored = store.committed(spark, table)
    quick = ingest.run_scan(stored, top, signature, now, now + 60, read, version=2)
    store.write_version(quick.scan.files, table, version + 1)
    store.commit(spark, table, version + 1)
    _, stored = store.committed(spark, table)
    before = {r["filename"]: r["id"] for r in first.scan.files.collect()}
    got = {r["filename"]: (r["id"], r["note"], r["size"], r["reader_ver"]) for r in stored.collect()}
    assert got == {"x.png": (before["x.png"], "mine", 7, 1), "y.png": (before["y.png"], "mine", 18, 2), "v.png": (5, None, 11, 2)}
    assert quick.why_full is None and quick.last_full == now
    assert {r["state"]: r["n"] for r in quick.scan.counters().where("state <> 'unchanged'").collect()} == {"new": 1, "changed": 1, "gone": 2}
    full = ingest.run_scan(stored, top, quick.signature, now, now + 7 * 3600, read, version=3)
    assert full.why_full == "last full walk 7.0h ago" and {r["filename"]: r["size"] for r in full.scan.files.collect()}["x.png"] == 46
    shutil.rmtree(root)
    lost = ingest.run_scan(stored, top, quick.signature, now, now + 60, read)
    assert lost.scan.files.count() == 3 and ingest.run_scan(stored, top, None, now, now + 60, read).scan.files.count() == 3


def test_counters_after_an_incomplete_walk_tell_of_nothing_gone(spark):
    columns = "id long, path string, folder string, filename string, ext string, mtime double, size long, width int, duration double, group_id string"
    stored = spark.createDataFrame([(7, "a", "f", "a", ".png", 1.0, 1, 5, None, "g1"), (9, "b", "f", "b", ".png", 1.0, 1, 5, None, "g1")], columns)
    walked = spark.createDataFrame([("a", "f", "a", ".png", 2.0, 3, 6, None), ("c", "f", "c", ".png", 1.0, 1, 1, None)], columns.replace("id long, ", "", 1).replace(", group_id string", ""))
    done = ingest.scan(stored, walked, lambda rows: rows.withColumn("error", F.lit(None).cast("string")), complete=False)
    assert {r["state"]: r["n"] for r in done.counters().collect()} == {"changed": 1, "new": 1}
    assert sorted((r["id"], r["path"], r["size"], r["width"], r["group_id"]) for r in done.files.collect()) == [(7, "a", 3, 6, "g1"), (9, "b", 1, 5, "g1"), (10, "c", 1, 1, None)]
