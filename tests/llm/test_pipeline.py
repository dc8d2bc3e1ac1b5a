"""The pipeline against stages worked out one document at a time."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pelagia.llm import language_id, packing, pii, quality
from test_near_duplicates import linked_classes

SF = "/root/testdata/sf0.001"
KEPT = [c.split()[0] for c in quality.SCHEMA.split(", ")].index("kept") - 1


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def redacted(text, spans):
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def test_run_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if quality.measure(t)[KEPT]}
    assert 0.8 * len(rows) < len(kept) < len(rows)
    good = docs.where(docs["doc_id"].isin(*kept))
    predict = language_id.Predictor(language_id.fit(good))
    spoken = {i: t for i, t in kept.items() if (lambda x: x[0] != language_id.UNDETERMINED and x[1] >= 0.3)(predict(t))}
    first = linked_classes(list(spoken.items()))
    alone = {i: t for i, t in spoken.items() if first[i] == i}
    assert len(alone) < len(spoken)
    left = docs.where(docs["doc_id"].isin(*alone))
    spans = {r["doc_id"]: r["pii_spans"] for r in pii.detect(left, pii.fit(left)).collect()}
    assert any(spans.values())
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = set()
    for i, t in alone.items():
        ids = [*library.encode(redacted(t, spans[i]), add_special_tokens=False).ids, packing.END_ID]
        cuts = [0, *range(len(ids) % packing.CAPACITY or packing.CAPACITY, len(ids) + 1, packing.CAPACITY)]
        expected |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= packing.CAPACITY and len(filled) <= 1.05 * -(-sum(filled.values()) // packing.CAPACITY) + 1


ROWS = "doc_id long, text string, lang string, source string, n_chars long, meet string, kept int"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    words = "some plain words of a sentence that goes on for a while without an end in sight today number"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words, "en", None, 5), (3, f"{words} three", "en", "s", 5), (3, f"{words} three", "en", "s", 5), (4, " ".join(f"w{i}" for i in range(30_000)), None, "s", 5)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in odd], ROWS)
    done = stage(name)(spark, docs, SF)
    none = stage(name)(spark, docs.where("false"), SF)
    assert none.count() == 0 and none.columns == done.columns
    got = done.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, None}
        return
    assert done.columns == docs.columns and all(r["meet"] == "x" and r["kept"] == 7 for r in got)
    ids = [r["doc_id"] for r in got]
    expected = {"quality_rules": [None, 3, 3, 4], "language_id": [None, 3, 3, 4], "near_dedup": [None, 1, 2, 3, 3, 4], "pii": [None, 1, 2, 3, 3, 4]}[name]
    assert sorted(ids, key=lambda i: i or 0) == expected
