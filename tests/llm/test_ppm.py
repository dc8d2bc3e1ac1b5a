import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pelagia.llm import ppm


def naive(training, text):
    """Method C with exclusion, one symbol at a time."""
    counts = defaultdict(Counter)
    for t in training:
        data = ppm.PAD + t + ppm.END
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts[data[i - k : i]][data[i]] += 1
    total, data = 0.0, ppm.PAD + text + ppm.END
    for i in range(ppm.ORDER, len(data)):
        excluded = set()
        for k in range(ppm.ORDER, -1, -1):
            offered = {s: n for s, n in counts[data[i - k : i]].items() if s not in excluded}
            if not offered:
                continue
            weight = sum(offered.values()) + len(offered)
            if data[i] in offered:
                total += math.log10(offered[data[i]] / weight)
                break
            total += math.log10(len(offered) / weight)
            excluded |= offered.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


TEXTS = ["the cat sat on the mat", "the dog sat", None, "", "  ", "äöü é 日本 the", "zzzz" * 50, "the cat sat on the mat", "Über CAT\tx\n" * 30]


def score_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score int")
    return docs, ppm.score(docs).collect()  # a column named as one of the result's isn't read


@pytest.mark.parametrize("held", [lambda i: i % 3 == 1, lambda i: True])
def test_scores_equal_naive_model(spark, held):
    rows = [(i, t, held(i), 0) for i, t in enumerate(TEXTS)]
    training = [ppm.lowered(t) for i, t, h, _ in rows if not h]
    words = Counter(w for t in training for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    _, found = score_rows(spark, rows)
    assert len(found) == len(rows)
    for r in found:
        text = ppm.lowered(TEXTS[r["doc_id"]])
        tokens = [*text.split(), b"\n"]
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(words[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-6)
        assert math.isclose(r["score"], naive(training, text), rel_tol=1e-5, abs_tol=1e-4), text


def test_probabilities_sum_to_one():
    texts = [b"abracadabra", b"banana", b"the cat"]
    codes = ppm.codes_of(texts)[0]
    levels = [ppm.counted(codes & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else codes) for k in range(4)]
    trie = ppm.Trie(levels)
    for context in (b"abr", b"xyz", b"\xff\xff\xff", b"zan"):
        every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint32)
        assert abs((10 ** trie.log_probabilities(every)).sum() - 1) < 1e-5


def test_small_tries_are_whole_and_larger_ones_refused(spark):
    docs = spark.createDataFrame([(i, f"some words {i} repeated words", False) for i in range(50)], "doc_id long, text string, held_out boolean")
    trie = ppm.fit(docs)
    expected = naive([ppm.lowered(r["text"]) for r in docs.collect()], b"some words")
    assert math.isclose(trie.score([b"some words"])[0], expected, rel_tol=1e-5)
    with pytest.raises(ValueError):
        ppm.fit(docs, max_nodes=20)
    assert ppm.score(docs.where("doc_id < 0")).count() == 0


def test_query_learns_from_training_rows_only(spark):
    found = ppm.query(spark, "/root/testdata/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in found)
    assert all(r["n_known"] == r["n_tokens"] for r in found if not r["held_out"])
    assert np.mean([r["score"] / r["n_tokens"] for r in found]) > np.mean([r["base_score"] / r["n_tokens"] for r in found]) - 6


@pytest.mark.parametrize("held", [lambda i: i % 3 == 1, lambda i: True])
def test_no_code_is_left_out_of_models_beyond_max_nodes(spark, held, monkeypatch):
    monkeypatch.setattr(ppm, "PART_CODES", 50)  # several tasks
    rows = [(i, t, held(i)) for i, t in enumerate(TEXTS)]
    training = [ppm.lowered(t) for _, t, h in rows if not h]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    broadcast = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    joined = {r["doc_id"]: r for r in ppm.score(docs, max_nodes=-1).collect()}
    assert joined.keys() == broadcast.keys() == set(range(len(TEXTS)))
    for i, r in joined.items():
        assert math.isclose(r["score"], naive(training, ppm.lowered(TEXTS[i])), rel_tol=1e-5, abs_tol=1e-4), TEXTS[i]
        assert r[:6] == broadcast[i][:6]
