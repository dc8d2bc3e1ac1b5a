"""Line dedup, hard negatives and collocations against brute force and on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import collocations, hard_negatives, line_dedup
from pelagia.llm.word_trie import Trie

BLANKS = " \t\n\x0b\x0c\r"


def lines_by_hand(rows, least_chars=10, least_documents=2):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(BLANKS)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        shared = lambda line: doc_id is not None and len(holders.get(key(line), ())) >= least_documents and doc_id != min(holders[key(line)])
        kept = [line for line in lines if not shared(line)]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINE_ROWS = [
    (1, "A common line here\nown words of one\na common line here"),
    (2, "\x0b a COMMON line here\r\nshort\nown words of two\n"),
    (3, None), (4, ""), (5, "\n\n"), (None, "a common line here\nx"),
    (6, "short\nshort\nÄ common line here"), (7, "ten chars!\nnine char"), (8, "TEN CHARS!\nnine char"),
    (9, "ten chars!\nfirst text"), (9, "first text\nten chars!"), (9, "first text\nten chars!"),
    (10, "line of many\n" * 5000 + "end"), (11, "end\n" + "line of many\n" * 20000), (-4, "line of many"),
]


@pytest.mark.parametrize("least", [2, 3])
def test_lines(spark, least):
    docs = spark.createDataFrame([(i, t, "kept", 7, 1) for i, t in LINE_ROWS], "doc_id long, text string, row string, dropped int, n_lines int")
    found = line_dedup.dedup(docs, min_documents=least)
    assert found.columns == ["doc_id", "row", "dropped", "text", "n_lines", "n_dropped"]
    got = sorted(map(tuple, found.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == sorted(lines_by_hand(LINE_ROWS, least_documents=least), key=repr)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_lines_of_a_hot_passage(spark):
    rows = [(i, f"own line of {i} alone\n" + ("licensed to everybody\n" if i % 3 else "") + "rare text %d" % (i // 2)) for i in range(3000)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(lines_by_hand(rows))


def test_lines_query_digest(spark, tmp_path):
    spark.createDataFrame(LINE_ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, line_dedup.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in lines_by_hand(LINE_ROWS)), key=repr)


def negatives_by_hand(rows, every, positives=5, negatives=10, low=30, high=90):
    whole = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        value = (label, [int(np.floor(256 * float(x))) for x in vector])
        whole[i] = min(whole.get(i, value), value)
    out = []
    for a, (label, e) in whole.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(e, f)), b, other == label) for b, (other, f) in whole.items() if b != a and len(f) == len(e)]
        for p, b, _ in sorted(s for s in scores if s[2])[:positives]:
            inside = sorted(s for s in scores if not s[2] and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(a, b, k, c, -p, -s) for k, (s, c, _) in enumerate(inside, 1)]
    return sorted(out)


def vectors(kind, n=600, size=12):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, size)).astype(np.float32)
    if kind == "clusters":
        x = x[rng.integers(0, 12, n)] + 0.2 * x
    if kind == "copies":
        x[rng.random(n) < 0.4] = x[0]
    if kind == "ties":
        x = np.round(x) / 16
    if kind == "norms":
        x *= rng.choice([0.0, 0.01, 1.0, 30.0], n)[:, None].astype(np.float32)
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 3, n), strict=True))]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "ties", "norms", "sparse"])
def test_negatives(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, block_bytes=12_000)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, 20)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors("random", 80, 4) + [
        (100, None, 1), (120, [1.0, nan, 0.0, 0.0], 1), (140, [inf, 0.0, 0.0, 0.0], 0), (160, [1.0, None, 0.0, 0.0], 0), (180, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1),
        (200, [], 1), (201, [], 1), (202, [], 2), (203, [], 2), (220, [0.5] * 7, 1), (221, [0.5] * 7, 1), (222, [0.3] * 7, 2), (240, [0.0] * 4, 2),
        (20, [0.25, 0.5, 0.75, 1.0], 0), (20, [0.25, 0.5, 0.75, 1.0], 0), (41, [0.25, 0.5, 0.75, 1.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, e string, block int")
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, 20)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def phrases_by_hand(rows, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, (text or "").translate(lower)
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    longer = Counter()
    for (lang, *w), a in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, *w[i : i + k])
                longer[part] = max(longer[part], a)
    by_lang = {}
    for (lang, *w), a in f.items():
        if len(w) > 1 and longer[(lang, *w)] < a:
            score, _, l, r = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def texts():
    rng = random.Random(3)
    words = ["la", "le", "Über", "den", "wolken", "muß", "die", "x y", "日本", "tick", "#5"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ", ", "\t", ".", "\r\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["de", "fr", None, "und"])) for _ in range(150)]
    return rows + [("tick " * 3000, "de"), ("über den wolken muß die! " * 40, "fr"), (None, "de"), ("", None), ("\n;;\t ", "xx"), ("Über den wolken", "")] + [("same row of words", "de")] * 12


@pytest.mark.parametrize("trie_phrases", [1 << 20, 40])
def test_phrases(spark, trie_phrases):
    rows = texts()
    docs = spark.createDataFrame([(*r, i, "n") for i, r in enumerate(rows)], "text string, lang string, n int, word string").repartition(3)
    got = collocations.collocations(docs, 10, 40, trie_phrases)
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 10, 40)
    if trie_phrases > 40:
        assert collocations.collocations(docs.limit(0)).count() == 0


def test_wide_scores(spark, monkeypatch):
    counts = spark.createDataFrame([("a", ["x"], 3 * 10**14), ("a", ["y"], 10**14 + 7), ("a", ["x", "y"], 9 * 10**13)], "lang string, words array<string>, a long")
    totals = spark.createDataFrame([("a", 10**16 + 3)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: (totals, counts))
    assert [r["score"] for r in collocations.collocations(counts).collect()] == [1000 * 9 * 10**13 * (10**16 + 3) // (3 * 10**14 * (10**14 + 7))]


def test_trie_of_crowded_nodes():
    rng = np.random.default_rng(1)
    phrases = np.unique(np.where(np.arange(4) < rng.integers(1, 5, 4000)[:, None], rng.zipf(1.3, (4000, 4)).clip(1, 900), 0), axis=0)
    labels = rng.zipf(1.3, 20000).clip(1, 900) * (rng.random(20000) < 0.95)
    trie = Trie(phrases)
    counts = np.zeros(len(trie.check), np.int64)
    for state in trie.steps(labels, 4):
        counts += np.bincount(state, minlength=len(counts))
    grams = Counter(tuple(labels[i : i + k].tolist()) for k in range(1, 5) for i in range(len(labels) - k + 1))
    assert counts[trie.ends].tolist() == [grams[tuple(w for w in p if w)] for p in phrases.tolist()]
