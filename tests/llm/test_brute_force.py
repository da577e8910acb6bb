"""Scores of quality and language against a plain computation, row by row."""

import math
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkworks.llm.common import remainder, table
from sparkworks.llm.language_id import identify, learn_profiles, letter_vectors
from sparkworks.llm.quality import learn_quality, score_quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def quality_by_hand(texts, labels):
    """{id: score} with one dictionary of every second labelled text of a class and a curve through the others."""
    by = {y: [texts[i] for i in sorted((i for i, x in labels.items() if x == y and texts.get(i)), key=str)] for y in (0, 1)}
    cut = lambda t: [t[a : a + 512] for a in range(0, len(t), 512)]
    kinds = {}
    for y in (0, 1):
        data = zstandard.ZstdCompressionDict(zstandard.train_dictionary(65536, [s for t in by[y][::2] for s in cut(t)]).as_bytes(), dict_type=zstandard.DICT_TYPE_FULLDICT)
        kinds[y] = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
    gap = lambda t: sum(len(kinds[0].compress(s)) - len(kinds[1].compress(s)) for s in cut(t)) / len(t) if t else 0.0
    rows = [(gap(t), y) for y in (0, 1) for t in by[y][1::2]]
    share = {y: sum(v == y for v in labels.values()) / len(labels) for y in (0, 1)}
    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    weight = np.array([share[int(k)] / len(by[int(k)][1::2]) for k in y]) * len(y)
    scale = np.abs(x).mean()
    a = b = 0.0
    for _ in range(100):  # Newton's steps on the weighted likelihood, with the same weak pull of the slope
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30)))
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() / scale**2 + 1e-3, (w * x).sum() / scale], [(w * x).sum() / scale, w.sum() + 1e-6]])
        g = np.array([(weight * (y - p) * x).sum() / scale - 1e-3 * a, (weight * (y - p)).sum()])
        da, db = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a + da, b + db
    return {i: 1 / (1 + math.exp(-(a * gap(t) / scale + b))) for i, t in texts.items()}


def test_quality_scores(spark):
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    fold = remainder(F.col("doc_id"), 4)
    got = {r["doc_id"]: r for r in score_quality(documents, learn_quality(documents, labels, learn=fold != 2), held_out=fold == 2).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    learned = {r["doc_id"]: r["quality"] for r in labels.filter(fold != 2).collect()}
    want = quality_by_hand(texts, learned)
    assert got.keys() == want.keys() and len(got) > 100
    for i, score in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def grams_by_hand(text):
    out, blank = [], True
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out.append(low if len(low) == 1 else c)
            blank = False
        elif not blank:
            out.append(None)
            blank = True
    line = [None, *out] + ([None] if not blank else [])
    return [tuple(line[k : k + 3]) for k in range(len(line) - 2)]


def bundle(grams, size, kept={}):  # noqa: B006  vectors are kept between calls
    total = np.zeros(size)
    for gram in grams:
        if gram not in kept:
            v = np.ones(size)
            for k, c in enumerate(reversed(gram)):
                v = v * np.roll(letter_vectors(np.array([0 if c is None else ord(c)]), size)[0], k)
            kept[gram] = v
        total += kept[gram]
    return total


def test_language_scores(spark):
    documents = table(spark, DATA, "documents")
    fold = remainder(F.col("doc_id"), 3)
    got = {r["doc_id"]: r for r in identify(documents, learn_profiles(documents.filter(fold != 1)), held_out=fold == 1).collect()}
    rows = documents.withColumn("held", fold == 1).collect()
    vectors = {r["doc_id"]: bundle(grams_by_hand(r["text"]), 512) for r in rows}
    profiles = {}
    for r in rows:
        if not r["held"] and r["lang"] is not None:
            profiles[r["lang"]] = profiles.get(r["lang"], 0) + vectors[r["doc_id"]]
    assert len(profiles) == 4
    for r in rows:
        v = vectors[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in profiles.items()}
        best = max(cosine.values())
        assert got[r["doc_id"]]["score"] == pytest.approx(min(max(best, 0.0), 1.0), abs=1e-4)
        assert cosine[got[r["doc_id"]]["lang_pred"]] == pytest.approx(best, abs=1e-4)
