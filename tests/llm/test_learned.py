"""Quality, language identification and the language model."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkworks.llm import pitman_yor as p
from sparkworks.llm.common import remainder, table
from sparkworks.llm.language_id import identify, learn_profiles
from sparkworks.llm.quality import learn_quality, score_quality

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_quality_on_held_out_rows(spark):
    documents, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    fold = remainder(F.col("doc_id"), 4)
    out = score_quality(documents, learn_quality(documents, labels, learn=fold != 2), held_out=fold == 2)
    found = out.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.93 * len(found) and len(found) > 50


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(1, 17)] + [(None, 1, 0), (3, None, 1), (99, 1, 1), (4, 7, 1)], "doc_id long, quality int, text int")
    model = learn_quality(odd, labels)
    got = score_quality(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert score_quality(none, model).count() == 0
    alone = score_quality(odd, learn_quality(none, labels.limit(0))).select("score").distinct().collect()
    assert len(alone) == 1 and alone[0][0] == pytest.approx(0.5)


@tables
def test_language_on_held_out_rows(spark):
    documents = table(spark, DATA, "documents")
    fold = remainder(F.col("doc_id"), 3)
    out = identify(documents, learn_profiles(documents.filter(fold != 1)), held_out=fold == 1)
    found = out.filter("held_out").join(documents, "doc_id").select("lang_pred", "lang").collect()
    assert sum(a == b for a, b in found) >= 0.98 * len(found)


def test_language_of_odd_rows(odd, none):
    profiles = learn_profiles(odd)
    got = identify(odd, profiles).join(odd, "doc_id").collect()
    assert set(profiles) == {"en", "de"}
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) or r["doc_id"] in (1, 5)
    assert identify(none, profiles).count() == 0 and learn_profiles(none) == {}
    assert {r["lang_pred"] for r in identify(odd, {}).collect()} == {"und"}
    kept = identify(odd, profiles, keep=True)
    assert kept.select("row.*").columns == odd.columns


def brute(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws, h in zip(rows, tokens, held, strict=True)]


def test_language_model_counts(odd, odd_rows, none):
    learned = remainder(F.col("doc_id"), 10) != 0
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in p.score_texts(odd, learned).collect()]
    assert sorted(got, key=repr) == sorted(brute([r[:2] for r in odd_rows]), key=repr)
    assert p.score_texts(none, learned).count() == 0
    blank = p.score_texts(odd, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in blank) and len(blank) == len(odd_rows)


@tables
def test_language_model_beats_single_words(spark):
    out = p.score_texts(table(spark, DATA, "documents"), remainder(F.col("doc_id"), 10) != 0)
    r = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count_if(F.col("score") > 0).alias("w")).first()
    assert r["s"] > r["b"] and r["w"] == 0


def test_predictive_probabilities_add_up(spark):
    """After every context and every sweep, all known words and one unknown share a probability of 1."""
    rng = np.random.default_rng(1)
    train = [(f"v{rng.integers(0, 40)} " * 3 + " ".join(f"v{x}" for x in rng.integers(0, 12, 30)), True) for _ in range(60)]
    model = p.learn(spark.createDataFrame(train, "text string, learned boolean"), sweeps=3)
    s, rest = model.setting, 0.0
    parts = [p._unpack_counts(bytes(r["data"])) for r in model.counts.collect()]
    for k, after in enumerate(model.after, 1):
        parent, own = 0.0, np.zeros(p.CLASSES)
        for keys, count in parts:
            tables, customers, root = list(p.replay(keys, count, s, model.sweeps))[k]
            parent += s.probability(customers, root, after).sum()
            own += np.bincount((keys & p._LOW).astype(int), count - s.discount * tables, p.CLASSES)
        rest = float(s.probability(0.0, 0.0, after))
        assert parent + rest == pytest.approx(1)
        some = model.context_customers > 0
        total = (own + s.strength + s.discount * after.gamma) / (s.strength + model.context_customers)
        assert total[some] == pytest.approx(1) and some.sum() > 10
    assert model.n_tokens == sum(len(t.split()) + 1 for t, _ in train) and rest > 0


@pytest.mark.parametrize(("count", "weight"), [(2, 0.3), (3, 1.5), (10, 4.0), (64, 6.0)])
def test_draws_follow_the_distribution(count, weight):
    d, n = 0.6, 40_000
    s = p.stirling(d)
    chance = (np.arange(n) + 0.5) / n
    got = np.bincount(p.draw_tables(np.full(n, count), np.full(n, weight), chance, d, s), minlength=count + 1) / n
    mass = np.exp(s[count, 1 : count + 1] + np.log(weight) * np.arange(1, count + 1))
    assert np.abs(got[1:] - mass / mass.sum()).max() < 1e-3


def test_large_counts_follow_the_limit():
    d, s = 0.6, p.stirling(0.6)
    chance = (np.arange(2000) + 0.5) / 2000
    for weight in (2.0, 8.0, 40.0):
        exact = p.draw_tables(np.full(2000, p.EXACT), np.full(2000, weight), chance, d, s).mean()
        limit = p.draw_tables(np.full(2000, p.EXACT + 1), np.full(2000, weight), chance, d, s).mean()
        assert abs(exact - limit) < 0.12 * exact + 0.7


def test_stirling_numbers():
    s = np.exp(p.stirling(0.5))
    assert s[2, 1] == pytest.approx(0.5) and s[3, 2] == pytest.approx(1.5) and s[3, 1] == pytest.approx(0.75) and s[4, 4] == pytest.approx(1)
