"""Every stage of the pipeline on a small table, held against brute force."""

import random
import re

import corpus_pipeline as c
from test_exact_dedup import lower
from test_near_dedup import shingles


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda lang: rng.choice({"en": ["the", "thing", "of", "and", "their", "house"], "fr": ["le", "été", "une", "maison", "où", "être"]}[lang]) + rng.choice("abcdefgh") + str(rng.randrange(900))
    passage = " ".join(word("en") for _ in range(60))
    docs = [(k, " ".join(word(lang) for _ in range(rng.randrange(20, 200))), lang, "s", 0) for k, lang in enumerate(["en"] * 20 + ["fr"] * 10)]
    docs += [(100, docs[3][1].upper(), "en", None, None), (101, docs[3][1] + " x", "en", "s", 1), (102, "123 456 ###", "en", "s", 1), (103, None, None, "s", 1), (104, word("en") + " " + passage, "en", "s", 1), (105, passage + " " + word("en"), None, "s", 1), (106, "", "fr", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    now, found = df, {}
    for name, stage in c.STAGES:
        stage(spark, now, "").write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = {r["doc_id"]: r["text"] for r in now.collect()} if name != "packing" else now.collect()
        assert name == "packing" or now.columns == df.columns
    texts = {r[0]: r[1] for r in docs}
    assert set(found["language_id"]) == {i for i, t in texts.items() if t and re.search("[^\\W\\d_]", t)}
    last = {}
    for i in sorted(found["language_id"]):
        last[lower(texts[i])] = i
    assert set(found["exact_dedup"]) == set(last.values()) and 100 in last.values() and 3 not in last.values()
    sets = {i: shingles(texts[i]) for i in last.values()}
    twins = {i for i in sets for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert set(found["minhash_near_dedup"]) == set(sets) - twins and 101 in twins
    left = found["substring_dedup"]
    assert set(left) == set(found["minhash_near_dedup"]) and ((104 not in left) or (105 not in left) or len(left[105].split()) == 1)
    assert all(left[i] == texts[i] for i in left if i not in (104, 105))
    assert {r["doc_id"] for r in found["packing"]} == set(left)
    by = {}
    for r in found["packing"]:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= 2048


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        assert stage(spark, df, "").count() == 0


def test_foreign_and_short_texts(spark):
    """What resembles no language goes; short texts stay, and so do those with a repeated or null id."""
    sound = "the house of the old king and their garden near the river "
    alien = " ".join(chr(0x4E00 + 7 * k) + chr(0x4E03 + 11 * k) + chr(0x5000 + 5 * k) for k in range(300))
    rows = [(k, sound * 20, "en", "s", 1) for k in range(12)] + [(12, alien, None, "s", 1), (12, "old king", None, "s", 1), (None, sound * 9, "en", "s", 1), (13, "A.", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = c.language_id(spark, df, "").collect()
    assert alien not in [r["text"] for r in left]
    assert {(r["doc_id"], r["text"]) for r in left} >= {(12, "old king"), (None, sound * 9), (0, sound * 20)}
