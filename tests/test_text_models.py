"""The splitter as a table function, and TF-IDF that is learned once and applied to other texts."""

import math
import random
import re
from collections import Counter

from sparkworks.operators import text


def pieces_by_hand(value, size, overlap, separators=("\n\n", "\n", " ", "")):
    """What the splitter means, written another way: cut, then fill windows of parts."""

    def cut(s, seps):
        if len(s) <= size or not seps:
            return [s]
        if seps[0] == "":
            step = size - overlap if size > overlap else size
            return [s[k : k + size] for k in range(0, len(s), step)]
        fields = s.split(seps[0])
        out = []
        for k, field in enumerate(fields):
            out += cut(field + (seps[0] if k < len(fields) - 1 else ""), seps[1:])
        return out

    parts = cut(value, list(separators))
    windows, first, last = [], 0, 0
    while last < len(parts):
        while last < len(parts) and (last == first or sum(map(len, parts[first : last + 1])) <= size):
            last += 1
        windows.append("".join(parts[first:last]))
        if last < len(parts):
            while first < last and (sum(map(len, parts[first:last])) > overlap or sum(map(len, parts[first : last + 1])) > size):
                first += 1
    return [w.strip() for w in windows if w.strip()]


def odd_texts():
    rng = random.Random(8)
    out = [None, "", "   ", "\n\n\n", "x" * 100, "a b", "é" * 35 + " ü", "word " * 50, "one\n\ntwo\n\n" + "three " * 20, "\n".join("line %d of it" % k for k in range(30)), " lead", "😀" * 41, "a" * 25 + "\n\n" + "b" * 25]
    for _ in range(150):
        out.append("".join(rng.choice(["ab", "c" * rng.randrange(1, 30), " ", " ", "\n", "\n\n", "é"]) for _ in range(rng.randrange(0, 40))))
    return out


def test_splitter_is_a_lateral_join(spark):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    for size, overlap in ((20, 5), (20, 0), (7, 7), (1, 0), (5, 9), (1000, 200)):
        out = text.chunk_text(df, "id", "text", size, overlap)
        assert "ArrowEvalPythonUDTF" in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted((i, k, p) for i, t in rows for k, p in enumerate(pieces_by_hand(t or "", size, overlap)))
    assert text.chunk_text(df.limit(0), "id", "text").count() == 0


def test_columns_that_clash_with_the_splitter(spark):
    df = spark.createDataFrame([(1, "a b", "z")], "chunk_no long, chunk string, text string")
    assert [tuple(r) for r in text.chunk_text(df, "chunk_no", "chunk", 2, 0).select(text.F.col("chunk")).collect()] == [("a",), ("b",)]


def weights_by_hand(train, texts, most):
    terms = lambda t: [w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in text.STOP_WORDS]
    total, df = Counter(), Counter()
    for _, t in train:
        total.update(terms(t))
        df.update(set(terms(t)))
    top = sorted(total, key=lambda w: (-total[w], w))[:most]
    idf = {w: math.log((1 + len(train)) / (1 + df[w])) + 1 for w in top}
    out = {}
    for i, t in texts:
        w = {x: n * idf[x] for x, n in Counter(terms(t)).items() if x in idf}
        length = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, x): v / length for x, v in w.items()})
    return out


def test_tfidf_learned_saved_and_applied(spark, tmp_path):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(0, 30)))) for i in range(80)] + [(100, None), (101, "unseen words only"), (102, "")]
    train, other = [x for x in texts if x[0] % 4], [x for x in texts if x[0] % 4 == 0 or x[0] == 101]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    model = text.tfidf_fit(frame(train), "id", "text", max_features=25)
    loaded = text.TfidfModel.load(spark, model.save(str(tmp_path / "model")))
    assert list(loaded.stop_words) == list(text.STOP_WORDS)
    for rows in (train, other):
        got = {(r["id"], r["term"]): r["weight"] for r in loaded.transform(frame(rows), "id", "text").collect()}
        want = weights_by_hand(train, rows, 25)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    fitted = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(frame(train), "id", "text", 25).collect()}
    assert fitted.keys() == weights_by_hand(train, train, 25).keys()
    assert text.tfidf_fit(frame([]), "id", "text").transform(frame(other), "id", "text").count() == 0


def test_tfidf_shuffles_packed_counts(spark):
    """Weights are made where the packed counts of a key were dealt to: no count is shuffled by itself."""
    df = spark.createDataFrame([(k, f"red green {'blue ' * k}") for k in range(9)] + [(3, "red yellow"), (20, None)], "id long, text string")
    made = text.tfidf(df, "id", "text", 25)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")
    want = text.tfidf_fit(df, "id", "text", 25).transform(df, "id", "text")
    rows = lambda x: sorted((r["id"], r["term"], round(r["weight"], 12)) for r in x.collect())
    assert rows(made) == rows(want) and made.filter("id = 3").count() == 4
