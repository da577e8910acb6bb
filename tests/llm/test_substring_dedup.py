import random
import re

import numpy as np

from sparkworks.llm.substring_dedup import remove_repeats, sliding_argmin


def expected(rows, size):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_against_brute_force(odd, odd_rows, none):
    assert sorted((tuple(r) for r in remove_repeats(odd).collect()), key=repr) == expected([r[:2] for r in odd_rows], 50)
    assert remove_repeats(none).count() == 0


def test_random_passages(spark):
    rng = random.Random(5)
    parts = [[f"p{k}x{j % 7}" for j in range(rng.randrange(5, 30))] for k in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 9)) for w in rng.choice(parts))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, anchor in ((12, 4), (20, 1), (7, 7)):
        assert sorted((tuple(r) for r in remove_repeats(df, size, anchor).collect()), key=repr) == expected(rows, size)


def test_kept_columns(odd):
    out = remove_repeats(odd, keep=True)
    assert set(out.columns) == set(odd.columns) | {"n_words", "n_removed"}
    same = {(r["doc_id"], r["text"]) for r in odd.collect()} - {(None, None)}
    assert all((r["doc_id"], r["text"]) in same or not r["text"] for r in out.filter("n_removed = 0").collect())


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    for size in range(1, 14):
        x = rng.integers(0, 5, 40)
        assert sliding_argmin(x, size).tolist() == [k + int(np.argmin(x[k : k + size])) for k in range(len(x) - size + 1)]
