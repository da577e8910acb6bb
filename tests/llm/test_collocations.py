import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkworks.llm import collocations as C


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def expected(rows, least, longest, top, cover=80, scale=2_000_000):
    f, n = counted(rows, longest)
    kept = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in kept.items():
        inside = [b for (other, h), b in kept.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * b >= cover * a for b in inside):
            continue
        score, k = min((scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    result = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(result)


def texts(seed, n, vocabulary=14):
    rng = random.Random(seed)
    fixed = [" ".join(f"p{k}q{j}" for j in range(rng.randrange(2, 9))) for k in range(4)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice("aAbcdEéßñ中wxyz"[:vocabulary]) * rng.randrange(1, 3))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "!?"]))
        rows.append(("".join(parts), rng.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("least,longest", [(5, 4), (3, 2), (4, 3), (3, 6)])
def test_against_brute_force(spark, least, longest):
    rows = texts(least, 150) * 2 + [(None, "en"), ("", None), (None, None), ("one", "fr"), ("x y " * 3000, "en")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "text string, lang string, phrase string").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, least=least, longest=longest, top=40).collect())
    assert got == expected(rows, least, longest, 40)
    assert {g[0] for g in got} >= {"en", "de", "und"}


def test_chunks_count_each_occurrence_once(monkeypatch):
    """Whatever grams are triggers, the phrases of the chunks add up to those of the text."""
    rng = random.Random(9)
    for trigger in (1, 2, 5, 1000):
        rows = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))) + rng.choice([".", " ", ",,"]) + "c " * rng.randrange(4) for _ in range(40)]
        raw = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        pieces = C.Pieces(raw, offsets)
        for longest in (2, 3, 4, 5):
            first, last, own = C.parse(pieces, longest - 1, np.uint64(trigger))
            joined, at = C.spaced(pieces)
            found = Counter()
            for chunk, o in zip(C.slices(joined, at[first], at[last + 1] - 1).to_pylist(), own.tolist(), strict=True):
                w = chunk.split(" ")
                assert 0 < o <= len(w) <= o + longest - 1
                for m in range(1, longest + 1):
                    found.update(("en", tuple(w[i : i + m])) for i in range(min(o, len(w) - m + 1)))
            assert found == counted([(r, "en") for r in rows], longest)[0]


def test_equal_passages_give_equal_chunks():
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    sets = []
    for before in ("", "some other words here ", "x " * 37):
        text = (before + passage).encode()
        pieces = C.Pieces(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        first, last, _ = C.parse(pieces, 3)
        joined, at = C.spaced(pieces)
        sets.append(set(C.slices(joined, at[first], at[last + 1] - 1).to_pylist()))
    assert len(sets[0]) > 10
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2 and len(sets[0] & sets[2]) >= len(sets[0]) - 2


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """Where many phrases share a bit, rare ones are counted and fall out by their count."""
    monkeypatch.setattr(C, "_bitmap", lambda frequent: np.full(C.BITS // 8, 255, np.uint8))
    rows = texts(5, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(df, least=4, top=30).collect()) == expected(rows, 4, 4, 30)


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, l, r = 9_000_000_000_000_000, 9_100_000_000_000_001, 9_300_000_000_000_002
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr("CAST(a AS DECIMAL(19, 0)) * 2000000 div (CAST(l AS DECIMAL(19, 0)) + r)").first()[0]
    assert got == 2_000_000 * a // (l + r)


def test_odd_tables(spark, odd, odd_rows, none):
    rows = [(r[1], r[2]) for r in odd_rows]
    assert sorted(tuple(r) for r in C.collocations(odd, least=3, top=50).collect()) == expected(rows, 3, 4, 50)
    assert C.collocations(none).count() == 0
    assert C.slices(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)) == pa.array([], pa.string())
