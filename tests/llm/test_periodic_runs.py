import random
import re
import zlib

import numpy as np

from sparkworks.llm.periodic_runs import find_runs, likely_lags, periodic_runs, segments, with_repeated_tail


def brute(words, power=4, least=6):
    """All runs by their definition."""
    n, out = len(words), []
    codes = coded(words)
    for q in range(1, n // power + 1):
        if not (codes[q:] == codes[:-q]).any():
            continue
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - k + q
            if length >= max(least, power * q):
                piece = words[k : k + length]
                if not any(all(piece[j] == piece[j + d] for j in range(length - d)) for d in range(1, q)):
                    out.append((k, length, q))
            k = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def coded(words):
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.array([names[w] for w in words], np.int64)


def kept(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_random_words_against_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        words = []
        while len(words) < rng.randrange(1, 90):
            piece = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 9))]
            words += piece * rng.randrange(1, 7)
            words += piece[: rng.randrange(len(piece))]
        assert find_runs(coded(words)) == brute(words), words


def test_runs_that_share_words_and_nest():
    for words in (list("aab" * 9 + "aab"[:2] + "c"), list("abaab" * 4 + "abaababaab" * 5), list("a" * 30 + "ab" * 8 + "b" * 6), (list("x" * 7 + "y") * 5) + list("z" * 5), list("ab" * 3), list("aaaaa"), list("aaaaaa")):
        assert find_runs(coded(words)) == brute(words)


def test_segments_are_stable_and_lose_no_run():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcdefghij") for _ in range(60)] + list("klm" * 5) + [rng.choice("abcdefghij") for _ in range(40)]
        codes, found = coded(words), segments(coded(words), 4, 6)
        for a, b in found:
            assert b - a >= 6 and np.bincount(codes[a:b])[codes[a:b]].min() >= 4
        assert all(any(a <= s and s + n <= b for a, b in found) for s, n, _ in brute(words))


def test_long_periods_and_very_long_texts():
    rng = np.random.default_rng(3)
    for period, times in ((5_000, 5), (1, 200_000), (3, 60_000), (20_011, 4)):
        tail = np.tile(rng.permutation(period) + 10, times)
        codes = np.concatenate((np.arange(7) + 10 + period, tail))
        assert find_runs(codes) == [(7, len(tail), period)]
    assert len(likely_lags(np.zeros(100_000, np.int64))) < 40


def test_table(spark, odd, odd_rows, none):
    more = spark.createDataFrame([(90, " a b\ta\nb a b a b "), (90, "x"), (91, "no no no no no no no"), (92, "é é é é é é")], "doc_id long, text string")
    rows = [r[:2] for r in odd_rows] + [tuple(r) for r in more.collect()]
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words)
        want.append((i, len(words), runs, kept(words, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(odd.select("doc_id", "text").union(more)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs(odd).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic_runs(none).count() == 0


def test_repeated_tails(spark):
    rng = random.Random(4)
    rows = [(i, " \t".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(None, "a b"), (7, None)]
    got = with_repeated_tail(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
        want.append((i, t))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(t != dict(rows)[i] for i, t in want if i not in (None, 7))
