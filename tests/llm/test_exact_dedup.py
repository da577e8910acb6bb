import hashlib

from pyspark.sql import functions as F

from sparkworks.llm.exact_dedup import drop_exact_duplicates, exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, digest):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, digest(text)) for i in ids]
    return sorted(out, key=repr)


def test_against_brute_force(odd, odd_rows):
    got = [tuple(r) for r in exact_dedup(odd, salts=3).collect()]
    assert sorted(got, key=repr) == expected(odd_rows, lambda t: hashlib.sha256(t.encode()).hexdigest())


def test_colliding_digests_are_told_apart(odd, odd_rows):
    got = [tuple(r) for r in exact_dedup(odd, digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)).collect()]
    assert sorted(got, key=repr) == expected(odd_rows, lambda t: hashlib.sha256(t.encode()).hexdigest()[:1])


def test_rows_that_stay(odd, odd_rows, none):
    kept = [(r["doc_id"], r["text"]) for r in drop_exact_duplicates(odd).collect()]
    assert len(kept) == len({lower(r[1]) for r in odd_rows}) and drop_exact_duplicates(odd).columns == odd.columns
    assert exact_dedup(none).count() == 0 and drop_exact_duplicates(none).count() == 0
