import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sparkworks.llm.warc import page_records, read_warc, salvage, write_warc


def expected(pages):
    top = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if i is not None and len(data) >= 1000:
            top[data] = max(top.get(data, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = top.get(data)
        revisit = first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


PAGES = [(1, "http://a", "é" * 600), (2, None, "é" * 600), (3, "http://c\r\nx: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "é" * 600), (7, "u", "WARC/1.1\r\n\r\n\r\n" * 200), (2, None, "é" * 600), (8, "u", "y" * 300_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit("k"))
    records = read_warc(spark, write_warc(df, str(tmp_path), records_per_file=3))
    assert sorted((tuple(r) for r in page_records(records).collect()), key=repr) == expected(PAGES)
    bodies = {r["record_id"]: r["payload"] for r in records.filter("kind = 'response'").collect()}
    assert bodies["urn:page:8"] == bytearray(b"y" * 300_000)
    empty = df.limit(0)
    assert page_records(read_warc(spark, write_warc(empty, str(tmp_path)))).count() == 0


def test_salvage(spark, tmp_path):
    pages = [(k, "u", f"page {k} " * 300) for k in range(20)]
    out = write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path))
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{out}/part-*")))
    whole = [r for _, _, r, _ in salvage(data) if r]
    assert len(whole) == 20
    plain = gzip.decompress(data)
    assert [r["digest"] for _, _, r, _ in salvage(plain)] == [r["digest"] for r in whole]
    starts = [at for at, _, r, _ in salvage(data) if r]
    for source, places in ((data, [s + 40 for s in starts[3:5]]), (plain, [plain.index(b"page 7 ") + 5, plain.index(b"Content-Length", 9000) + 16])):
        broken = bytearray(source)
        for at in places:
            broken[at] ^= 0x55
        found = list(salvage(bytes(broken)))
        good = [r for _, _, r, _ in found if r]
        gaps = [(at, size, why) for at, size, r, why in found if r is None]
        assert 16 <= len(good) < 20 and gaps and all(size > 0 and why for _, size, why in gaps)
        assert {r["digest"] for r in good} < {r["digest"] for r in whole} and good[-1]["digest"] == whole[-1]["digest"]
    assert [r for _, _, r, _ in salvage(data[:-30]) if r][-1]["digest"] in {r["digest"] for r in whole}
    assert list(salvage(b"")) == [] and list(salvage(b"no archive"))[0][2] is None


def record(number, payload, digest=None, kind="text/plain", block=None):
    fields = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nContent-Type: {kind}\r\n"
    fields += f"WARC-Payload-Digest: {digest}\r\n" if digest else ""
    fields += f"WARC-Block-Digest: {block}\r\n" if block else ""
    return (fields + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def sha1(data, base=32):
    raw = hashlib.sha1(data).digest()
    return "sha1:" + (base64.b32encode(raw).decode() if base == 32 else raw.hex())


def numbers(data):
    return [int(r["record_id"].rsplit(":", 1)[1]) for _, _, r, _ in salvage(data) if r]


def test_digests_of_public_archives():
    """base32 and other algorithms are checked, an HTTP payload is the body, and unknown digests are taken."""
    body = b"<html>x</html>"
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    sound = [
        record(1, body, sha1(body)), record(2, body, sha1(body, 16)), record(3, body, "sha256:" + hashlib.sha256(body).hexdigest()),
        record(4, http, sha1(body), "application/http; msgtype=response", sha1(http)), record(5, body, "xxh3:00ff"), record(6, body), record(7, b"", sha1(b"")),
    ]
    found = [(r["record_id"], r["verified"]) for _, _, r, _ in salvage(b"".join(sound))]
    assert found == [(f"urn:page:{k}", k not in (5, 6)) for k in range(1, 8)]
    for bad in (record(9, body, sha1(b"other")), record(9, http, sha1(http), "application/http"), record(9, body, block=sha1(b"other"))):
        assert numbers(sound[0] + bad + sound[1]) == [1, 2]
        assert [(at, size, why) for at, size, r, why in salvage(sound[0] + bad + sound[1]) if r is None] == [(len(sound[0]), len(bad), "bad digest")]


def test_damaged_members_give_what_is_sound():
    bodies = [hashlib.sha512(bytes([k])).hexdigest().encode() * 9 for k in range(20)]
    plain = [record(k, b, sha1(b)) for k, b in enumerate(bodies)]
    member = gzip.compress(b"".join(plain))
    broken = bytearray(member)
    broken[len(member) * 9 // 10] ^= 0x55
    assert numbers(bytes(broken))[:15] == list(range(15)) and len(numbers(bytes(broken))) < 21
    assert numbers(member[:-4]) == list(range(20))
    assert [why for _, _, r, why in salvage(member[:-4]) if r is None] == ["bad member"]
    split = bytearray(b"".join(map(gzip.compress, plain)))
    for at in range(60, len(gzip.compress(plain[0])), 7):
        once = bytearray(split)
        once[at] ^= 0xFF
        assert numbers(bytes(once))[-19:] == list(range(1, 20))
    assert numbers(bytes(broken) + gzip.compress(plain[3]))[-1] == 3
    mixed = gzip.compress(plain[0]) + plain[1] + gzip.compress(plain[2]) + plain[3]
    assert numbers(mixed) == [0, 1, 2, 3] and all(r for _, _, r, _ in salvage(mixed))
    assert numbers(plain[0] + b"noise" + gzip.compress(plain[1]) + b"\x1f\x8b\x08 noise" + plain[2]) == [0, 1, 2]


def test_a_record_within_a_damaged_payload_is_not_read():
    inner = record(99, b"inner", sha1(b"inner"))
    outer = record(1, b"<p>" + inner + b"</p>", sha1(b"other"))
    assert numbers(outer + record(2, b"x")) == [2]


def test_string_ids_and_damage_that_raises(spark, tmp_path):
    df = spark.createDataFrame([("a-1", "u", "x"), ("b 2", "u", "y")], "page_id string, url string, html string")
    out = write_warc(df, str(tmp_path))
    got = page_records(read_warc(spark, out), "string", whole=True)
    assert {r["page_id"] for r in got.collect()} == {"a-1", "b 2"}
    with open(f"{out}/part-damaged", "wb") as f:
        f.write(b"WARC/1.0\r\nhalf")
    assert page_records(read_warc(spark, out), "string").count() == 2
    with pytest.raises(Exception, match="damaged archive"):
        page_records(read_warc(spark, out), "string", whole=True).collect()
