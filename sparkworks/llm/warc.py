"""WARC archives: a writer on Spark's text sink and a salvaging reader (operator 5).

Each record is a gzip member of its own.  Spark's text sink puts a separator
after every row; here it is an empty gzip member, so a file is a plain sequence
of members that any gzip or WARC reader takes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "text/html; charset=utf-8"
_NAMED = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")

RECORDS = "archive string, at long, size long, kind string, record_id string, uri string, refers_to string, digest string, full_bytes long, payload binary, verified boolean, problem string"
#: Algorithms whose digests are checked, with the digests' bytes; others are taken as they are.
_DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


# --- writing -----------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Decide each page's record: page_id, url, payload, digest, refers_to (null: a response).

    Of pages with equal payloads of ``least`` bytes or more, the one with the
    largest id is the response.  The group is found by SHA-256,
    with a map-side maximum first, so copies do not gather in one task; the
    pages then meet their group in a join, which adaptive execution splits
    where one payload has many pages.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("payload").cast("binary"), 256)))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    rows = rows.join(shared, "key", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("digest"), first.alias("refers_to"))


def record_text(page_id, url, payload, digest, refers_to):
    """A WARC record without its closing blank lines, as one Column."""
    revisit = refers_to.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    clean = F.regexp_replace(url, "[\\r\\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        maybe(page_id.isNotNull(), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">")))),
        maybe(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))),
        maybe(url.isNotNull(), line("WARC-Target-URI", clean)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("X-Payload-Bytes", F.octet_length(payload).cast("string")),
        F.lit(f"Content-Type: {CONTENT_TYPE}\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body,
    )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = [zlib.compress((x.as_py() + "\r\n\r\n").encode(), wbits=31) for x in batch["value"]]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, records_per_file: int = 2000) -> str:
    """Write a record per page to a new folder below ``path`` and return it.

    ``records_per_file`` bounds a file, which the reader takes whole.  Nulls: html counts as empty, a url
    or an id is left out of the header.  An empty table gives a folder without
    records.
    """
    out = f"{path.rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = plan_records(pages, id_col, url_col, html_col, least)
    text = record_text(*(F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to")))
    members = records.select(text.alias("value")).mapInArrow(_compress, "value binary")
    # The cast keeps all bytes; so does the sink, and the separator's bytes are those of its characters in Latin-1.
    sink = members.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    sink.option("maxRecordsPerFile", records_per_file).text(out)
    return out


# --- reading -----------------------------------------------------------------


def _header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and the place after them of a record whose version line is at ``at``."""
    if not (m := _NAMED.match(data, at)):
        return None
    fields, at = {}, m.end()
    while m := _FIELD.match(data, at):
        fields[m[1].lower()] = m[2].strip()
        at = m.end()
    if data[at : at + 2] != b"\r\n" or not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, at + 2


def named_digest(field: bytes | None) -> tuple[str, bytes] | None:
    """Algorithm and raw digest of a digest field, in hex or base32; None where either is unknown."""
    algorithm, _, value = (field or b"").decode("latin-1").partition(":")
    algorithm, value = algorithm.lower().replace("-", ""), value.strip()
    size = _DIGESTS.get(algorithm)
    if size is None:
        return None
    try:
        if len(value) == 2 * size:
            return algorithm, bytes.fromhex(value)
        raw = base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return None
    return (algorithm, raw) if len(raw) == size else None


def _entity(fields: dict[bytes, bytes], block: bytes) -> bytes:
    """What a payload digest covers: of an HTTP message the part after its header, else the whole block."""
    if fields.get(b"content-type", b"").lower().startswith(b"application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        return body if blank else block
    return block


def _checked(fields: dict[bytes, bytes], block: bytes, revisit: bool) -> bool | None:
    """Whether the digests that the record names agree with it; None where it names none that can be checked."""
    own = []
    if named := named_digest(fields.get(b"warc-block-digest")):
        own.append(hashlib.new(named[0], block).digest() == named[1])
    # A revisit names the payload that it leaves out, a truncated record one that it has in part.
    if not revisit and b"warc-truncated" not in fields and (named := named_digest(fields.get(b"warc-payload-digest"))):
        own.append(hashlib.new(named[0], _entity(fields, block)).digest() == named[1])
    return all(own) if own else None


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``, where it ends (``at`` where that is unknown), and what is wrong with it."""
    if (head := _header(data, at)) is None:
        return None, at, "bad header"
    fields, body = head
    end = body + int(fields[b"content-length"])
    if end > len(data):
        return None, at, "cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "bad length"
    payload = data[body:end]
    kind = fields.get(b"warc-type", b"").decode("latin-1")
    verified = _checked(fields, payload, kind == "revisit")
    if verified is False:
        return None, end + 4, "bad digest"
    bare = lambda x: x.decode("utf-8", "replace").strip("<>") if x is not None else None
    named = named_digest(fields.get(b"warc-payload-digest"))
    digest = named[1].hex() if named and named[0] == "sha1" else None
    if digest is None and kind != "revisit":
        digest = hashlib.sha1(_entity(fields, payload)).hexdigest()
    size = fields.get(b"x-payload-bytes", b"")
    return {
        "kind": kind, "record_id": bare(fields.get(b"warc-record-id")), "uri": bare(fields.get(b"warc-target-uri")), "refers_to": bare(fields.get(b"warc-refers-to")),
        "digest": digest, "full_bytes": int(size) if size.isdigit() else len(payload), "payload": payload, "verified": bool(verified),
    }, end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, where reading it ended, and whether it is whole and sound."""
    engine, parts = zlib.decompressobj(31), []
    while not engine.eof and at < len(data):
        before = engine.copy()
        try:
            parts.append(engine.decompress(data[at : at + 65536]))
            at += 65536
        except zlib.error:
            # Everything before the byte that fails is kept.
            for k in range(at, min(at + 65536, len(data))):
                try:
                    parts.append(before.decompress(data[k : k + 1]))
                except zlib.error:
                    return b"".join(parts), k, False
            return b"".join(parts), min(at + 65536, len(data)), False
    end = min(at, len(data)) - len(engine.unused_data)
    return b"".join(parts), end, engine.eof


def _next(data: bytes, begun: int, at: int, members: bool) -> int:
    """Where the next version line from ``at`` or, among ``members``, gzip member after ``begun`` may start; else the end.

    A damaged member may be read on into the next, so members are looked for
    from its start; version lines in it may be those of stored records.
    """
    line = _NAMED.search(data, at)
    places = [line.start()] if line else []
    if members and (found := data.find(MEMBER, begun + 1)) >= 0:
        places.append(found)
    return min(places, default=len(data))


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, dict | None, str]]:
    """(place, size, record or None for a gap, problem) of all that can be read from an archive.

    Records may be plain or in gzip members, in any order.  A plain record that
    fails its digest but ends where it says is one gap, whatever its payload
    looks like.  A member that fails its checks is a gap up to the next sound
    member or record; of what it gave before it failed, records that a digest
    confirms are kept.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        begun, after, found, problem = at, at, [], ""
        if members and data.startswith(MEMBER, at):
            inner, end, sound = _member(data, at)
            after = end if sound else at
            problem = "" if sound else "bad member"
            for _, _, record, fault in salvage(inner, members=False):
                if sound or (record and record["verified"]):
                    found.append((begun, end - begun, record, fault))
            at = max(end, begun + 1)
        else:
            record, after, problem = _record(data, at)
            if record is not None:
                found.append((at, after - at, record, ""))
            at = after
        if problem:
            if gap is None:
                gap, why = begun, problem
            yield from found
            # A record of known length is stepped over, and ended its gap.
            at = _next(data, begun, max(at, begun + 1), members) if after == begun else after
        if gap is not None and (not problem or after > begun):
            yield gap, (after if problem else begun) - gap, None, why
            gap = None
        if not problem:
            yield from found
            at = after
    if gap is not None:
        yield gap, len(data) - gap, None, why


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, held = [], 0
            for at, size, record, problem in salvage(content.as_py() or b""):
                rows.append({"archive": path.as_py(), "at": at, "size": size, "problem": problem or None} | (record or {}))
                held += len(record["payload"]) if record else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below ``path``, gzip members or plain.

    A row with ``problem`` is a quarantined gap: ``at`` and ``size`` are its
    bytes in the file (or those of the member around it), and the other
    columns are null.  ``verified`` says whether a digest was checked: those in
    hex or base32 of MD5 or the SHA family are, others are taken as they are.
    All later records are recovered from the next valid
    member or version line.  Files are dealt one by one, each read whole.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_read, RECORDS)


def page_records(records: DataFrame, id_type: str = "long", whole: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the sound records.

    ``id_type`` is the type of the pages' ids.  With ``whole`` a quarantined
    gap raises an error, for its pages would be missing; else gaps are left out.
    """
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'urn:page:(.*)$', 1), '') as {id_type})")
    sound = F.col("problem").isNull()
    if whole:
        fault = F.concat(F.lit("damaged archive: "), F.col("problem"), F.lit(" at "), F.col("at").cast("string"), F.lit(" of "), F.col("archive"))
        sound = F.when(sound, True).otherwise(F.raise_error(fault).cast("boolean"))
    return records.filter(sound).select(
        page("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to")
    )
