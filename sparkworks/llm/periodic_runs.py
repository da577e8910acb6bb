"""Periodic runs of words inside a document (operator 11).

A run is a stretch of consecutive words with smallest period q, of at least
``power`` periods and ``least`` words, that no neighbouring word extends.

Splitting.  Every word of a run occurs ``power`` times inside it.  So a word
that occurs less often within its segment is in no run there: such words split
the segment, and the parts are counted anew until none of their words is rare.
Ordinary text falls apart in one or two rounds.

Scanning.  A surviving segment is compared with itself at a lag, and stretches
of equal words are its runs of that period.  Which lags are worth a scan shows
from sampled words: for lags from s to 2s - 1 every s-th word is looked at, one
of which lies in the first period of any run, and the 2s words from there must
come again at the lag.  Of several lags at one sample only the least can be the
period of a run (Fine and Wilf), so a scale costs as much as one scan.

Documents are independent: a task works on its own rows, a MB of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.llm.common import tidy
from sparkworks.llm.textnum import chunks, text_buffers


def segments(codes: np.ndarray, power: int, least: int) -> list[tuple[int, int]]:
    """Segments [a, b) of at least ``least`` words, each of which occurs ``power`` times within its own segment."""
    place = np.flatnonzero(np.bincount(codes)[codes] >= power)
    part = np.zeros(len(place), np.int64)
    kinds = int(codes.max()) + 1 if len(codes) else 1
    out: list[tuple[int, int]] = []
    while True:
        # Words that stayed and adjoin within one part are a part of the next round.
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(part) != 0)) + 1 if len(place) else np.zeros(0, np.int64)
        first = np.concatenate((np.zeros(min(1, len(place)), np.int64), cut))
        size = np.diff(np.append(first, len(place)))
        part = np.repeat(np.arange(len(size)), size)
        long_enough = np.repeat(size >= least, size)
        place, part = place[long_enough], part[long_enough]
        if not len(place):
            return sorted(out)
        _, which, times = np.unique(part * kinds + codes[place], return_inverse=True, return_counts=True)
        stays = times[which] >= power
        hurt = np.zeros(len(size), bool)
        hurt[part[~stays]] = True
        for k in np.flatnonzero((size >= least) & ~hurt).tolist():
            out.append((int(place[np.searchsorted(part, k)]), int(place[np.searchsorted(part, k)] + size[k])))
        open_ = stays & hurt[part]
        place, part = place[open_], part[open_]


def likely_lags(codes: np.ndarray) -> np.ndarray:
    """Lags that hold the period of every run of four periods or more."""
    found = []
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)  # of the s words from each place
    s = 1
    while 4 * s <= len(codes):
        double = rank[:-s] * (int(rank.max()) + 1) + rank[s:]
        double = np.unique(double, return_inverse=True)[1].astype(np.int64)
        at = np.arange(0, len(double) - s, s)
        if len(at):
            wide = np.concatenate((double, np.full(2 * s, -1)))
            later = np.lib.stride_tricks.sliding_window_view(wide, s)[at + s]
            same = later == double[at][:, None]
            found.append(s + same.argmax(axis=1)[same.any(axis=1)])
        rank, s = double, 2 * s
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def find_runs(codes: np.ndarray, power: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period; ``power`` is 4 or more."""
    if power < 4:
        raise ValueError("runs of fewer than four periods are not told from their lags")
    out = []
    for a, b in segments(codes, power, least):
        own = codes[a:b]
        for q in likely_lags(own).tolist():
            same = np.zeros(len(own) - q + 2, np.int8)
            same[1:-1] = own[q:] == own[:-q]
            edge = np.flatnonzero(np.diff(same))
            start, length = edge[::2], edge[1::2] - edge[::2] + q
            good = length >= max(least, power * q)
            for s, n in zip(start[good].tolist(), length[good].tolist(), strict=True):
                # A smaller period of so long a stretch divides q, and then q over one of its primes is a period.
                if not any(np.array_equal(own[s : s + q], own[s + q // p : s + q // p + q]) for p in _prime_factors(q)):
                    out.append((a + s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if runs:
        over = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            over[start + period] += 1
            over[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(over)[:-1] == 0).tolist()]
    return b" ".join(words)


def _emit(power: int, least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            for a, b in chunks(offsets):
                rows, kept, total = [], [], []
                for k in range(a, b):
                    words = raw[offsets[k] : offsets[k + 1]].tobytes().split()
                    code: dict[bytes, int] = {}
                    codes = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
                    # Where all words differ there is nothing to count.
                    runs = find_runs(codes, power, least) if len(words) >= least and len(code) + power <= len(words) + 1 else []
                    rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(_collapse(words, runs).decode())
                    total.append(len(words))
                yield pa.RecordBatch.from_arrays([batch["row"].slice(a, b - a), pa.array(total, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())], ["row", "n_words", "runs", "collapsed"])

    return tidy(run)


def periodic_runs(df: DataFrame, power: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are runs of characters other than ASCII white space, numbered from 0
    and compared as they are.  ``collapsed`` has the words, joined by one
    space, but those that a run holds after its first ``period`` words.  A null
    or empty text has no words and no runs.  Rows count one by one, whatever
    ids are null or repeat; an empty table gives no rows, and other columns
    are ignored.
    """
    plain = df.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    fields = T.StructType([plain.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    return plain.mapInArrow(_emit(power, least), fields).select(F.col("row.id").alias("doc_id"), "n_words", "runs", "collapsed")


def with_repeated_tail(df: DataFrame, share: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` where one document in ``share``, by crc32 of its id, gets a tail of equal periods.

    With g = floor(crc32 / share) and n words, each word i from a = g % n on
    becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).
    A document without words or without an id stays as it is.
    """
    chosen = F.crc32(F.col(id_col).cast("string")) % share == 0
    words = F.when(chosen, F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    rows = df.withColumn("_words", words)

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(F.crc32(F.col(id_col).cast("string")) / share)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")

    return rows.withColumn(text_col, F.when(F.size("_words") > 0, tail(F.col("_words"))).otherwise(F.col(text_col))).drop("_words")
