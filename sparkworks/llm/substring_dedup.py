"""Removal of passages that repeat across documents: seed and extend (operator 9).

A window is ``threshold`` consecutive words.  It is repeated when the same
words start in a document with a smaller id, and every word of a repeated
window goes.

Seeds.  The anchor of a window is its run of ``anchor`` words with the least
hash (winnowing with windows of threshold - anchor + 1 runs), so equal windows
have equal anchors.  Consecutive windows mostly share theirs; such a stretch of
windows is the unit that is shuffled, about one for every 21 words.

Extension.  Stretches meet by anchor.  Where two agree in all words of the
whole stretch, to the left and to the right of the anchor, all their windows
are equal and one comparison settles them.  Where stretches with an anchor
differ somewhere, one stretch of each kind (that of the smallest id) is
extended window by window, which shows how far to either side it agrees with
others.  Adjoining repeated windows of a document add up to its maximal
repeats.

No step makes pairs of documents: anchors, stretches and windows are grouped
by hash with map-side minima, and joins back to the documents are equi-joins
that adaptive execution splits where one passage has many rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.llm.common import settle, small, squeezed, unsqueeze
from sparkworks.llm.textnum import Words, gram_hashes, mix, powers, run_starts, word_chunks

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def sliding_argmin(x: np.ndarray, size: int) -> np.ndarray:
    """The place of the least value, leftmost of equals, in every run of ``size`` values."""
    at = np.arange(len(x))
    step = 1
    # Runs of doubling lengths, then two overlapping ones.
    while 2 * step <= size:
        left, right = at[:-step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        step *= 2
    if step < size:
        left, right = at[: len(x) - size + 1], at[size - step : size - step + len(x) - size + 1]
        at = np.where(x[left] <= x[right], left, right)
    return at[: len(x) - size + 1]


def stretches(words: Words, threshold: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, hash of all words, first window, windows) of each stretch in a chunk."""
    grams = gram_hashes(words.hash, anchor)
    reach = threshold - anchor + 1
    n = len(words.hash)
    if len(grams) < reach:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    chosen = sliding_argmin(grams, reach)
    doc = words.document()
    windows = np.flatnonzero(doc[: n - threshold + 1] == doc[threshold - 1 :])
    if not len(windows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    first = run_starts(chosen[windows] + n * doc[windows])
    start = windows[first]
    count = np.diff(np.append(first, len(windows)))
    place = chosen[start]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words.hash * powers(_BASE, n), out=total[1:])
    whole = (total[start + count - 1 + threshold] - total[start]) * powers(_BASE_INV, n)[start]
    whole = mix(mix(whole) ^ (count.astype(np.uint64) << np.uint64(20)) ^ (place - start).astype(np.uint64))
    return doc[start], grams[place], whole, start - words.at[doc[start]], count


def _emit_stretches(threshold: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch["text"], lower=False):
                doc, seed, whole, first, count = stretches(words, threshold, anchor)
                where = pa.array(doc)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), own["id"].take(where), own["version"].take(where), pa.array((first << 32) | count)], ["seed", "whole", "id", "version", "span"]
                )

    return run


def _emit_windows(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small(whole)):
            for a, b, words in word_chunks(unsqueeze(batch["text"]), lower=False):
                own = batch.slice(a, b - a)
                hashes = gram_hashes(words.hash, threshold)
                doc, place = [], []
                for k, spans in enumerate(own["spans"]):
                    at = np.unique(np.concatenate([np.arange(s >> 32, (s >> 32) + (s & 0xFFFFFFFF)) for s in spans.as_py()]))
                    doc.append(np.full(len(at), k))
                    place.append(at)
                doc, place = np.concatenate(doc), np.concatenate(place)
                where = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[words.at[doc] + place].view(np.int64)), own["id"].take(where), own["version"].take(where), pa.array((place << 32) | 1)], ["window", "id", "version", "span"])

    return run


def _cut(threshold: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in small(whole)):
            total, gone, kept, after = [], [], [], []
            for data, spans in zip(batch["text"], batch["spans"], strict=True):
                text = engine.decompress(data.as_py())
                words = _SPLIT.findall(text)
                removed = 0
                if spans.is_valid:
                    covered = np.zeros(len(words) + 1, np.int64)
                    for s in spans.as_py():
                        covered[s >> 32] += 1
                        covered[(s >> 32) + (s & 0xFFFFFFFF) - 1 + threshold] -= 1
                    stays = np.cumsum(covered)[:-1] == 0
                    removed = len(words) - int(stays.sum())
                    words = [words[k] for k in np.flatnonzero(stays).tolist()] if removed else words
                total.append(len(words) + removed)
                gone.append(removed)
                kept.append(b" ".join(words).decode())
                if keep:
                    after.append(kept[-1] if removed else text.decode())
            out = {c: batch[c] for c in batch.schema.names if c not in ("text", "spans")}
            out |= {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            out |= {"after": pa.array(after, pa.string())} if keep else {"kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def remove_repeats(df: DataFrame, threshold: int = 50, anchor: int = 10, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    Words are runs of characters other than ASCII white space.  With ``keep``
    the result has the columns of ``df``, with the text that is left (as it
    was, where nothing is removed), and n_words and n_removed, which replace
    columns of these names.  A null text counts as empty, shorter texts than a window lose nothing, and
    a row without an id neither loses words nor makes others lose any.  Rows
    that repeat an id are one document as far as "smaller" goes.  An empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row")] if keep else []
    # A version tells rows with one id and different texts apart.
    plain = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"), *carried)
    kind = plain.schema["id"].dataType.simpleString()
    runs = plain.filter("id is not null").select("id", "version", "text").mapInArrow(_emit_stretches(threshold, anchor), f"seed long, whole long, id {kind}, version long, span long")
    # Stretches are made twice: that costs less than keeping those, nearly all, whose anchor occurs in one document.
    # What is grouped is settled before it is joined: only then can the join split a passage that has many rows.
    seeds = settle(runs.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("whole") < F.max("whole")).alias("mixed")).filter("low < high").select("seed", "mixed"))
    shared = settle(runs.join(seeds, "seed"))
    firsts = settle(shared.groupBy("seed", "whole").agg(F.min("id").alias("first")))
    met = shared.join(firsts, ["seed", "whole"]).select("id", "version", "span", (F.col("id") > F.col("first")).alias("repeated"), "mixed").filter("repeated or mixed")
    met = settle(met)
    open_spans = met.filter("not repeated").groupBy("id", "version").agg(F.collect_list("span").alias("spans"))
    texts = squeezed(plain)
    windows = texts.select("id", "version", "text").join(open_spans, ["id", "version"]).select("id", "version", "text", "spans").mapInArrow(_emit_windows(threshold), f"window long, id {kind}, version long, span long")
    windows = settle(windows)
    least = settle(windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"))
    hits = windows.join(least, "window").filter("id > first").select("id", "version", "span")
    spans = met.filter("repeated").select("id", "version", "span").unionByName(hits).groupBy("id", "version").agg(F.collect_set("span").alias("spans"))
    fields = T.StructType([f for f in texts.schema if f.name in ("id", "row")]).add("n_words", "long").add("n_removed", "long").add("after" if keep else "kept_text", "string")
    out = texts.join(spans, ["id", "version"], "left").drop("version").mapInArrow(_cut(threshold, keep), fields)
    if keep:
        own = [F.col("after").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ("n_words", "n_removed")]
        return out.select(*own, "n_words", "n_removed")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_text")
