"""Language identification by hyperdimensional profiles (operator 10).

Every letter has a random vector of +1 and -1.  A run of three characters
becomes the product of its letters' vectors, the first rotated twice and the
second once; texts and languages are sums of such vectors, and a text takes
the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkworks.llm.common import tidy
from sparkworks.llm.textnum import chunks, mix, run_starts, text_buffers

GRAM = 3
UNKNOWN = "und"
#: There are some 7000 living languages; a column with more values holds something else.
MOST_LANGUAGES = 10_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        if (c := chr(k)).isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def letter_vectors(codes: np.ndarray, size: int) -> np.ndarray:
    """A row of +1 and -1 per code, the same in every process."""
    blocks = np.arange((size + 63) // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64)[:, None] + np.uint64(77)) + blocks[None, :] * np.uint64(0x9E3779B97F4A7C15))
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)[:, :size]
    return flat.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, size: int) -> np.ndarray:
    """Bound vectors of packed three-letter grams."""
    mask = np.uint64((1 << 21) - 1)
    parts = [(grams >> np.uint64(21 * k)) & mask for k in range(GRAM)]  # last letter first
    out = np.ones((len(grams), size), np.float32)
    for k, part in enumerate(parts):
        codes, inverse = np.unique(part, return_inverse=True)
        out *= np.roll(letter_vectors(codes, size), k, axis=1)[inverse]
    return out


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count) for every distinct gram of each document of a chunk, and the letters per document.

    Characters that are no letters count as blanks, runs of blanks as one, and
    a text has a blank before and after it; a gram of blanks alone is left out.
    """
    table = letters()
    n = len(offsets) - 1
    texts = [np.frombuffer(raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for k in range(n)]
    marks = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    codes = np.zeros(marks[-1] + 1, np.uint32)
    for k, own in enumerate(texts):
        codes[marks[k] + 1 : marks[k + 1]] = own
    codes = table[codes]
    blank = codes == 0
    doc = np.append(np.repeat(np.arange(n), np.diff(marks)), max(n - 1, 0))
    has = np.bincount(doc, ~blank, minlength=n)[:n]
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    keep[marks[:-1]] = True  # each document has its own leading blank
    codes, doc = codes[keep], doc[keep]
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    alphabet, small = np.unique(codes, return_inverse=True)
    width = max(1, int(len(alphabet) - 1).bit_length())
    small = small.astype(np.uint64)
    gram = (small[:-2] << np.uint64(2 * width)) | (small[1:-1] << np.uint64(width)) | small[2:]
    # The blank that starts the next document also ends this one.
    sound = (doc[:-2] == doc[1:-1]) & ((doc[:-2] == doc[2:]) | (codes[1:-1] != 0))
    key = np.sort((doc[:-2][sound].astype(np.uint64) << np.uint64(3 * width)) | gram[sound])
    first = run_starts(key)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    mask = np.uint64((1 << width) - 1)
    wide = np.zeros(len(key), np.uint64)
    for k in range(GRAM):
        wide |= alphabet[((key >> np.uint64(width * k)) & mask).astype(np.int64)].astype(np.uint64) << np.uint64(21 * k)
    return (key >> np.uint64(3 * width)).astype(np.int64), wide, count, has


def document_vectors(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int, size: int) -> np.ndarray:
    """The bundled vector of each of n documents."""
    out = np.zeros((n, size), np.float32)
    if not len(doc):
        return out
    grams, inverse = np.unique(gram, return_inverse=True)
    vectors = gram_vectors(grams, size)
    weight = count.astype(np.float32)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for k in range(n):
        a, b = bounds[k], bounds[k + 1]
        if b > a:
            out[k] = weight[a:b] @ vectors[inverse[a:b]]
    return out


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch["lang"].to_pylist(), object)
            raw, offsets = text_buffers(batch["text"])
            for a, b in chunks(offsets):
                doc, gram, count, _ = gram_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(doc):
                    continue
                own = languages[a:b][doc]
                grams, inverse = np.unique(gram, return_inverse=True)
                vectors = gram_vectors(grams, size)
                for language in set(own.tolist()):
                    mine = own == language
                    weight = np.bincount(inverse[mine], count[mine], minlength=len(grams)).astype(np.float32)
                    sums[language] = sums.get(language, 0) + (weight @ vectors).astype(np.float64)
            if len(sums) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} different languages: is this a column of languages?")
        if sums:
            names = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x in names for _ in range(size)]), pa.array(np.tile(np.arange(size, dtype=np.int32), len(names))), pa.array(np.concatenate([sums[x] for x in names]).round().astype(np.int64))], ["lang", "place", "value"]
            )

    return run


def learn_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 512) -> dict[str, list[float]]:
    """A vector per language, from all rows with a language and a letter.

    Every task bundles its rows; the sums meet by (language, place).  The
    driver gets ``size`` numbers a language.  More than ``MOST_LANGUAGES``
    different ones raise a ValueError.
    """
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_profiles(size), "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, list[float]] = {}
    for r in sums.limit(size * MOST_LANGUAGES + 1).collect():
        out.setdefault(r["lang"], [0.0] * size)[r["place"]] = float(r["value"])
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages: is this a column of languages?")
    return out


def _predict(names: list[str], profiles: np.ndarray, size: int, inside: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"] if inside is None else batch["row"].field(inside))
            best, score = [], []
            for a, b in chunks(offsets):
                doc, gram, count, has = gram_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                vectors = document_vectors(doc, gram, count, b - a, size)
                norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-30)
                cosine = (vectors @ profiles.T) / norm[:, None] if len(names) else np.zeros((b - a, 1))
                top = cosine.argmax(axis=1)
                found = (has > 0) & bool(names)
                best += [names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), found.tolist(), strict=True)]
                score += np.where(found, np.clip(cosine[np.arange(b - a), top], 0, 1), 0.0).astype(np.float64).tolist()
            out = {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}
            if "row" in batch.schema.names:
                out["row"] = batch["row"]
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return tidy(run)


def identify(df: DataFrame, profiles: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 at least) per row.

    With ``keep`` a last column ``row`` has all columns of ``df``.
    ``und`` with score 0 where the text is null, has no letter, or no profile
    was learned.  Ties go to the language that sorts first.
    """
    names = sorted(profiles)
    size = len(profiles[names[0]]) if names else 64
    table = np.array([profiles[x] for x in names], np.float32).reshape(len(names), size)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)
    # A kept row has its text already, and texts cross to Python once.
    carried = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row") if keep else F.col(text_col).alias("text")
    rows = df.select(F.col(id_col).alias("doc_id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), carried)
    fields = T.StructType([f for f in rows.schema if f.name not in ("text", "row")]).add("lang_pred", "string").add("score", "double")
    for f in rows.schema:
        if f.name == "row":
            fields.add(f)
    return rows.mapInArrow(_predict(names, table, size, df.columns.index(text_col) if keep else None), fields)
