"""Phrases whose words occur together, by prefix-free parsing (operator 12).

Parsing.  Texts fall into pieces at punctuation, and pieces into chunks: a
chunk ends where the hash of the next ``longest - 1`` words is a trigger, and
takes these words along, so neighbours overlap by them.  Where a chunk is cut
depends on its words alone, so equal passages give equal chunks, which are a
dictionary with the frequency of each.

Counting.  Phrases are counted inside distinct chunks and weighted by the
chunk's frequency.  A phrase belongs to the chunk that its first word belongs
to, and the words of an overlap belong to the later chunk, so each occurrence
is counted once.

A phrase is never more frequent than a part of it.  So words are counted
first, then phrases of two words that are both frequent, then longer ones
whose pairs are all frequent.  Tasks know what is frequent from a bitmap of
fixed size: equal bits of two phrases let a rare one be counted, and it falls
out by its count.  Counts are keyed by the phrase itself and combined before
they are shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import lower_ascii, settle, shared_folder, tidy
from sparkworks.llm.textnum import _BASE, _BASE_INV, _BYTE, gram_hashes, mix, powers, run_starts, text_buffers
from sparkworks.operators.ranges import with_rank_in

#: One gram in so many is a trigger.
TRIGGER = np.uint64(16)
#: Bits of the map of frequent phrases: 4 MB, whatever the corpus.
BITS = 1 << 25
#: Bytes of chunks that a task counts at a time.
AT_ONCE = 4 << 20

_END = np.zeros(256, bool)
_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE = _END.copy()
_OUTSIDE[list(b" \t")] = True


class Pieces:
    """Words of a run of texts: byte ranges, hashes, and where each piece begins; ``doc`` is the text of a word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        inside = ~_OUTSIDE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:n] if n else inside
        after = np.concatenate((inside[1:], [False])) & ~edge[1:] if n else inside
        self.raw = raw
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        ends = np.cumsum(_END[raw])[self.start] if n else self.start
        self.first = np.ones(len(self.start), bool)
        self.first[1:] = (np.diff(ends) != 0) | (np.diff(self.doc) != 0)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_BASE, n), out=total[1:])
        value = total[self.end] - total[self.start]
        if n:
            value *= powers(_BASE_INV, n)[self.start]
        self.hash = mix(value ^ (self.end - self.start).astype(np.uint64))


def slices(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The byte ranges [first, last) as strings."""
    at = np.concatenate(([0], np.cumsum(last - first)))
    data = raw[np.arange(at[-1]) + np.repeat(first - at[:-1], last - first)]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def spaced(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each with one space after it, and where each begins (and an end)."""
    size = pieces.end - pieces.start + 1
    at = np.concatenate(([0], np.cumsum(size)))
    joined = np.append(pieces.raw, np.uint8(32))[np.arange(at[-1]) + np.repeat(pieces.start - at[:-1], size)]
    joined[at[1:] - 1] = 32
    return joined, at


def parse(pieces: Pieces, overlap: int, trigger: np.uint64 = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, words that belong to it) of each chunk."""
    n = len(pieces.start)
    cut = pieces.first.copy()
    if overlap and n >= overlap:
        piece = np.cumsum(pieces.first)
        here = gram_hashes(pieces.hash, overlap) % trigger == 0
        here &= piece[: n - overlap + 1] == piece[overlap - 1 :]
        cut[: n - overlap + 1] |= here
    elif not overlap:
        cut |= pieces.hash % trigger == 0
    first = np.flatnonzero(cut)
    following = np.append(first[1:], n)
    inner = np.append(~pieces.first[first[1:]], False) if len(first) else np.zeros(0, bool)
    return first, following - 1 + overlap * inner, following - first


def _emit_chunks(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, "right")) - 1)
                pieces = Pieces(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                first, last, own = parse(pieces, overlap)
                joined, at = spaced(pieces)
                chunk = slices(joined, at[first], at[last + 1] - 1)
                lang = batch["lang"].take(pa.array(pieces.doc[first] + a))
                found = pa.table({"lang": lang, "own": pa.array(own, pa.int32()), "chunk": chunk}).group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
                yield from found.rename_columns(["lang", "own", "chunk", "n"]).combine_chunks().to_batches()
                a = b

    return tidy(run)


def _marks(lang: pa.Array, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the bitmap of phrases in the languages that ``of`` points at."""
    salt = np.array([int.from_bytes(hashlib.blake2b(x.as_py().encode(), digest_size=8).digest(), "little") for x in lang], np.uint64)
    return (mix(hashes ^ salt[of]) % np.uint64(BITS)).astype(np.int64)


def _emit_counts(sizes: tuple[int, ...], parts: int, known):
    """Counts of the phrases of given sizes whose parts of ``parts`` words are all marked (0: all)."""

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_buffers(table["chunk"])
        words = Pieces(raw, offsets)
        langs = table["lang"].combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[words.doc]
        begin = np.searchsorted(words.doc, np.arange(len(offsets) - 1))
        owned = np.arange(len(words.doc)) < begin[words.doc] + table["own"].to_numpy().astype(np.int64)[words.doc]
        stop = np.append(begin[1:], len(words.doc))[words.doc]
        weight = table["n"].to_numpy()[words.doc]
        code = slices(raw, words.start, words.end).dictionary_encode().indices.to_numpy().astype(np.int64)
        kinds = int(code.max()) + 1 if len(code) else 1
        if parts:
            bits = known.value
            held = np.zeros(len(words.start), bool)
            grams = gram_hashes(words.hash, parts)
            place = _marks(langs.dictionary, lang[: len(grams)], grams)
            held[: len(grams)] = (bits[place >> 3] >> (place & 7)) & 1
        for size in sizes:
            good = owned & (np.arange(len(stop)) + size <= stop)
            if parts:
                for k in range(size - parts + 1):
                    good[: len(good) - k] &= held[k:]
            at = np.flatnonzero(good)
            if not len(at):
                continue
            key = lang[at]
            for k in range(size):
                key = np.unique(key * kinds + code[at + k], return_inverse=True)[1]
            total = np.zeros(int(key.max()) + 1, np.int64)
            np.add.at(total, key, weight[at])
            one = np.empty(len(total), np.int64)
            one[key] = at
            text = slices(raw, words.start[one], words.end[one + size - 1])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[one])), pa.array(np.full(len(total), size, np.int32)), text, pa.array(total)], ["lang", "size", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch["chunk"].nbytes
            if size >= AT_ONCE:
                yield from count(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from count(pa.Table.from_batches(held))

    return tidy(run)


def _emit_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Pieces(*text_buffers(batch["phrase"]))
        begin = run_starts(words.doc)
        sizes = np.diff(np.append(begin, len(words.doc)))
        langs = batch["lang"].dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            place = np.unique(_marks(langs.dictionary, lang[at], gram_hashes(words.hash, size)[begin[at]]))
            cell = place >> 5
            first = run_starts(cell)
            mask = np.bitwise_or.reduceat(np.int64(1) << (place & 31), first) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(mask)], ["cell", "mask"])


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bits of all given phrases: at most BITS of them reach the driver."""
    cells = frequent.select("lang", "phrase").mapInArrow(_emit_bits, "cell long, mask long").groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[cells["cell"].to_numpy()] = cells["mask"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def chunk_dictionary(df: DataFrame, longest: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, own, chunk, n): distinct chunks, how many of their words belong to them, and their frequency."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    plain = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    found = plain.mapInArrow(_emit_chunks(longest - 1), "lang string, own int, chunk string, n long")
    return found.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n"))


def phrase_counts(chunks: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, size, phrase, n) of all words and phrases that occur ``least`` times; the result is settled."""
    context = chunks.sparkSession.sparkContext

    def counted(sizes: tuple[int, ...], parts: int, known) -> DataFrame:
        found = chunks.mapInArrow(_emit_counts(sizes, parts, known), "lang string, size int, phrase string, n long")
        return settle(found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))

    words = counted((1,), 0, None)
    pairs = counted((2,), 1, context.broadcast(_bitmap(words)))
    out = words.unionByName(pairs)
    if longest > 2:
        out = out.unionByName(counted(tuple(range(3, longest + 1)), 2, context.broadcast(_bitmap(pairs))))
    return out


def collocations(df: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A candidate has 2 to ``longest`` words and occurs a >= ``least`` times.
    Cut in two it gives floor(scale * a / (l + r)) from the counts of its
    parts; the lowest cut counts, the earliest of equals.  Candidates inside a
    longer one with at least ``cover`` hundredths of their count go.  Order:
    score and a, both falling, then phrase by its bytes.  n counts the
    language's words.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` and then at
    blanks and tabs.  A null text has no words, a null language is ``und``,
    repeated rows count each time, and an empty table gives no rows.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    session = df.sparkSession
    folder = f"{shared_folder(session).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    chunk_dictionary(df, longest, lang_col, text_col).write.parquet(folder)
    chunks = session.read.parquet(folder)
    counts = phrase_counts(chunks, longest, least)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("total"))
    candidates = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    # The lowest cut.
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = F.expr(f"CAST(a AS DECIMAL(19, 0)) * {scale} div (CAST(l AS DECIMAL(19, 0)) + r)")
    scored = cut.select("lang", "size", "phrase", "a", F.struct(exact.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.any_value("size").alias("size"), F.any_value("a").alias("a"), F.min("cut").alias("cut"))
    # Parts of longer candidates.
    inner = [F.when(F.col("size") >= max(k + s, s + 1), F.expr(f"array_join(slice(split(phrase, ' ', -1), {k + 1}, {s}), ' ')")) for s in range(2, longest) for k in range(longest - s + 1)]
    if inner:
        parts = candidates.select("lang", F.col("a").alias("longer"), F.explode(F.array(*inner)).alias("phrase")).filter("phrase is not null").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        covered = F.expr(f"CAST(longer AS DECIMAL(19, 0)) * 100 >= CAST(a AS DECIMAL(19, 0)) * {cover}")
        scored = scored.join(parts, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~covered)
    scored = settle(scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").cast("long").alias("score")))
    # Ranks over the whole table, less those of the languages before: no task ranks a language.
    ranked = with_rank_in(scored, "lang", [-F.col("score"), -F.col("a"), "phrase"], "_place").filter(F.col("_place") < top)
    return ranked.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", (F.col("_place") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
