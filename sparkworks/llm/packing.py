"""Sequence packing: shortest-pack-first over the length histogram (operator 8)."""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkworks.llm.common import settle, tidy
from sparkworks.llm.textnum import chunks, text_buffers
from sparkworks.llm.wordcache import KeptWords, spread

#: Bytes of text that are tokenised at once.
CHUNK = 2 << 20
#: Stems to a call of the tokenizer, which keeps an object for every id of a call.
CALL = 10_000
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, own long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    # Spark runs a task to a core; threads of the tokenizer's own would each keep memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word's closing punctuation after a letter or digit: the tokenizer files in use split there.
_TAIL = "^(?P<core>.*[a-zA-Z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])(?P<tail>[.,!#$%&*;:?]+)$"
_SEPARATOR = "<|endoftext|>"
#: The only splitting of texts for which words and their closing punctuation can be encoded apart.
_SPLITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def check_tokenizer(encoder) -> int:
    """The separator's id; raises where the file splits texts in another way than ``WordIds`` takes for granted."""
    plan = json.loads(encoder.to_str())
    before = plan.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    split = steps[0] if steps else {}
    normal = plan.get("normalizer") or {}
    normalizers = {x.get("type") for x in normal.get("normalizers", [normal])}
    if split.get("type") != "Split" or split.get("pattern") != {"Regex": _SPLITS} or not split.get("invert") or split.get("behavior") != "Removed":
        raise ValueError("the tokenizer does not split words as the packing operator needs it")
    if any(x.get("type") != "ByteLevel" or x.get("use_regex") or x.get("add_prefix_space") for x in steps[1:]) or not normalizers <= {"NFC", "Replace", "Lowercase"}:
        raise ValueError("the tokenizer changes texts in ways that the packing operator does not know")
    separator = encoder.token_to_id(_SEPARATOR)
    if separator is None or len(encoder.encode(f"a {_SEPARATOR}", add_special_tokens=False).ids) != 2:
        raise ValueError(f"the tokenizer has no special token {_SEPARATOR}")
    return separator


class WordIds:
    """Token ids of texts by their distinct words.

    The tokenizer files in use never join what ASCII white space separates,
    nor a letter or digit with the punctuation after it, so a text's ids are
    those of its words' stems and closing punctuation in order.  Each distinct
    stem of a batch is encoded once, many to a call, with a special token
    between them; words that hold special tokens themselves are encoded alone.
    """

    def __init__(self, path: str):
        self.encoder = tokenizer(path)
        self.separator = check_tokenizer(self.encoder)
        self.vocabulary = KeptWords(self._encode)

    def _encode(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stems, one after the other, and the number of ids of each."""
        size = np.zeros(len(stems), np.int64)
        plain = [k for k, w in enumerate(stems) if "<|" not in w]
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(stems) if len(plain) < len(stems) else []
        pieces = []
        for a in range(0, len(plain), CALL):
            own = plain[a : a + CALL]
            texts = [f" {_SEPARATOR} ".join([stems[k] for k in own[c : c + 500]]) + f" {_SEPARATOR}" for c in range(0, len(own), 500)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.separator)
            size[own] = np.diff(np.concatenate(([-1], ends))) - 1
            pieces.append(ids[ids != self.separator])
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        if parts:  # rare: put the words with special tokens between the others
            for k, own in zip(plain, np.split(flat, np.cumsum(size[plain])[:-1]), strict=True) if plain else ():
                parts[k] = own
            for k in set(range(len(stems))) - set(plain):
                parts[k] = np.array(self.encoder.encode(stems[k], add_special_tokens=False).ids, np.uint32)
                size[k] = len(parts[k])
            flat = np.concatenate(parts)
        return flat, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the number of ids per text."""
        words = pc.ascii_split_whitespace(texts)
        per_text = np.diff(words.offsets.to_numpy(zero_copy_only=False))
        coded = pc.dictionary_encode(words.flatten())
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        split = pc.extract_regex(distinct, _TAIL)
        whole = pc.is_null(split)
        core = pc.if_else(whole, distinct, pc.struct_field(split, "core"))
        tail = pc.if_else(whole, "", pc.struct_field(split, "tail"))
        stems = pc.dictionary_encode(pa.concat_arrays([core.cast(pa.string()), tail.cast(pa.string())]))
        which = stems.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
        flat, start, size = self.vocabulary(stems.dictionary.to_pylist())
        # Two stems a word; an empty one has no ids.
        stem = which.T[codes].ravel() if len(codes) else np.zeros(0, np.int64)
        return spread(flat, start, size, stem, 2 * per_text)


def cut(tokens: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then the rest."""
    return [(a, min(limit, tokens - a)) for a in range(0, tokens, limit)]


def _pieces(path: str, end_id: int, limit: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(path)
        tail = np.array([end_id], np.uint32)
        part = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            _, offsets = text_buffers(batch["text"])
            for a, b in chunks(offsets, CHUNK):
                texts = batch["text"].slice(a, b - a).fill_null("")
                ids, sizes = encode(texts)
                out: list[list] = [[], [], [], [], [], []]
                at = 0
                for k, n in enumerate(sizes.tolist()):
                    own = np.concatenate((ids[at : at + n], tail))
                    at += n
                    for start, length in cut(n + 1, limit):
                        row = (k, start, length, zlib.crc32(own[start : start + length].astype("<u4").tobytes()), n + 1, seen[length])
                        seen[length] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                taken = batch["doc_id"].slice(a, b - a).take(pa.array(out[0], pa.int64())).cast(id_type)
                start, length, crc, whole, rank = (pa.array(c, pa.int64()) for c in out[1:])
                yield pa.RecordBatch.from_arrays([taken, start, length, crc, whole, pa.array(np.full(len(taken), part, np.int32)), rank], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "own"])

    return tidy(run)


def token_pieces(df: DataFrame, path: str, end_id: int = 1, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts (null: empty), append ``end_id`` and cut into pieces of at most ``limit`` ids.

    ``part`` is the task that made a piece and ``own`` its rank among the
    pieces of its length there.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    if kind.simpleString() not in ("string", "bigint"):
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_pieces(path, end_id, limit, id_type), PIECES.format(id="string" if id_type == pa.string() else "long"))


def pack_histogram(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for a histogram of lengths.

    Lengths are placed longest first, each into the shortest pack that still
    holds it, the one with the most room left; a new pack is opened only where
    no open one holds the length.  Only counts of equal packs are kept, so the
    work depends on the number of distinct lengths and not on the number of
    pieces.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [[pattern, count]]
    done: Counter = Counter()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(limit, length - 1, -1) if open_packs.get(r)), None)
            if room is None:
                times = left
                pattern: tuple[int, ...] = ()
                room = limit
            else:
                packs = open_packs[room]
                pattern, have = packs[-1]
                times = min(left, have)
                if times == have:
                    packs.pop()
                else:
                    packs[-1][1] -= times
            left -= times
            grown, rest = (*pattern, length), room - length
            if rest:
                packs = open_packs[rest]
                packs.append([grown, times])
            else:
                done[grown] += times
    for packs in open_packs.values():
        for pattern, times in packs:
            done[pattern] += times
    return sorted(done.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequences, sequence steps and offsets of its runs of slots.

    The pieces of a length are ranked from 0; a run of ranks fills the same
    place of consecutive sequences that follow one pattern.
    """
    out: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def _place(places: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                ranks, sequences, offsets = places[int(length[own[0]])]
                k = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own] = sequences[k] + rank[own] - ranks[k]
                offset[own] = offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Assign every piece its sequence and its offset there.

    The histogram has at most ``limit`` rows and is all that the driver sees.
    A piece's rank among those of its length is its rank within the task that
    made it plus what earlier tasks made of that length, so no pieces are
    sorted, and a length that most pieces have is spread over the tasks that
    made them.  Pieces are settled first: their ranks are then fixed.
    """
    pieces = settle(pieces)
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    cells = settle(cells.select("length", "part", "n", F.coalesce("before", F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(pack_histogram(counts, limit))
    ranked = pieces.join(cells.drop("n"), ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("own") + F.col("before")).cast("long").alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_place(places), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, end_id: int = 1, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` token ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A document is cut only where it is longer than a
    sequence.  A null or empty text is one piece that holds the end id alone;
    rows with a null or repeated id are packed like all others; an empty table
    gives no rows.  Other columns are ignored.  A tokenizer file that splits texts
    in another way than this operator takes for granted raises a ValueError.
    """
    return pack(token_pieces(df, path, end_id, limit, id_col, text_col), limit)
