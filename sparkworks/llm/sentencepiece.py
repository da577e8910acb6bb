"""SentencePiece encoding and decoding with batched numpy Viterbi (operator 3).

A text becomes words that start with the blank mark (U+2581); no piece of the
vocabulary crosses into the next word.  Distinct words of equal length advance
together: the hashes of all their substrings are looked up in the sorted keys
of the pieces, and for each end position a vectorised maximum over the pieces
that end there stores a backpointer.  Very long words, which have no others of
their length to advance with, are joined by the model's definition instead.

For a unigram model the maximum is over sums of scores.  A BPE model joins
neighbours in the order of the joined pieces' scores, and the result is not
the best sum.  But a sequence of pieces is the BPE result exactly when BPE
would keep each two neighbours apart (each piece being its own result), so for
such a model the step to a piece is allowed only from a last piece that BPE
keeps apart from it; one piece remains for each end position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.textnum import chunks, mix, text_buffers
from sparkworks.llm.wordcache import KeptWords, spread

BLANK = "▁"
_CUT = "\ue000"  # stands between words while a batch is split; texts that hold it are split one by one
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|^[^{BLANK}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 60
#: BPE words of more characters are joined one by one, in time n log n.
ALONE = 256


def _model_type(proto: bytes) -> int:
    """Field 3 of field 2 of the model file: 1 unigram (the default), 2 BPE."""

    def fields(data: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
                yield tag >> 3, data[at : at + size]
                at += size

    for key, spec in fields(proto):
        if key == 2:
            return next((v for k, v in fields(spec) if k == 3), 1)
    return 1


class PieceModel:
    """The vocabulary of a model file, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_bpe = _model_type(lib.serialized_model_proto()) == 2
        n = self.size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(k) for k in range(n)]
        self.byte_ids = np.full(256, lib.unk_id(), np.int64)
        special = np.zeros(n, bool)
        for k, piece in enumerate(self.pieces):
            if lib.is_byte(k):
                self.byte_ids[int(piece[1:-1], 16)] = k
            special[k] = lib.is_byte(k) or lib.is_unknown(k) or lib.is_control(k) or lib.is_unused(k)
        self.unknown_id = lib.unk_id()
        self.has_bytes = bool((self.byte_ids != self.unknown_id).all())
        self.score = np.array([lib.get_score(k) for k in range(n)] + [0.0])
        self.score[n] = self.score[:n][~special].min() - 10  # a character without a piece
        if lib.normalize(f"  Ab　ﬁ  ") != f"{BLANK * 3}Ab　ﬁ{BLANK * 2}":
            raise ValueError("only models that leave characters alone and put a blank before the text are read")
        if any(BLANK in p.lstrip(BLANK) for p, s in zip(self.pieces, special, strict=True) if not s):
            raise ValueError("the model has pieces that cross a word's start")
        self.bytes = [bytes([int(p[1:-1], 16)]) if lib.is_byte(k) else b"" if special[k] else p.encode() for k, p in enumerate(self.pieces)]
        self.bytes[self.unknown_id] = " ⁇ ".encode()
        self.hash = np.zeros(n + 1, np.uint64)
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int64)
        for length in np.unique(self.length[:n][~special]).tolist():
            own = np.flatnonzero((self.length[:n] == length) & ~special)
            codes = np.frombuffer("".join(self.pieces[k] for k in own).encode("utf-32-le"), np.uint32).reshape(len(own), length)
            self.hash[own] = prefix_hashes(codes)[:, -1]
        self.hash[n] = 1  # no concatenation with an unknown character is a piece
        self.longest = int(self.length[:n][~special].max())
        if self.is_bpe:
            self._order(special)
        self.usable = np.flatnonzero(~special if not self.is_bpe else ~special & self.reachable)
        order = np.argsort(self.hash[self.usable])
        self.key_ids = self.usable[order]
        self.keys = self.hash[self.key_ids]
        self.power = np.ones(self.longest + 1, np.uint64)
        self.power[1:] = _BASE
        np.multiply.accumulate(self.power, out=self.power)
        self.seen = np.full(1 << 20, -1, np.int64)
        self.apart = np.zeros(1 << 20, bool)

    def _order(self, special: np.ndarray) -> None:
        """For BPE: the rank of each piece and the two it is joined from; single characters have rank -1."""
        n = self.size
        self.rank = np.full(n + 1, -1, np.int64)
        several = np.flatnonzero(~special & (self.length[:n] > 1))
        _, place = np.unique(-self.score[several], return_inverse=True)
        self.rank[several] = place
        self.ranks = self.rank.tolist()
        self.by_text = {self.pieces[k]: k for k in np.flatnonzero(~special).tolist()}
        self.left, self.right = np.full(n + 1, n, np.int64), np.full(n + 1, n, np.int64)
        self.reachable = np.ones(n, bool)
        for k in several.tolist():
            parts = self.join(self.pieces[k], stop=2)
            ids = [self.by_text.get(p, n) for p in parts]
            self.reachable[k] = len(ids) == 2 and n not in ids and self.join(self.pieces[k]) == [self.pieces[k]]
            if len(ids) == 2:
                self.left[k], self.right[k] = ids

    def join(self, word: str, stop: int = 1) -> list[str]:
        """BPE by its definition, one word: the pair of the least rank is joined first, the leftmost of equals; ends early when ``stop`` parts are left.

        Pairs wait in a heap by rank and place.  An entry whose pair has changed meanwhile is passed over, so the time is that of sorting the word.
        """
        n, get, ranks, longest = len(word), self.by_text.get, self.ranks, self.longest
        parts = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [ranks[k] << 40 | i for i in range(n - 1) if (k := get(word[i : i + 2])) is not None]
        heapify(waiting)
        left = n
        while waiting and left > stop:
            top = heappop(waiting)
            i = top & (1 << 40) - 1
            j = after[i]
            if not parts[i] or j >= n:
                continue
            both = parts[i] + parts[j]
            k = get(both)
            if k is None or ranks[k] != top >> 40:
                continue
            parts[i], parts[j] = both, ""
            left -= 1
            h, j = before[i], after[j]
            after[i] = j
            if j < n:
                before[j] = i
                if len(both) + len(parts[j]) <= longest and (k := get(both + parts[j])) is not None:
                    heappush(waiting, ranks[k] << 40 | i)
            if h >= 0 and len(parts[h]) + len(both) <= longest and (k := get(parts[h] + both)) is not None:
                heappush(waiting, ranks[k] << 40 | h)
        return [p for p in parts if p]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.key_ids[at], -1)

    def kept_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two neighbouring pieces as they are; known answers are looked up."""
        pair = first * (self.size + 1) + second
        slot = (mix(pair.astype(np.uint64)) & np.uint64(len(self.seen) - 1)).astype(np.int64)
        new = np.flatnonzero(self.seen[slot] != pair)
        out = self.apart[slot]
        if len(new):
            distinct, inverse = np.unique(pair[new], return_inverse=True)
            answer = self._kept_apart(distinct // (self.size + 1), distinct % (self.size + 1))
            out[new] = answer[inverse]
            self.seen[slot[new]], self.apart[slot[new]] = pair[new], answer[inverse]
        return out

    def _kept_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Undo the joins of both pieces, latest first; a join across their border that came earlier parts them otherwise."""
        first, second = first.copy(), second.copy()
        out = np.ones(len(first), bool)
        limit = np.full(len(first), _FAR, np.int64)
        live = np.arange(len(first))
        while len(live):
            a, b = first[live], second[live]
            length = self.length[a] + self.length[b]
            fits = length <= self.longest
            both = np.full(len(live), -1, np.int64)
            both[fits] = self.find(self.hash[a[fits]] * self.power[self.length[b[fits]]] + self.hash[b[fits]])
            joined = (both >= 0) & (self.rank[both] < limit[live])
            out[live[joined]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            undo_a = rank_a > rank_b
            first[live] = np.where(undo_a, self.right[a], a)
            second[live] = np.where(undo_a, b, np.where(rank_b >= 0, self.left[b], b))
            limit[live] = np.where(undo_a, rank_a, rank_b + 1)
            live = live[~joined & ((rank_a >= 0) | (rank_b >= 0))]
        return out

    # --- Viterbi --------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and ids per word."""
        size = np.array([len(w) for w in words], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        # Runs of blanks hold pieces of one rank, which only the definition puts in order; a very long word has none to advance with.
        odd = np.array([self.is_bpe and (len(w) > ALONE or BLANK * 2 in w) for w in words], bool)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.concatenate([[self.by_text[p]] if p in self.by_text else self._bytes(p) for p in self.join(words[k])])
        for length in np.unique(size[~odd]).tolist():
            group = np.flatnonzero((size == length) & ~odd)
            for part in np.array_split(group, max(1, len(group) * length * min(length, self.longest) // 2_000_000)):
                for k, ids in zip(part.tolist(), self._advance([words[k] for k in part], length), strict=True):
                    out[k] = ids
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        return flat.astype(np.uint32), np.array([len(x) for x in out], np.int64)

    def _bytes(self, character: str) -> np.ndarray:
        return self.byte_ids[list(character.encode("utf-8", "replace"))] if self.has_bytes else np.array([self.unknown_id])

    def _advance(self, words: list[str], length: int) -> list[np.ndarray]:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        prefix = np.zeros((n, length + 1), np.uint64)
        prefix[:, 1:] = prefix_hashes(codes)
        longest = min(length, self.longest)
        found = []  # by piece length: ids by start
        for m in range(1, longest + 1):
            ids = self.find(prefix[:, m:] - prefix[:, : length - m + 1] * self.power[m])
            found.append(ids if m > 1 else np.where(ids < 0, self.size, ids))
        last = np.full((length + 1, n), -1, np.int64)
        best = np.zeros((length + 1, n))
        for end in range(1, length + 1):
            top = np.full(n, -np.inf)
            for m in range(1, min(longest, end) + 1):
                ids = found[m - 1][:, end - m]
                rows = np.flatnonzero(ids >= 0)
                piece, before = ids[rows], last[end - m, rows]
                if self.is_bpe:
                    if end > m:
                        fine = before >= 0
                        fine[fine] = self.kept_apart(before[fine], piece[fine])
                        rows, piece = rows[fine], piece[fine]
                    last[end, rows] = piece
                else:
                    total = best[end - m, rows] + self.score[piece]
                    fine = total >= top[rows]  # of equal sums the longer piece
                    rows, piece = rows[fine], piece[fine]
                    top[rows], last[end, rows] = total[fine], piece
            best[end] = top
        place, steps = np.full(n, length), []
        while (place > 0).any():
            piece = np.where(place > 0, last[place, np.arange(n)], -1)
            steps.append(piece)
            place = place - np.where(piece >= 0, self.length[piece], 0)
        table = np.array(steps[::-1]).T.reshape(n, -1)
        rows = [r[r >= 0] for r in table]
        for k in np.flatnonzero((table == self.size).any(axis=1)).tolist():
            at, ids = 0, []
            for piece in rows[k].tolist():
                ids.append(self._bytes(words[k][at]) if piece == self.size else [piece])
                at += int(self.length[piece])
            rows[k] = np.concatenate(ids)
        return rows


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row of code points."""
    out = mix(codes.astype(np.uint64) + np.uint64(0x5EED))
    for k in range(1, codes.shape[1]):
        out[:, k] += out[:, k - 1] * _BASE
    return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and the number of words per text."""
    marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", BLANK), pc.replace_substring(texts, " ", BLANK), "")
    if pc.any(pc.match_substring(texts, _CUT)).as_py():
        lists = [_WORD.findall(x) for x in marked.to_pylist()]
        return pa.array([w for x in lists for w in x], pa.string()), np.array([len(x) for x in lists], np.int64)
    words = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{BLANK}]){BLANK}", f"\\1{_CUT}{BLANK}"), _CUT)
    return words.flatten(), np.diff(words.offsets.to_numpy(zero_copy_only=False))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = KeptWords(piece_model(path).encode_words)
        for batch in batches:
            _, offsets = text_buffers(batch["text"])
            for a, b in chunks(offsets, 4 << 20):
                words, per_text = split_words(batch["text"].slice(a, b - a).fill_null("").cast(pa.string()))
                coded = pc.dictionary_encode(words)
                flat, start, size = vocabulary(coded.dictionary.to_pylist())
                ids, counts = spread(flat, start, size, coded.indices.to_numpy(zero_copy_only=False), per_text)
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), lists], ["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(path).bytes
        mark = BLANK.encode()
        for batch in batches:
            texts, sums = [], []
            for x in batch["ids"]:
                ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x.values) else np.zeros(0, np.int32)
                text = b"".join([pieces[k] for k in ids.tolist()]).replace(mark, b" ")
                texts.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace") if x.is_valid else None)
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            columns = [batch[c] for c in batch.schema.names if c != "ids"]
            size = pc.fill_null(pc.list_value_length(batch["ids"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, size, pa.array(sums, pa.int64()), pa.array(texts, pa.string())], [*(c for c in batch.schema.names if c != "ids"), "n_ids", "ids_crc32", "text"])

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the model's own library gives them.

    Null and empty texts have no ids.  Rows are encoded one by one, so
    repeated rows and clashing names do no harm; an empty table gives no rows.
    ``path`` is a model file that every executor can read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(path), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", "doc_id")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids) and text.

    The blank before the text goes, bytes that are no UTF-8 become U+FFFD, and
    the blank mark becomes a blank; null ids give a null text.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_decode(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, text string")
