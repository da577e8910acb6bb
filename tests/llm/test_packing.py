import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkworks.llm.packing import WordIds, pack_documents, pack_histogram, slots

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_sequences(odd, odd_rows, none):
    library = Tokenizer.from_file(PATH)
    got = pack_documents(odd, PATH, limit=256).collect()
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 256):
            own = ids[a : a + 256]
            want[(i, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert sorted(by) == list(range(len(by)))
    assert pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_histogram(seed):
    rng = np.random.default_rng(seed)
    counts = dict(Counter(rng.integers(1, 101, 2000).tolist()))
    patterns = pack_histogram(counts, 100)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 100
        for length in pattern:
            used[length] += times
    assert used == counts and sum(t for _, t in patterns) <= 1.05 * np.ceil(sum(k * v for k, v in counts.items()) / 100)
    for length, (ranks, sequences, offsets) in slots(patterns).items():
        assert ranks[0] == 0 and len(ranks) == len(sequences) == len(offsets) and (np.diff(ranks) > 0).all() and ranks[-1] < counts[length]


def test_words_as_the_library(odd_rows):
    import pyarrow as pa

    library, own = Tokenizer.from_file(PATH), WordIds(PATH)
    texts = [r[1] or "" for r in odd_rows] + ["a<|endoftext|>b <|startoftext|> x.", "It's we'll 12, 3.5! É. Á. x́, ... $$, <|ENDOFTEXT|>. |> <|x", "ß. ǅ, İ. ﬁ. 中文。, <. end<|endoftext|>, '."]
    for _ in range(2):  # the second time from memory
        ids, size = own(pa.array(texts))
        for text, got in zip(texts, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_two_megabytes_are_encoded_at_once(monkeypatch):
    """Each chunk encodes its distinct words again once the table of kept ones is full, so chunks are not to be small."""
    import pyarrow as pa

    from sparkworks.llm import packing

    calls, encode = [], packing.WordIds.__call__
    monkeypatch.setattr(packing.WordIds, "__call__", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)})))
    texts = [f"word{k} more. " * 2500 for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    run = packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 1, 2048, pa.int64())
    got = [r for out in run(iter([batch])) for r in out.to_pylist()]
    assert calls == [60] and {r["doc_id"] for r in got} == set(range(60))
