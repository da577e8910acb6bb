import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from sparkworks.llm import sentencepiece as s
from sparkworks.llm.wordcache import KeptWords, spread

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_as_the_library_and_back(odd, odd_rows, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sorted((tuple(r) for r in s.decode(s.encode(odd, PATH), PATH).collect()), key=repr)
    want = [(i, library.encode(t or ""), t) for i, t, *_ in odd_rows]
    assert got == sorted(((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), t or "") for i, ids, t in want), key=repr)
    assert s.decode(s.encode(none, PATH), PATH).count() == 0


def test_strange_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = KeptWords(s.piece_model(PATH).encode_words)
    for texts in (["", " ", " a", "a  b   c", "😀🏽 x\u0007\t\n", "    def f(x):\n        return  x", "x" * 300, "中文字符 テスト"], [" a", "a▁b ▁▁ c", " x  y"]):
        words, per_text = s.split_words(pa.array(texts))
        ids, size = spread(*vocabulary(words.to_pylist()), np.arange(len(words)), per_text)
        for text, own in zip(texts, np.split(ids, np.cumsum(size)[:-1]), strict=True):
            assert own.tolist() == library.encode(text), text


def test_unigram_maxima(tmp_path):
    """The same pieces as a unigram model: the sum of scores is the library's."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0) / 1000 - 1
    (tmp_path / "u.model").write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    model = s.PieceModel(str(tmp_path / "u.model"))
    assert not model.is_bpe
    texts = ["the quick brown foxes jumped", "unbelievable intercontinental", "ésta canción", "aaaaaaaaaaaa bbbb"]
    for text in texts:
        words = s.split_words(pa.array([text]))[0].to_pylist()
        ids = model.encode_words(words)[0].tolist()
        score = lambda x: sum(model.score[k] for k in x)
        assert abs(score(ids) - score(library.encode(text))) < 1e-3
        assert "".join(model.pieces[k] for k in ids) == s.BLANK + text.replace(" ", s.BLANK)


def test_hostile_texts():
    """Runs of blanks and words of a MB take seconds, and are what the library makes of them."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = s.piece_model(PATH)
    rng = random.Random(7)
    letters = "".join(rng.choice("etaoinshrdlucm") for _ in range(1_000_000))
    for text in (" " * 100_000, "x" + " " * 30_000 + "y" + " " * 70_001, letters, "ab" * 500_000, "中é" * 50_000, "😀" * 20_000):
        began = time.perf_counter()
        words, _ = s.split_words(pa.array([text]))
        ids = model.encode_words(words.to_pylist())[0]
        took = time.perf_counter() - began
        assert ids.tolist() == library.encode(text)
        assert took < 15, (text[:5], took)  # 5 on an idle machine


def test_both_ways_of_long_words_agree(monkeypatch):
    rng = random.Random(8)
    words = [s.BLANK + "".join(rng.choice("etaoinshrdluBPE0é") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    model = s.piece_model(PATH)
    want = [x.tolist() for x in model.encode_words(words)]
    for alone in (0, 10_000):
        monkeypatch.setattr(s, "ALONE", alone)
        assert [x.tolist() for x in model.encode_words(words)] == want
