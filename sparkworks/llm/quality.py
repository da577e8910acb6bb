"""Quality classification by compression (operator 1).

A zstandard dictionary is built from good and another from bad labelled text.
A text is compressed with either; the difference of the two sizes, divided by
the text's own size and turned into a probability by a logistic curve, is its
score.  (Divided by the compressed sizes instead, text that repeats itself,
which any dictionary compresses to nearly nothing, would look good or bad by
its first words alone.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text is compressed in segments of so many bytes, or the text itself would teach the compressor more than the dictionary.
SEGMENT = 512
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def size_difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - with the good one) / the text's size; 0 for an empty text."""
    g = b = 0
    for a in range(0, len(text), SEGMENT):
        part = text[a : a + SEGMENT]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / len(text) if text else 0.0


def _segments(texts: list[bytes]) -> list[bytes]:
    return [t[a : a + SEGMENT] for t in texts for a in range(0, len(t), SEGMENT)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    parts = _segments(texts)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"\n".join(parts)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a weak pull of the slope to 0."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - np.array([1e-3, 0.0]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def learn_quality(df: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, dictionary_bytes: int = 65536) -> QualityModel:
    """Fit the dictionaries and the curve.

    ``per_class`` bounds the labelled rows of each class that are used: those
    with the smallest hash of their id.  Half of them build the dictionary and
    the others the curve, weighted to the classes' shares among all labels.
    ``learn`` says, by a column of ``labels``, which ids may be learned from.
    Labels other than 0 and 1, null ids and null or empty texts are ignored;
    without both classes every score is the share of ones (0.5 without labels).
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), (learn if learn is not None else F.lit(True)).alias("learn"))
    rows = rows.filter("learn and id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = rows.filter("y = 0").orderBy(*order).limit(per_class).unionByName(rows.filter("y = 1").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids.
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    found = texts.join(F.broadcast(chosen), "id").select("id", "y", F.encode("text", "UTF-8").alias("text")).collect()
    found.sort(key=lambda r: (str(r["id"]), bytes(r["text"])))
    by = {y: [bytes(r["text"]) for r in found if r["y"] == y] for y in (0, 1)}
    total = sum(share.values())
    prior = share.get(1, 0) / total if total else 0.5
    if not by[0] or not by[1]:
        return QualityModel(b"\n" * 8, b"\n" * 8, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    dictionaries = {y: _dictionary(by[y][::2], dictionary_bytes) for y in (0, 1)}
    good, bad = _compressor(dictionaries[1]), _compressor(dictionaries[0])
    rest = {y: by[y][1::2] or by[y] for y in (0, 1)}
    x = np.array([size_difference(t, good, bad) for y in (0, 1) for t in rest[y]])
    y = np.concatenate([np.full(len(rest[k]), float(k)) for k in (0, 1)])
    weight = np.where(y == 1, prior / len(rest[1]), (1 - prior) / len(rest[0])) * len(y)
    return QualityModel(dictionaries[1], dictionaries[0], *_logistic(x, y, weight))


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            x = np.array([size_difference(t.as_py() or b"", good, bad) for t in batch["text"]], np.float64)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -700, 700)))
            columns = [batch[c] for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= 0.7).astype(np.int32))], [*(c for c in batch.schema.names if c != "text"), "score", "predicted"])

    return run


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.7 on) for every row and whole text.

    Null and empty texts have the score of a size difference of 0.  Rows are
    scored one by one, so repeated rows and clashing names do no harm; an
    empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
