"""Exact largest inner products by norm order and rotated partial sums (operator 13).

Vectors become integers; their inner products are integers and exact.

Order.  All vectors are dealt into blocks by descending length.  A query meets
the block of the longest vectors first, and its k-th best score from there is
a threshold.  By Cauchy and Schwarz no vector shorter than threshold / |query|
reaches it, so blocks of shorter ones are not joined to the query at all.
Queries are blocked by that quotient, and a block of queries meets a block of
vectors in one task.

Bounds.  Inside a pair of blocks the vectors come in order of length, a slice
at a time, and the search ends for a query when no later one is long enough.
All are rotated to the principal axes of a bounded sample (a rotation leaves
products as they are), so the first coordinates hold most of them: their
partial sum and the product of the lengths of what is left bound the score
from above.  Pairs whose bound reaches the threshold are computed in integers.
The rotation decides how much is pruned and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkworks.llm.common import settle, tidy
from sparkworks.operators.ranges import with_position

#: Relative allowance for rounding in bounds; theirs is some 1e-13.
SLACK = 1e-9
#: Products of lengths up to here leave every partial sum exact in doubles.
EXACT = float(1 << 53)
#: Numbers in the sample that the rotation is fitted on, and vectors in it at most.
SAMPLE_NUMBERS, SAMPLE = 1 << 21, 8192


def _emit_integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            size = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            start = np.cumsum(size) - size
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            dim, norm, ints = np.zeros(len(size), np.int32), np.zeros(len(size)), [b""] * len(size)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                x = flat[start[at][:, None] + np.arange(d)]
                at, x = at[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if (np.abs(x) >= 2.0**62).any():
                    raise OverflowError("a component is too large: scores would not fit in 64 bits")
                dim[at], norm[at] = d, np.sqrt((x * x).sum(axis=1))
                for k, row in zip(at.tolist(), x.astype(np.int64), strict=True):
                    ints[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch["id"], batch["asks"], pa.array(dim), pa.array(norm), pa.array(ints, pa.binary())], ["id", "asks", "dim", "norm", "ints"])

    return tidy(run)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def fit_rotation(rows: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """{dimension: (axes as columns, how many of them to sum first)} of a sample of at most SAMPLE_NUMBERS numbers.

    Dimensions that the sample lacks are not rotated.
    """
    widest = rows.agg(F.max("dim")).first()[0] or 1
    sample = rows.select("dim", "ints").orderBy(F.xxhash64("uid"), "uid").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // widest))).toArrow()
    out = {}
    dims = sample["dim"].to_numpy()
    for d in np.unique(dims).tolist():
        x = _matrix(sample["ints"].filter(pa.array(dims == d)), d).astype(np.float64)
        x = x / max(1.0, np.abs(x).max())
        value, axes = np.linalg.eigh(x.T @ x)
        share = np.cumsum(value[::-1]) / max(value.sum(), 1e-300)
        out[d] = np.ascontiguousarray(axes[:, ::-1]), int(min(max(1, np.searchsorted(share, 0.9) + 1), d))
    return out


def best_products(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int, floor: np.ndarray, rotation, piece: int = 1024, counts: dict | None = None):
    """(query, candidate, score) of the k best candidates of each query, no worse than its ``floor``.

    ``own`` and ``uid`` name the rows: a query is not its own candidate.
    ``counts`` gets the numbers of pairs met and computed.
    """
    nq, nc = len(q), len(c)
    q_norm, c_norm = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (q, c))
    most = float(q_norm.max(initial=0.0) * c_norm.max(initial=0.0))
    if most >= 2.0**63:
        raise OverflowError("a score does not fit in 64 bits")
    kind = np.float64 if most < EXACT else np.int64
    axes, head = rotation if rotation is not None else (None, q.shape[1])
    order = np.lexsort((uid, ids, -c_norm))
    q_all, c_all = q.astype(kind), c.astype(kind)
    q_turned = q.astype(np.float64) @ axes if axes is not None else q.astype(np.float64)
    q_rest = np.sqrt((q_turned[:, head:] ** 2).sum(axis=1))
    best_score = np.full((nq, k), np.iinfo(np.int64).min)
    best_at = np.full((nq, k), -1)
    bar = floor.astype(np.float64).copy()
    for a in range(0, nc, piece):
        at = order[a : a + piece]
        live = np.flatnonzero(q_norm * c_norm[at[0]] * (1 + SLACK) >= bar)
        if not len(live):
            break
        turned = c[at].astype(np.float64) @ axes if axes is not None else c[at].astype(np.float64)
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        bound = q_turned[live, :head] @ turned[:, :head].T + np.outer(q_rest[live], rest) + SLACK * np.outer(q_norm[live], c_norm[at])
        hit = (bound >= bar[live][:, None]) & (own[live][:, None] != uid[at][None, :])
        i, j = np.nonzero(hit)
        if counts is not None:
            counts["met"] = counts.get("met", 0) + hit.size
            counts["computed"] = counts.get("computed", 0) + len(i)
        if not len(i):
            continue
        if 8 * len(i) > hit.size:  # most survive: one product of matrices
            score = (q_all[live] @ c_all[at].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q_all[live[i[b : b + 65536]]], c_all[at[j[b : b + 65536]]]) for b in range(0, len(i), 65536)])
        score = score.astype(np.int64)
        good = score >= bar[live[i]]
        i, j, score = live[i[good]], at[j[good]], score[good]
        touched = np.unique(i)
        old_q, old_k = np.nonzero(best_at[touched] >= 0)
        all_q = np.concatenate((touched[old_q], i))
        all_at = np.concatenate((best_at[touched][old_q, old_k], j))
        all_score = np.concatenate((best_score[touched][old_q, old_k], score))
        place = np.lexsort((uid[all_at], ids[all_at], -all_score, all_q))
        all_q, all_at, all_score = all_q[place], all_at[place], all_score[place]
        first = np.flatnonzero(np.concatenate(([True], all_q[1:] != all_q[:-1]))) if len(all_q) else np.zeros(0, np.int64)
        rank = np.arange(len(all_q)) - np.repeat(first, np.diff(np.append(first, len(all_q))))
        all_q, all_at, all_score, rank = (x[rank < k] for x in (all_q, all_at, all_score, rank))
        best_at[all_q, rank], best_score[all_q, rank] = all_at, all_score
        full = touched[best_at[touched, k - 1] >= 0]
        bar[full] = np.maximum(bar[full], best_score[full, k - 1])
    i, j = np.nonzero(best_at >= 0)
    return i, best_at[i, j], best_score[i, j]


def _search(k: int, rotations):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        names = {"query": pa.int64(), "vec_id": pa.int64(), "uid": pa.int64(), "score": pa.int64()}
        for d in np.intersect1d(left["dim"].to_numpy(), right["dim"].to_numpy()).tolist() if left.num_rows and right.num_rows else []:
            asks = left.filter(pa.array(left["dim"].to_numpy() == d))
            rows = right.filter(pa.array(right["dim"].to_numpy() == d))
            ids, uid = rows["id"].to_numpy(), rows["uid"].to_numpy()
            i, j, score = best_products(_matrix(asks["ints"], d), _matrix(rows["ints"], d), asks["uid"].to_numpy(), ids, uid, k, asks["floor"].to_numpy(), rotations.value.get(d))
            for part, x in zip(out, (asks["uid"].to_numpy()[i], ids[j], uid[j], score), strict=True):
                part.append(x)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), t) for (n, t), x in zip(names.items(), out, strict=True)})

    return run


def top_products(df: DataFrame, asks: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, asks_block: int = 1024) -> DataFrame:
    """The k largest inner products of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x), scores are exact integers, ties go to
    the smaller vec_id.  Rows for which ``asks`` holds are the queries; every
    other row of the same dimension is a candidate, and a query with fewer
    than k gets all of them.  Vectors that are null, empty or hold null or
    non-finite components, and rows without an id, take no part.  Rows that
    repeat an id are rows of their own: each is a candidate, and each asks.  Scores
    beyond 64 bits raise an OverflowError.  An empty table gives no rows; other
    columns are ignored.
    """
    session = df.sparkSession
    plain = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = plain.mapInArrow(_emit_integers(scale), "id long, asks boolean, dim int, norm double, ints binary").filter("dim > 0")
    rows = settle(rows.withColumn("uid", F.monotonically_increasing_id()))
    rotations = session.sparkContext.broadcast(fit_rotation(rows))
    # Blocks of one size by descending length; equal lengths are dealt by row.
    placed = with_position(rows, ["norm", "uid"], "_at", ascending=[False, True])
    blocks = settle(placed.withColumn("block", F.floor(F.col("_at") / block).cast("int")))
    lengths = settle(blocks.groupBy("dim", "block").agg(F.max("norm").alias("longest")))
    last = lengths.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    queries = settle(rows.filter("asks"))
    groups = max(1, math.ceil(queries.count() / asks_block))
    candidates = blocks.select("block", "id", "uid", "dim", "ints")
    search = _search(k, rotations)
    none = F.lit(-float("inf"))

    def met(sought: DataFrame, pairs: DataFrame) -> DataFrame:
        """What blocks of queries find in the blocks of vectors that ``pairs`` (ask, block) names."""
        left, right = sought.join(pairs, "ask"), candidates.join(pairs.toDF("ask", "block"), "block").toDF("block", "id", "uid", "dim", "ints", "ask")
        return settle(left.groupBy("ask", "block").cogroup(right.groupBy("ask", "block")).applyInArrow(search, "query long, vec_id long, uid long, score long"))

    opening = queries.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("ask"), "uid", "dim", "ints", none.alias("floor"))
    begun = met(opening, session.range(groups).select(F.col("id").cast("int").alias("ask"), F.lit(0).alias("block")))
    bars = begun.groupBy(F.col("query").alias("uid")).agg(F.count("*").alias("m"), F.min("score").alias("low"))
    judged = queries.join(bars, "uid", "left").withColumn("floor", F.when(F.col("m") >= k, F.col("low").cast("double")).otherwise(none))
    # A vector can reach the floor from this length on.
    judged = judged.withColumn("reach", F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(none))
    judged = settle(judged.select("uid", "dim", "ints", "floor", "reach"))
    judged = settle(with_position(judged, ["reach", "uid"], "_at").withColumn("ask", F.floor(F.col("_at") / asks_block).cast("int")).drop("_at"))
    need = judged.groupBy("ask", "dim").agg(F.min("reach").alias("reach"))
    pairs = need.select("ask", "dim", "reach", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("block")) if last else need.select("ask", "dim", "reach", F.lit(0).alias("block")).limit(0)
    pairs = settle(pairs.join(lengths, ["dim", "block"]).filter(F.col("longest") * (1 + SLACK) >= F.col("reach")).select("ask", "block").distinct())
    found = begun.unionByName(met(judged.select("ask", "uid", "dim", "ints", "floor"), pairs))
    order = F.desc("score"), F.col("vec_id"), F.col("uid")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("uid").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")

