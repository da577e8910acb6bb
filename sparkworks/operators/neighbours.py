"""Nearest vectors: exact search and an inverted index of coarse cells.

Exact search sends the queries to the points.  They are packed once, and
broadcast after a look at their size; a task reads its points in batches and
keeps the k best of each query, so every point is read once and a task emits
k rows a query.  Queries beyond that size meet the points in blocks.

The index deals points to the nearest of some centres, and a query looks into
the cells of its nearest centres alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkworks.operators.ranges import settle, shared_folder, with_position

#: Bytes of queries and of their best points that a task may hold.
QUERY_BYTES = 64 << 20
#: Points and queries that are compared at once.
POINTS, QUERIES = 1024, 2048
#: Vectors that the centres of an index are fitted on, and numbers in them, at most.
SAMPLE, SAMPLE_NUMBERS = 40_000, 1 << 23


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers as they are, texts as numpy's texts, whose order is that of their code points."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension; those that are empty or hold nulls are left out."""
    size = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
    start = np.cumsum(size) - size
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        x = flat[start[at][:, None] + np.arange(d)]
        good = ~np.isnan(x).any(axis=1)
        yield at[good], x[good]


class Nearest:
    """The k nearest points of each of some queries of one dimension, equally near ones in order of their key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.square = (queries * queries).sum(axis=1)
        self.distance = np.full((len(queries), k), np.inf)
        self.key: np.ndarray | None = None

    def add(self, keys: np.ndarray, points: np.ndarray) -> None:
        for a in range(0, len(points), POINTS):
            for b in range(0, len(self.queries), QUERIES):
                self._add(keys[a : a + POINTS], points[a : a + POINTS], b, b + QUERIES)

    def _add(self, keys: np.ndarray, points: np.ndarray, first: int, last: int) -> None:
        """A product of matrices gives distances up to rounding; those that may be among the k least are computed anew."""
        q = self.queries[first:last]
        square = (points * points).sum(axis=1)
        near = self.square[first:last, None] + square - 2 * (q @ points.T)
        slack = 1e-9 * (self.square[first:last] + square.max()) + 1e-300
        bar = self.distance[first:last, -1] ** 2
        if len(points) > self.k:
            bar = np.minimum(bar, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        i, j = np.nonzero(near <= (bar + 2 * slack)[:, None])
        if not len(i):
            return
        exact = np.concatenate([np.sqrt(((points[j[c : c + 65536]] - q[i[c : c + 65536]]) ** 2).sum(axis=1)) for c in range(0, len(i), 65536)])
        i = i + first
        touched = np.unique(i)
        held_q, held_k = np.nonzero(np.isfinite(self.distance[touched]))
        if self.key is None:
            self.key = np.zeros(self.distance.shape, keys.dtype)
        elif self.key.dtype.kind == "U" and keys.dtype.itemsize > self.key.dtype.itemsize:
            self.key = self.key.astype(keys.dtype)
        who = np.concatenate((touched[held_q], i))
        what = np.concatenate((self.key[touched][held_q, held_k], keys[j]))
        far = np.concatenate((self.distance[touched][held_q, held_k], exact))
        order = np.lexsort((what, far, who))
        who, what, far = who[order], what[order], far[order]
        begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        keep = rank < self.k
        self.distance[who[keep], rank[keep]], self.key[who[keep], rank[keep]] = far[keep], what[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point key, distance)"""
        if self.key is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, r = np.nonzero(np.isfinite(self.distance))
        return i, self.key[i, r], self.distance[i, r]


def _rows(queries: pa.Table, points: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(q, p, distance) of the k nearest among the points of one task."""
    names = queries["q"].combine_chunks() if isinstance(queries["q"], pa.ChunkedArray) else queries["q"]
    sought = {x.shape[1]: (at, Nearest(x, k)) for at, x in _matrices(queries["v"].combine_chunks() if isinstance(queries["v"], pa.ChunkedArray) else queries["v"])}
    for batch in points:
        keys = _keys(batch["p"])
        for at, x in _matrices(batch["v"]):
            if x.shape[1] in sought:
                sought[x.shape[1]][1].add(keys[at], x)
    for at, nearest in sought.values():
        i, key, distance = nearest.found()
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[i[part]])), pa.array(key[part].tolist() if key.dtype.kind == "U" else key[part]).cast(kind), pa.array(distance[part])], ["q", "p", "distance"])


def _ranked(near: DataFrame, k: int, query_key: str, point_key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "p"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(f"query_{query_key}"), F.col("p").alias(point_key), "distance", "rank")


def knn_join(queries: DataFrame, points: DataFrame, k: int, query_key: str, point_key: str, vector: str, limit: int = QUERY_BYTES) -> DataFrame:
    """The k nearest points of every query by Euclidean distance: query key, point key, distance, rank.

    Work is queries times points, by definition of the exact search; ties go
    to the smaller key.  Vectors that are null, empty or hold nulls are not
    near anything, and only vectors of one dimension are compared.  Queries
    that with their k best take more than ``limit`` bytes are not broadcast:
    they and the points meet in blocks of bounded size.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    held = points.select(F.col(point_key).alias("p"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    types = asked.schema["q"].dataType.simpleString(), held.schema["p"].dataType.simpleString()
    schema = f"q {types[0]}, p {types[1]}, distance double"
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    if 8 * numbers + 16 * k * n > limit:
        return _ranked(_in_blocks(asked, held, k, schema, max(1, limit * n // (8 * numbers + 16 * k * n))), k, query_key, point_key)
    kind = held.limit(0).toArrow().schema.field("p").type
    packed = asked.sparkSession.sparkContext.broadcast(asked.toArrow())
    near = held.mapInArrow(lambda batches: _rows(packed.value, batches, k, kind), schema)
    return _ranked(near, k, query_key, point_key)


def _in_blocks(asked: DataFrame, held: DataFrame, k: int, schema: str, per_block: int, points: int = 1 << 16) -> DataFrame:
    """Every block of queries beside every block of points, a pair of them in a task; a block's rows are bounded."""
    kind = held.limit(0).toArrow().schema.field("p").type
    per_block = min(per_block, 1 << 14)
    rows = settle(with_position(asked, ["q"], "_at").select("q", "v", F.floor(F.col("_at") / per_block).cast("int").alias("a")))
    blocks = max(1, math.ceil(rows.count() / per_block))
    parts = max(1, math.ceil(held.count() / points))
    left = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = held.withColumn("b", F.pmod(F.xxhash64("p"), F.lit(parts)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def near(q: pa.Table, p: pa.Table) -> pa.Table:
        found = list(_rows(q, iter(p.combine_chunks().to_batches()), k, kind)) if q.num_rows and p.num_rows else []
        return pa.Table.from_batches(found) if found else pa.table({"q": q["q"].slice(0, 0), "p": p["p"].slice(0, 0), "distance": pa.array([], pa.float64())})

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(near, schema)


def similarity_search(points: DataFrame, queries: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return knn_join(queries, points, k, key, key, vector)


# --- inverted index -----------------------------------------------------------


def fit_centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """n centres of a sample by Lloyd's rounds; a centre without vectors takes the one farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own, distance = nearest_centres(sample, centres, 1)
        own, distance = own[:, 0], distance[:, 0]
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = sample[np.argsort(-distance, kind="stable")[: len(empty)]]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, squared distances) of the n nearest centres of each vector, nearest first."""
    n = min(n, len(centres))
    square = (centres * centres).sum(axis=1)
    at, far = np.empty((len(x), n), np.int32), np.empty((len(x), n))
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        d = (part * part).sum(axis=1)[:, None] + square - 2 * part @ centres.T
        best = np.argsort(d, axis=1, kind="stable")[:, :n]
        at[a : a + 4096], far[a : a + 4096] = best, np.take_along_axis(d, best, axis=1)
    return at, far


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, k: int = 4, queries: int = 512) -> int:
    """How many cells hold ``recall`` of the k nearest of a sample's first vectors within the sample, themselves left out."""
    asked = sample[:queries]
    if len(sample) <= k:
        return len(centres)
    own = nearest_centres(sample, centres, 1)[0][:, 0]
    turn = np.argsort(nearest_centres(asked, centres, len(centres))[0], axis=1)  # when each centre's turn comes
    square = (sample * sample).sum(axis=1)
    later = []
    for a in range(0, len(asked), 64):
        far = square - 2 * asked[a : a + 64] @ sample.T
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        later.append(np.take_along_axis(turn[a : a + 64], own[near], axis=1))
    return int(np.quantile(np.concatenate(later), recall, method="higher")) + 1


@dataclass
class VectorIndex:
    """Centres, the table (cell, p, v) of all vectors that can be found, and how many cells a search looks into by default."""

    centres: np.ndarray
    cells: DataFrame
    probes: int

    def save(self, path: str) -> None:
        spark = self.cells.sparkSession
        # By ranges of cell and key, so that a cell with most points is dealt to many tasks.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.cells.repartitionByRange(parts, "cell", F.xxhash64("p")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        spark.createDataFrame([(self.probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VectorIndex":
        centres = sorted(map(tuple, spark.read.parquet(f"{path}/centres").collect()))
        return VectorIndex(np.array([c for _, c in centres], np.float64), spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/probes").first()[0])

    def search(self, queries: DataFrame, k: int, key: str, vector: str, point_key: str, probes: int | None = None, block: int = 1 << 13) -> DataFrame:
        """The k nearest points in the cells of each query's ``probes`` nearest centres (as many as the index was tuned to): as ``knn_join``, but nearer points in other cells are missed.

        A cell of many points is split into blocks, each of which the cell's queries visit, and queries of one cell are split likewise.
        """
        types = queries.schema[key].dataType.simpleString(), self.cells.schema["p"].dataType.simpleString()
        kind = self.cells.limit(0).toArrow().schema.field("p").type
        centres = self.cells.sparkSession.sparkContext.broadcast(self.centres)
        asked = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
        visits = settle(asked.mapInArrow(_emit_cells(centres, probes or self.probes, "q"), f"cell int, q {types[0]}, v array<double>"))
        deal = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = deal(self.cells.select("cell"), "parts").join(deal(visits.select("cell"), "turns"), "cell")
        sizes = settle(sizes)  # a row a cell
        left = visits.join(F.broadcast(sizes), "cell").withColumn("a", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "a", "b", "q", "v")
        right = self.cells.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("cell", "a", "b", "p", "v")

        def near(q: pa.Table, p: pa.Table) -> pa.Table:
            found = list(_rows(q, iter(p.combine_chunks().to_batches()), k, kind)) if q.num_rows and p.num_rows else []
            return pa.Table.from_batches(found) if found else pa.table({"q": q["q"].slice(0, 0), "p": p["p"].slice(0, 0), "distance": pa.array([], pa.float64())})

        found = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(near, f"q {types[0]}, p {types[1]}, distance double")
        return _ranked(found, k, key, point_key)


def _emit_cells(centres, n: int, name: str):
    """Each vector once for each of its n nearest centres; vectors of another dimension have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch["v"]):
                if x.shape[1] == centres.value.shape[1]:
                    cell, _ = nearest_centres(x, centres.value, n)
                    where = pa.array(np.repeat(at, cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), batch[name].take(where), batch["v"].take(where)], ["cell", name, "v"])

    return run


def build_index(points: DataFrame, key: str, vector: str, cells: int | None = None, most: int = 4096, path: str | None = None, recall: float = 0.95) -> VectorIndex:
    """An index of all vectors of the commonest dimension; others cannot be found.

    Centres, about the root of the row count and ``most`` at most, are fitted
    on a sample of at most SAMPLE vectors and SAMPLE_NUMBERS numbers, those
    whose key has the least hash; every vector is then dealt to its nearest.
    The same sample tells how many cells hold ``recall`` of its vectors' four
    nearest: few where vectors lie in clusters, half of them where they do not.
    The table is written to ``path``, by default to the shared folder.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).alias("p"), F.col(vector).cast("array<double>").alias("v")).filter("size(v) > 0 and not exists(v, x -> x is null or isnan(x))")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    path = path or f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    kind = rows.schema["p"].dataType.simpleString()
    if common is None:
        empty = VectorIndex(np.zeros((0, 1)), spark.createDataFrame([], f"cell int, p {kind}, v array<double>"), 1)
        empty.save(path)
        return empty
    d, n = common
    own = rows.filter(F.size("v") == d)
    sample = own.orderBy(F.xxhash64("p")).limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // d))).select("v").toArrow()
    matrix = np.concatenate([x for _, x in _matrices(sample["v"].combine_chunks())])
    centres = fit_centres(matrix, cells or min(most, max(1, round(math.sqrt(n)))))
    dealt = own.mapInArrow(_emit_cells(spark.sparkContext.broadcast(centres), 1, "p"), f"cell int, p {kind}, v array<double>")
    VectorIndex(centres, dealt, probes_for(matrix, centres, recall)).save(path)
    return VectorIndex.load(spark, path)
