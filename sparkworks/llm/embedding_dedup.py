"""Near-duplicate vectors by random-hyperplane sign hashing (operator 7).

Equal vectors form a class that one of them stands for.  Each of several
tables hashes a class to the signs of its products with random hyperplanes;
classes in one bucket are compared by exact cosine in double precision.  The
number of bits follows the number of classes, and the number of tables is the
least that misses a pair at the threshold with probability ``miss`` at most.

Pairs never leave a task.  A pair is counted in the first table that brings it
together, which its two signatures tell, so a bucket yields a link count per
class and the links of a spanning forest.  A bucket of more than ``tile``
classes is dealt out in pairs of tiles, because exact link counts need all its
comparisons; no task holds more than two tiles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import partitions, settle
from sparkworks.llm.components import components
from sparkworks.llm.near_dedup import whole_groups
from sparkworks.llm.textnum import mix, run_starts


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n classes."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2) / 16))))
    alike = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(alike**bits)))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) bucket numbers of unit vectors."""
    planes = np.random.default_rng([7, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2).astype(np.uint32)


def _emit_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for x in batch["vector"]:
            v = np.array([np.nan if y is None else y for y in x.as_py()], np.float64) if x.is_valid else np.zeros(0)
            peak = np.abs(v).max() if len(v) else 0.0
            if not len(v) or not np.isfinite(v).all() or peak == 0:
                keys.append(0)
                rows.append(None)
                continue
            unit = v / peak  # neither overflow nor underflow of the norm
            unit = unit / np.sqrt(unit @ unit)
            keys.append(int.from_bytes(hashlib.blake2b((v + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True) or 1)
            rows.append(unit.tobytes())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], ["id", "class", "unit"])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each dimension."""
    raw = column.to_pylist()
    size = np.array([len(x) for x in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), -1)


def _emit_buckets(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_length(batch["unit"]):
                sign = signatures(vectors, bits, tables).astype(np.uint64)
                key = mix(mix(sign + (np.arange(tables, dtype=np.uint64) << np.uint64(32))) + np.uint64(vectors.shape[1]))
                names = np.repeat(batch["class"].to_numpy()[at], tables)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(names)], ["bucket", "table", "class"])

    return run


def _compare(bits: int, tables: int, threshold: float):
    def block(a: np.ndarray, b: np.ndarray, same: bool, sign_a, sign_b, table: int):
        """Linked places of two tiles that no earlier table brings together."""
        for k in range(0, len(a), 256):
            i, j = np.nonzero(a[k : k + 256] @ b.T >= threshold)
            i += k
            if same:
                i, j = i[i < j], j[i < j]
            if len(i) and table:
                new = np.concatenate([~(sign_a[i[c : c + 65536], :table] == sign_b[j[c : c + 65536], :table]).any(axis=1) for c in range(0, len(i), 65536)])
                i, j = i[new], j[new]
            if len(i):
                yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "group"):
            cuts = np.append(run_starts(group["group"].to_numpy()), group.num_rows)
            table, names, weight, side = (group[c].to_numpy() for c in ("table", "class", "n", "side"))
            units = group["unit"].to_pylist()
            out: list[list] = [[], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                vectors = np.frombuffer(b"".join(units[a:b]), np.float64).reshape(b - a, -1)
                sign = signatures(vectors, bits, tables)
                left, right = np.flatnonzero(side[a:b] != 1), np.flatnonzero(side[a:b] != 0)
                count, label = np.zeros(b - a, np.int64), np.arange(b - a)
                for i, j in block(vectors[left], vectors[right], not (side[a:b] != 2).any(), sign[left], sign[right], int(table[a])):
                    i, j = left[i], right[j]
                    np.add.at(count, i, weight[a:b][j])
                    np.add.at(count, j, weight[a:b][i])
                    while len(i):
                        x, y = i[0], j[0]
                        if label[x] != label[y]:
                            out[0].append(names[a + x])
                            out[1].append(names[a + y])
                            out[2].append(0)
                            label[label == label[y]] = label[x]
                        open_ = label[i] != label[j]
                        i, j = i[open_], j[open_]
                for k in np.flatnonzero(count).tolist():
                    out[0].append(names[a + k])
                    out[1].append(None)
                    out[2].append(count[k])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])

    return run


def embedding_dedup(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-5, tile: int = 2048) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id and kept.

    Links join vectors of one dimension with a cosine of ``threshold`` or
    more.  Vectors that are null, empty, zero or hold null or non-finite
    components have no links.  Rows that repeat an id count as vectors of
    their own; rows without an id are compared too, and a component without
    any id is named null.  An empty table gives no rows; other columns are
    ignored.
    """
    plain = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = plain.schema["id"].dataType.simpleString()
    rows = settle(plain.mapInArrow(_emit_classes, f"id {kind}, class long, unit binary"))
    classes = settle(rows.filter("class <> 0").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("unit").alias("unit")))
    bits, tables = plan_tables(classes.count(), threshold, miss)
    buckets = settle(classes.select("class", "unit").mapInArrow(_emit_buckets(bits, tables), "bucket long, table int, class long"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = buckets.join(sizes, "bucket").withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    own = F.pmod(F.xxhash64("class", F.lit(3)), F.col("tiles")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # Side 2 is compared within itself; 0 and 1 are the two tiles of a pair.
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "table", "class", side.alias("side"))
    dealt = dealt.join(classes.select("class", "n", "unit"), "class").select("group", "table", "class", "n", "side", "unit")
    found = settle(dealt.repartition(partitions(df), "group").sortWithinPartitions("group").mapInArrow(_compare(bits, tables, threshold), "a long, b long, n long"))
    links = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    parts = components(found.filter("b is not null").select("a", "b"))
    named = classes.select("class", "n", "first").join(parts.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
    named = named.select("class", "first", F.coalesce("component", "class").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = settle(named.join(least, "component").select("class", "n_links", "component_id"))
    out = rows.select("id", "class").join(of_class, "class", "left")
    name = F.when(F.col("class") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))
