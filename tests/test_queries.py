"""Every query with SQL gives the same rows in DuckDB; every other query runs."""

import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkworks.plans import analytics, content, learning, relational  # noqa: F401
from sparkworks.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def table(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow().to_pylist()
    if name in ORACLE_SQL:
        reader = duck.sql(ORACLE_SQL[name]).arrow()
        assert table(got) == table((reader.read_all() if hasattr(reader, "read_all") else reader).to_pylist())
    else:
        assert got


def test_keywords_beyond_the_first_thousand(spark):
    few = {r["term"] for r in QUERIES["tfidf"](spark, DATA).select("term").distinct().collect()}
    many = {r["term"] for r in QUERIES["tfidf_10000"](spark, DATA).select("term").distinct().collect()}
    assert few < many


def test_all_sorted_rows(spark):
    """No row is lost, and nulls are last."""
    orders = spark.read.parquet(f"{DATA}/orders.parquet").count()
    rows = sorted(QUERIES["sort_mixed_all"](spark, DATA).collect(), key=lambda r: r["rn"])
    assert [r["rn"] for r in rows] == list(range(1, orders + 1))
    nulls = [r["p"] is None for r in rows]
    assert any(nulls) and nulls == sorted(nulls)


def test_array_rounding_at_ties(spark, tmp_path):
    """Floats next to a tie round as their float products do."""
    tie = np.arange(-99, 100, 2, dtype=np.float32) / np.float32(20)
    near = np.stack([tie, np.nextafter(tie, np.float32(9)), np.nextafter(tie, np.float32(-9)), tie + 1], axis=1)
    pq.write_table(pa.table({"vec_id": np.arange(len(near)), "embedding": pa.array(near.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(near), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    reader = duckdb.connect().sql(ORACLE_SQL["fn_array"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")).arrow()
    want = (reader.read_all() if hasattr(reader, "read_all") else reader).to_pylist()
    assert table(QUERIES["fn_array"](spark, str(tmp_path)).toArrow().to_pylist()) == table(want)
