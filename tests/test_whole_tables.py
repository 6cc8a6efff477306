"""Queries that read whole tables, on made rows that no subset by id, prefix or range holds."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from compare import duck_rows, spark_rows

from lumenframe.plans.catalogue import ORACLES, QUERIES


def both(spark, place, query, table, columns):
    """The query's rows, after they were found equal to those of its SQL."""
    pq.write_table(pa.table(columns), f"{place}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{place}/{table}.parquet')")
    df = QUERIES[query](spark, str(place))
    assert spark_rows(df) == duck_rows(con, ORACLES[query])
    return df.collect()


def test_arithmetic_of_all_orders(spark, tmp_path):
    keys = [1, 1999, 2000, 7_000_000_000]
    columns = {"l_orderkey": keys, "l_linenumber": [1] * 4, "l_partkey": [9] * 4, "l_quantity": [4.0] * 4, "l_extendedprice": [10.0] * 4, "l_tax": [0.5] * 4}
    rows = both(spark, tmp_path, "expr_arithmetic", "lineitem", columns)
    assert sorted(r.l_orderkey for r in rows) == keys
    assert {(r.a, r.s, r.m, r.d, r.r, r.neg) for r in rows} == {(4.5, 3.0, 27, 2.5, 2, -9)}


def test_letters_past_the_fortieth(spark, tmp_path):
    text = "aB" * 30 + "éÀß" + "z" * 5000 + "Ω"
    rows = both(spark, tmp_path, "string_lengths", "documents", {"doc_id": [1, 2], "text": [text, None]})
    got = {r.doc_id: (r.u, r.l) for r in rows}
    assert got == {1: (text.replace("ß", "s").upper(), text.lower()), 2: (None, None)}


def test_every_component_of_vectors(spark, tmp_path):
    vectors = [[float(i) for i in range(64)], [float(i + 1) for i in range(64)], [5.0, 6.0], [], None]
    columns = {"vec_id": list(range(5)), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0, 0, 1, 1, 1], pa.int32())}
    rows = both(spark, tmp_path, "explode_vectors", "embeddings", columns)
    assert {(r.label, r.i): r.mean for r in rows} == {(0, i): i + 0.5 for i in range(64)} | {(1, 0): 5.0, (1, 1): 6.0}


def test_sums_over_keys_past_a_short(spark, tmp_path):
    keys = [1, 29_999, 30_000, 32_767, 32_768, 65_535, 65_536, 98_304, -1, -32_769, 2**40 + 3, None]
    rows = both(spark, tmp_path, "agg_sum_types", "orders", {"o_custkey": keys, "o_orderstatus": ["F"] * 12, "o_totalprice": [1.25] * 12})
    wrapped = [(k + 32_768) % 65_536 - 32_768 for k in keys if k is not None]
    assert [tuple(r) for r in rows] == [("F", sum(k for k in keys if k is not None), 15.0, sum(wrapped), 15.0)]
