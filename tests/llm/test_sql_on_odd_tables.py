"""Queries against their own SQL in DuckDB, on tables with nulls, repeats, newlines and letters beyond ASCII."""

import collections

import duckdb
from pyspark.sql import functions as F

from triweave.llm import mixing, queries

TEXTS = ["one two three", "one two three", "", None, " \n", "été \U0001f600 z", "a" * 40, "w " * 500, "x y", "x  y"]
URLS = [
    "http://shop.example.com/casino\n", "http://shop.example.com/casino", "http://a.org/login\n", "http://a.org/login", "http://a.net/?affiliate_id=٣٤", "http://a.net/?affiliate_id=34",
    "http://a.net/cart/addé", "http://a.net/cart/add", "http://a.net/cart/add_", "http://a.net/f.zip\n#x", "http://a.net/f.zip#x", "HTTP://X.Example.ORG/en/12", "http://example.org/es/", "http://example.org\n/es/",
    "://com/fr/", "http://é.com/de/x", "ftp://notexample.org/es/", "no scheme", "", None, "http://" + "a" * 30_000 + ".com/de/" + "b/" * 30_000 + "login", "http://sex.example.com/", "http://sex", "http://a.net/?phpsessid=0123abcd",
]
VECTORS = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (0, [1.0, -0.5]), (100, [0.1, 0.1]), (100, None), (200, [float("nan"), 1.0]), (300, [0.2]), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0])]


def same(spark, tmp_path, name, tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(frame.columns)
    got = collections.Counter(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == collections.Counter(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    return frame


def test_mixing(spark, tmp_path):
    rows = [(i if i % 3 else None, t, s, "e") for i, t in enumerate(TEXTS * 6) for s in ("b", "a", "", None, "é")]
    same(spark, tmp_path, "op7_mixing", {"documents": spark.createDataFrame(rows, "doc_id long, text string, source string, key string")})


def test_mixing_without_ids_comes_near_its_targets(spark, tmp_path):
    rows = [(None, f"{s} {i} " + "w " * (i % 7), s) for i in range(3000) for s in ("a", "b", "c", "d") if s != "b" or i % 3 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    same(spark, tmp_path, "op7_mixing", {"documents": docs})
    taken = mixing.mix(docs).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    assert len(taken) == 4 and all(abs(r.taken - r.target) < 0.05 * r.target for r in taken)


def test_url_filter(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[1], "h")]
    same(spark, tmp_path, "op5_url_filter", {"pages": spark.createDataFrame(rows, "page_id long, url string, host string")})


def test_topk_search(spark, tmp_path):
    rows = [(i, v, 1) for i, v in VECTORS] + [(i, [(i * 37 % 11) / 7, (i * 53 % 13) / 9], 1) for i in range(1, 60)] + [(5, [0.5, 0.5], 1)] * 2
    same(spark, tmp_path, "op9_topk_search", {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")})
