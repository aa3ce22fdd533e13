"""Observation tables of six three-factor designs over the star schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> SQL over the tables for (row_id, k1, k2, k3, w, w2, y)
SQL = {
    "D1": """SELECT l.l_orderkey * 16 + l.l_linenumber AS row_id, o.o_custkey AS k1, l.l_partkey AS k2, l.l_suppkey AS k3,
        l.l_quantity AS w, CAST(l.l_linenumber AS DOUBLE) AS w2, l.l_extendedprice AS y FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "D2": """SELECT l.l_orderkey * 16 + l.l_linenumber AS row_id, c.c_nationkey AS k1, p.p_brand AS k2, l.l_suppkey AS k3,
        l.l_quantity AS w, CAST(l.l_linenumber AS DOUBLE) AS w2, l.l_extendedprice AS y FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "D3": """SELECT l.l_orderkey * 16 + l.l_linenumber AS row_id, n.n_regionkey AS k1, n.n_nationkey AS k2, l.l_suppkey AS k3,
        l.l_quantity AS w, CAST(l.l_linenumber AS DOUBLE) AS w2, l.l_extendedprice AS y FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "D4": """SELECT o.o_orderkey AS row_id, c.c_nationkey AS k1, c.c_custkey AS k2, o.o_orderkey AS k3,
        CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS w2, o.o_totalprice AS y FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "D5": """SELECT l.l_orderkey * 16 + l.l_linenumber AS row_id, l.l_suppkey AS k1, s.s_nationkey AS k2, p.p_brand AS k3,
        l.l_quantity AS w, CAST(l.l_linenumber AS DOUBLE) AS w2, l.l_extendedprice AS y FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN part p ON p.p_partkey = l.l_partkey""",
    "D6": """SELECT n.n_regionkey AS k1, c.c_mktsegment AS k2, o.o_orderpriority AS k3, MIN(o.o_orderkey) AS row_id,
        CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS w2, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / COUNT(*) AS y
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
        GROUP BY n.n_regionkey, c.c_mktsegment, o.o_orderpriority""",
}
TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation")
#: Rows of the largest table a design expands to bound the numbers of tuples and levels.
LARGEST = {"D1": "lineitem", "D2": "lineitem", "D3": "lineitem", "D4": "orders", "D5": "lineitem", "D6": "orders"}


def observations(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The observations of a design; every join key is unique on its right side."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def row_bound(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of the design's largest table, from the Parquet footers: observations, tuples and levels are no more."""
    return spark.read.parquet(f"{sf_dir}/{LARGEST[name]}.parquet").count()


def sql_prelude(name: str) -> str:
    """CTEs obs, v1..v3 (levels), coded (observations with a, b, c), t (tid, a, b, c, w, n_obs, wy), e (edges q, l, w), x (coefficients)."""
    levels = ", ".join(f"v{i} AS (SELECT k{i}, CAST(row_number() OVER (ORDER BY k{i}) - 1 AS INTEGER) AS {c} FROM (SELECT DISTINCT k{i} FROM obs))" for i, c in ((1, "a"), (2, "b"), (3, "c")))
    return f"""WITH obs AS ({SQL[name]}), {levels},
    coded AS (SELECT obs.*, a, b, c FROM obs JOIN v1 USING (k1) JOIN v2 USING (k2) JOIN v3 USING (k3)),
    t AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS tid, a, b, c, w, w2, n_obs, y, wy FROM
      (SELECT a, b, c, SUM(w) AS w, SUM(w2) AS w2, COUNT(*) AS n_obs, SUM(CAST(y AS DECIMAL(18, 2)) * CAST(w AS DECIMAL(9, 0))) AS wy, MAX(y) AS y FROM coded GROUP BY a, b, c)),
    e AS (SELECT 0 AS q, a AS l, t.* FROM t UNION ALL SELECT 1, b, t.* FROM t UNION ALL SELECT 2, c, t.* FROM t),
    bx AS (SELECT t.*, CAST((a % 7 - 3) + (b % 7 - 3) + (c % 7 - 3) AS DOUBLE) AS bx FROM t),
    lv AS (SELECT DISTINCT q, l FROM e)"""
