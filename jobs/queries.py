"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns the output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import residualize, tuple_ledger
from triweave.plans.scratch import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_residualize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word length and variety of all documents less the effects of source, language and size class."""
    output, config = _folder(spark, "job1"), residualize.read_config()
    for _ in range(2):
        residualize.residualize(spark, f"{sf_dir}/documents.parquet", output, config)
    rows = spark.read.parquet(f"{output}/rows")
    values = [F.round(F.col(f"{t}{end}"), 4) + F.lit(0.0) for t in config["targets"] for end in ("", "_fitted", "_residual")]  # + 0.0: no negative zero
    names = [f"{t}{end}" for t in config["targets"] for end in ("", "_fitted", "_residual")]
    return rows.select(F.col("row_id").alias("doc_id"), "source", "lang", F.col("size_class").cast("int").alias("size_class"), F.col("weight").cast("long").alias("n_words"), *(v.alias(n) for v, n in zip(values, names, strict=True)))


#: Rounds of weighted means over the three factors, after which the SQL's residuals stand; they settle within some tens.
ROUNDS = 200
JOB1_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
    o AS (SELECT doc_id, source, lang, length(bin(len(words)::BIGINT))::INTEGER AS size_class, len(words)::BIGINT AS n_words, length(array_to_string(words, '')) / len(words)::DOUBLE AS y0,
      len(list_distinct(words)) / len(words)::DOUBLE AS y1 FROM d WHERE len(words) > 0),
    t AS MATERIALIZED (SELECT source, lang, size_class, SUM(n_words)::DOUBLE AS w, SUM(n_words * y0) / SUM(n_words) AS m0, SUM(n_words * y1) / SUM(n_words) AS m1 FROM o GROUP BY ALL),
    it AS (SELECT 0 AS step, source, lang, size_class, w, m0 AS r0, m1 AS r1 FROM t
      UNION ALL
      SELECT step + 1, source, lang, size_class, w, r0 - SUM(w * r0) OVER z / SUM(w) OVER z, r1 - SUM(w * r1) OVER z / SUM(w) OVER z FROM
        (SELECT step, source, lang, size_class, w, r0 - SUM(w * r0) OVER z / SUM(w) OVER z AS r0, r1 - SUM(w * r1) OVER z / SUM(w) OVER z AS r1 FROM
          (SELECT step, source, lang, size_class, w, r0 - SUM(w * r0) OVER z / SUM(w) OVER z AS r0, r1 - SUM(w * r1) OVER z / SUM(w) OVER z AS r1 FROM it WHERE step < {N} WINDOW z AS (PARTITION BY source))
          WINDOW z AS (PARTITION BY lang)) WINDOW z AS (PARTITION BY size_class)),
    f AS (SELECT source, lang, size_class, m0 - r0 AS f0, m1 - r1 AS f1 FROM t JOIN (SELECT * FROM it WHERE step = {N}) USING (source, lang, size_class))
    SELECT doc_id, source, lang, size_class, n_words, round(y0, 4) + 0.0 AS word_length, round(f0, 4) + 0.0 AS word_length_fitted, round(y0 - f0, 4) + 0.0 AS word_length_residual,
      round(y1, 4) + 0.0 AS variety, round(f1, 4) + 0.0 AS variety_fitted, round(y1 - f1, 4) + 0.0 AS variety_residual FROM o JOIN f USING (source, lang, size_class)""".replace("{N}", str(ROUNDS))


def job2_tuple_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums of price and discount, weighted by quantity, of all line items by supplier, flag and month."""
    output, config = _folder(spark, "job2"), tuple_ledger.read_config()
    for _ in range(2):
        tuple_ledger.update_ledger(spark, f"{sf_dir}/lineitem.parque[t]", output, config)  # a pattern, as a stream's path may not be that of one file
    rows = tuple_ledger.read_current(spark, output, config)
    return rows.select("supplier", "returned", "month", "year", "n_rows", "weight", F.round("w_price", 2).alias("w_price"), F.round("w_discount", 2).alias("w_discount"))


JOB2_SQL = """SELECT l_suppkey AS supplier, l_returnflag AS returned, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(COUNT(*) AS BIGINT) AS n_rows, SUM(l_quantity) AS weight,
    CAST(SUM(CAST(l_quantity AS DECIMAL(9, 0)) * CAST(l_extendedprice AS DECIMAL(15, 2))) AS DOUBLE) AS w_price, CAST(SUM(CAST(l_quantity AS DECIMAL(9, 0)) * CAST(l_discount AS DECIMAL(9, 2))) AS DOUBLE) AS w_discount
    FROM lineitem GROUP BY ALL"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_residualize": job1_residualize, "job2_tuple_ledger": job2_tuple_ledger}
ORACLE_SQL: dict[str, str] = {"job1_residualize": JOB1_SQL, "job2_tuple_ledger": JOB2_SQL}
