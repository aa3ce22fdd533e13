"""Operator 7, mixing sources to target weights: DataFrame functions only.

Sizes are words, runs of ``[^\\x20\\x09-\\x0D]``.  Sources, in code-point order with null last, weigh
1, 2, 3, repeating, and share all words in proportion; a target stops at ``cap`` times its source's size,
and the excess is shared anew by weight until no target is above its cap.  A document is emitted
floor(rate) times, and once more when its hash, uniform in [0, 1), is below the rate's fraction.

Defined results: a null text has size 0; the null source is a source; documents without words are
emitted like others of their source and add no words; sources without words have target 0; rows that
share a doc_id take the same draw; those without one take a draw by source and text, so equal ones take the
same; extra columns stay, whatever their names; an empty table gives an empty result.  The table of sources has one row for each source after partial aggregation and is written once;
Spark joins it by broadcast only when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.plans.scratch import Scratch

WEIGHTS, RANGE = (1, 2, 3), 1 << 20


def word_count(text: Column) -> Column:
    """Each word with the white space before it becomes one letter; what stays after the last word is trimmed."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\f\r"))), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source, a table in the shared folder.

    In order of size over weight, the capped sources come first; the first source whose share of what
    those before it leave is within its cap fixes the share by weight of itself and all after it.  Places
    and sums before a source are taken by ranges of sources, so no task holds more than RANGE of them.
    """
    spark = sizes.sparkSession
    with Scratch(spark, "mixing") as s:
        sums = s.table(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull()))
        place = numbered(sums, ["absent", "source"], "place", scratch=s)
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
        ratio = F.col("source_size") / F.col("weight")
        weighed = s.table(numbered(place.withColumn("weight", weight).withColumn("ratio", ratio), ["ratio", "absent", "source"], "at", scratch=s).withColumn("range", F.floor(F.col("at") / F.lit(RANGE))))
        ranges = weighed.groupBy("range").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).orderBy("range").collect()  # a row for RANGE sources
        offsets, all_size, all_weight = [], 0, 0.0
        for r in ranges:
            offsets.append((r.range, all_size, all_weight))
            all_size, all_weight = all_size + r["size"], all_weight + r.weight
        before = W.partitionBy("range").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        left = F.lit(all_size) - cap * (F.col("size0") + F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        filled = weighed.join(F.broadcast(spark.createDataFrame(offsets, "range long, size0 long, weight0 double")), "range")
        filled = filled.withColumn("share", left / (F.lit(all_weight) - (F.col("weight0") + F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
        first = filled.where(F.col("share") * F.col("weight") <= F.lit(cap) * F.col("source_size")).orderBy("at").limit(1).collect()
        capped, by_weight = (F.col("at") < first[0].at, first[0].share) if first else (F.lit(True), 0.0)
        target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(by_weight) * F.col("weight"))
        return s.keep(weighed.select("source", "source_size", target.alias("target")))


def draw_key() -> Column:
    """What a row's draw is taken by: its doc_id, or where that is null its source and text, lengths first, so no two of them read the same."""
    parts = (F.coalesce(F.length(c), F.lit(-1)).cast("string") for c in ("row.source", "row.text"))
    return F.coalesce(F.col("row.doc_id").cast("string"), F.concat_ws(":", F.lit("null"), *parts, "row.source", "row.text"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """(row, size, source_size, target, copies): ``docs`` as one column, so no name of theirs meets one of these."""
    sized = docs.select(F.struct(*docs.columns).alias("row")).withColumn("size", word_count(F.col("row.text")))
    targets = source_targets(sized.select("row.source", "size"), weights, cap)
    joined = sized.join(targets, F.col("row.source").eqNullSafe(F.col("source"))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    extra = (uniform(seed, draw_key()) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, weights, cap, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mixing_digest(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, concat_ws(':', 'null', coalesce(length(source), -1)::VARCHAR, coalesce(length(text), -1)::VARCHAR, source, text)) AS key,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS pos FROM w),
f AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM o),
k AS (SELECT min(pos) AS first FROM f WHERE share * weight <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN first IS NULL OR pos < first THEN (3 * source_size)::DOUBLE
  ELSE (SELECT share FROM f WHERE pos = first) * weight END AS target FROM f, k),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
  ('0x' || substr(md5('7:' || d.key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
