"""Operator 9, exact top-k search by distributed histogram selection.

Vectors become integers floor(scale * x); scores are integer inner products.  Queries come in blocks of
bounded size.  For a block, each pass scores every candidate against every query and adds up histograms
over the interval that still holds a query's k-th score; the bin in which the k-th score falls is the
next interval, until it holds one value.  A last pass keeps scores at or above it, ties to smaller ids.

What a task sends on is bounded without loss: a task's own k-th score is a lower bound of the global
one, so it sends at most ``k`` filled bins, counted from the top, and at most ``k`` results a query.

Defined results: null vectors, vectors with null or non-finite components, and rows without id take no
part; vectors of different lengths have no score; a query is never its own candidate, nor is a row with
its id; equal query rows are one query, other vectors of one id queries of their own, equal candidate rows each count; scores beyond 64 bits stop at the ends
of that range; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.plans.scratch import Scratch

BLOCK_QUERIES, BINS, ROWS = 1024, 4096, 4096
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integer_vectors(ids: pa.Array, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole numbers as float64) of the usable rows, for each length."""
    usable = pc.and_(ids.is_valid(), vectors.is_valid()).to_numpy(zero_copy_only=False)
    lengths = np.where(usable, np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)), -1)
    for n in np.unique(lengths[usable]):
        rows = pa.array(np.flatnonzero(usable & (lengths == n)))
        values = vectors.take(rows).flatten().cast(pa.float64())
        m = values.to_numpy(zero_copy_only=False).reshape(len(rows), int(n))  # nulls become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            m, good = np.floor(scale * m), np.isfinite(m).all(axis=1)
        # beyond the range of doubles, floor() would not be finite
        m = np.clip(m, -np.finfo(float).max, np.finfo(float).max)
        if good.any():
            yield ids.take(rows).to_numpy()[good], m[good]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; those beyond 64 bits stop at the ends of that range."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.array([[min(max(int(x), LOW), HIGH) for x in row] for row in whole(q) @ whole(c).T], np.int64)


def _scored(batches: Iterator[pa.RecordBatch], scale: int, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, candidate ids, scores, which may count) for pieces of the candidates."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for ids, c in integer_vectors(part.column(0), part.column(1), scale):
                if (of := block["by_length"].get(c.shape[1])) is not None:
                    numbers, q_ids, q = of
                    yield numbers, ids, scores(q, c), q_ids[:, None] != ids[None, :]


def _histogram(shared, scale: int, k: int):
    """Counts of a task by (query, bin) in the queries' intervals, from the top until the needed number is met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        lo, hi, width, need = (block[x] for x in ("lo", "hi", "width", "need"))
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for numbers, _, s, counts in _scored(batches, scale, block):
            for row, n in enumerate(numbers.tolist()):
                if need[n] <= 0:
                    continue
                x = s[row][counts[row]]
                x = x[(x >= lo[n]) & (x <= hi[n])]
                if len(x) > need[n]:  # only the highest can matter
                    kth = np.partition(x, len(x) - need[n])[len(x) - need[n]]
                    bins, size = np.unique((x[x >= kth].astype(object) - lo[n]) // width[n] if width[n] > HIGH // 2 or abs(lo[n]) > HIGH // 4 else (x[x >= kth] - lo[n]) // width[n], return_counts=True)
                else:
                    bins, size = np.unique((x.astype(object) - lo[n]) // width[n] if width[n] > HIGH // 2 or abs(lo[n]) > HIGH // 4 else (x - lo[n]) // width[n], return_counts=True)
                if n in best:
                    bins, where = np.unique(np.concatenate((best[n][0], bins)), return_inverse=True)
                    size = np.bincount(where, np.concatenate((best[n][1], size))).astype(np.int64)
                above = np.cumsum(size[::-1])[::-1] - size
                keep = above < need[n]
                best[n] = bins[keep], size[keep]
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(list(best), [len(b) for b, _ in best.values()]), pa.int64()),
                    pa.array(np.concatenate([b for b, _ in best.values()]).astype(np.int64), pa.int64()),
                    pa.array(np.concatenate([c for _, c in best.values()]), pa.int64()),
                ],
                names=["number", "bin", "n"],
            )

    return run


def _select(shared, scale: int, k: int):
    """A task's best ``k`` rows of each query among those at or above the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for numbers, ids, s, counts in _scored(batches, scale, block):
            for row, n in enumerate(numbers.tolist()):
                at = np.flatnonzero(counts[row] & (s[row] >= block["lo"][n]))
                if not len(at):
                    continue
                x, y = s[row][at], ids[at]
                if n in best:
                    x, y = np.concatenate((best[n][0], x)), np.concatenate((best[n][1], y))
                order = np.lexsort((y, ~x))[:k]  # ~x falls as x rises and cannot overflow
                best[n] = x[order], y[order]
        if best:
            numbers = np.repeat(list(best), [len(x) for x, _ in best.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["ids"][numbers], pa.int64()), pa.array(numbers, pa.int64()), *(pa.array(np.concatenate([b[i] for b in best.values()]), pa.int64()) for i in (1, 0))],
                names=["query_id", "number", "vec_id", "score"],
            )

    return run


def _largest(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float(np.abs(c).max()) for b in batches for _, c in integer_vectors(b.column(0), b.column(1), scale) if c.size), default=None)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return run


def top_k(spark: SparkSession, candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) from frames whose first two columns are id and vector."""
    with Scratch(spark, "top-k") as s:
        result = f"{s.root}/result"
        kept = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        kept.write.parquet(result)
        named = [x.toDF("vec_id", "vector") for x in (candidates, queries)]
        most = named[0].mapInArrow(_largest(scale), "most double").agg(F.max("most")).first()[0]
        total = named[1].count()
        blocks = -(-total // (BLOCK_QUERIES // 2))
        if most is not None and blocks:
            dealt = named[1].distinct().withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
            dealt.write.partitionBy("block").parquet(f"{s.root}/scratch/queries")
            dealt = spark.read.parquet(f"{s.root}/scratch/queries")
            for i in range(blocks):
                rows = dealt.where(F.col("block") == i).select("vec_id", "vector").toArrow().combine_chunks()
                if rows.num_rows:
                    _block(spark, named[0], rows, most, k, scale).write.mode("append").parquet(result)
    return spark.read.schema(kept.schema).parquet(result)


def _block(spark: SparkSession, candidates: DataFrame, rows: pa.Table, most: float, k: int, scale: int) -> DataFrame:
    by_length, ids, at, bound = {}, [], 0, []
    flat = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in rows.columns]
    for q_ids, q in integer_vectors(*flat, scale):
        by_length[q.shape[1]] = np.arange(at, at + len(q)), q_ids, q
        ids.append(q_ids)
        at += len(q)
        bound += [int(x * most) + 1 if x < 2.0**62 / max(most, 1.0) else HIGH for x in np.minimum(np.abs(q), 2.0**900).sum(axis=1)]
    block = {"by_length": by_length, "ids": np.concatenate([np.zeros(0, np.int64), *ids])}
    lo, hi, need = [-b for b in bound], list(bound), [k] * at
    width = [1] * at
    while any(h > l for l, h, n in zip(lo, hi, need, strict=True) if n > 0):
        width = [-(-(h - l + 1) // BINS) for l, h in zip(lo, hi, strict=True)]
        shared = spark.sparkContext.broadcast(block | {"lo": lo, "hi": hi, "width": width, "need": need})
        counted = candidates.mapInArrow(_histogram(shared, scale, k), "number long, bin long, n long").groupBy("number", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("number").orderBy(F.desc("bin"))
        needed: Column = F.element_at(F.array(*map(F.lit, need)), F.col("number").cast("int") + 1) if at <= 64 else F.lit(None)
        located = counted.withColumn("above", F.sum("n").over(down) - F.col("n"))
        if at > 64:
            located = located.join(F.broadcast(spark.createDataFrame(list(enumerate(need)), "number long, need int")), "number")
        else:
            located = located.withColumn("need", needed)
        found = {r.number: r for r in located.where("above < need and above + n >= need").select("number", "bin", "above").collect()}  # a row a query
        shared.unpersist()
        for n in range(at):
            if need[n] <= 0:
                continue
            if n in found:
                lo[n], hi[n] = lo[n] + found[n].bin * width[n], min(hi[n], lo[n] + (found[n].bin + 1) * width[n] - 1)
                need[n] -= found[n].above
            else:  # fewer than k candidates: all are taken
                lo[n], hi[n], need[n] = -bound[n], -bound[n], 0
    shared = spark.sparkContext.broadcast(block | {"lo": lo})
    best = candidates.mapInArrow(_select(shared, scale, k), "query_id long, number long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_digest(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select("vec_id", "embedding")
    return top_k(spark, vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, embedding, e FROM v WHERE vec_id % 100 = 0),
p AS (SELECT q.vec_id AS query_id, q.embedding, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id, embedding ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
