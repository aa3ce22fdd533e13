"""Operator 8, line dedup by a deletion-neighbourhood join.

Lines are near-equal when they differ by at most one word inserted, deleted or replaced (words A-Z
lower-cased; lines under NEAR_WORDS words only when they are equal).  A line is dropped when an equal or
near-equal line comes earlier, in order of (doc_id, line number); lines without words always stay.

1. Equal lines are one: a group-by of their hash keeps the earliest place.
2. Gate: of two near-equal lines of n and n or n + 1 words, either the first or the last floor(n/2)
   words agree, whatever the edit, so lines whose halves no other line has cannot have a partner.
3. The others emit their deletion neighbourhood: hashes of the line, and of the line without word i.  A
   line's own hash that equals a variant of another is an insertion or deletion; two variants with one
   place i are a replacement.  Equal variants are joined with the earliest place that emitted them,
   summed before the shuffle, and the edit distance of the two lines is verified.

Defined results: a null text has no lines; an empty one has one without words; repeated rows are ordered
by their text after the doc_id and equal ones share their places; null doc_ids come last; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.ranks import ONE_TASK_ROWS, numbered
from triweave.llm.words import mix, split_words, text_slices, word_hashes
from triweave.plans.scratch import Scratch

NEAR_WORDS = 5
#: Ranges of lines whose content is moved one after another, which bounds the disk that it takes at once.
PASSES = 2
NO_ID = (1 << 63) - 1


def line_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, word hashes) of lines."""
    offsets, codes, vocabulary = split_words(lines)
    return offsets, word_hashes(vocabulary, 8)[codes] if len(codes) else np.zeros(0, np.uint64)


def placed(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words mixed with their places, so that sums of them are hashes from which parts can be taken out."""
    return mix(words ^ mix(places.astype(np.uint64) + np.uint64(1)))


def closed(sums: np.ndarray, n: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(sums ^ (n.astype(np.uint64) * np.uint64(8) + np.uint64(salt)))


def _running(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))


def line_keys(offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole hash and a second one, half keys) of lines: arrays of 2 and 4 columns.

    Half keys are hashes of the first and the last h words for h = floor(m/2), where m is the length of
    the shorter line of a near-equal pair: n or n - 1.  For odd n both are the same.
    """
    start, end = offsets[:-1], offsets[1:]
    n = end - start
    place = np.arange(len(words)) - np.repeat(start, n)
    ahead, back = _running(placed(words, place)), _running(placed(words, np.repeat(n, n) - place + (1 << 32)))
    second = _running(placed(mix(words), place))
    whole = np.column_stack((closed(ahead[end] - ahead[start], n), closed(second[end] - second[start], n)))
    halves = []
    for m in (n, np.maximum(n - 1, 0)):
        h = m // 2
        halves += [closed(ahead[start + h] - ahead[start], h, 1), closed(back[end] - back[end - h], h, 2)]
    return whole, np.column_stack(halves)


def variants(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, kinds) of a line's deletion neighbourhood: kind -1 the line, 0 the line without a word,
    i + 1 the line without word i.  Kind -1 meets kind 0, an insertion or deletion; others their own, a
    replacement at i."""
    n = len(words)
    place = np.arange(n)
    stay, move = placed(words, place), placed(words[1:], place[:-1])
    gone = closed(_running(stay)[:-1] + np.concatenate((np.cumsum(move[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64))), np.array([n - 1]))
    whole = closed(_running(stay)[-1:], np.array([n]))
    return np.concatenate((whole, gone, gone)), np.concatenate(([-1], np.zeros(n, np.int64), place + 1))


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether word lists are at most one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


LINE_SCHEMA = "doc_id long, row long, line long, n_words long, key binary, halves array<long>, crc long, content string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line; ``row`` tells rows of one doc_id apart by their text."""
    for batch in batches:
        for part in text_slices(batch):
            texts = part.column("text")
            split = pc.split_pattern(texts.cast(pa.large_string()), "\n")
            counts = np.asarray(pc.fill_null(pc.list_value_length(split), 0), np.int64)
            lines = split.flatten()
            offsets, words = line_words(lines)
            keys, halves = line_keys(offsets, words)
            n = np.diff(offsets)
            used = np.where(n >= NEAR_WORDS, np.where((n > NEAR_WORDS) & (n % 2 == 0), 4, 2), 0)  # shorter lines have no near-equal ones
            rows = np.array([xxhash.xxh3_64_intdigest(t.as_buffer() or b"") >> 1 for t in texts.cast(pa.large_string())], np.int64)
            number = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
            take = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(take)),
                    pa.array(rows[take]),
                    pa.array(number),
                    pa.array(n),
                    pa.Array.from_buffers(pa.binary(16), len(lines), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(used))), pa.int32()), pa.array(halves[np.arange(4) < used[:, None]].view(np.int64))),
                    pa.array([zlib.crc32(x.as_buffer()) for x in lines], pa.int64()),
                    lines.cast(pa.string()),
                ],
                names=[x.split()[0] for x in LINE_SCHEMA.split(", ")],
            )


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, h, kind) of the lines in ``content``."""
    for batch in batches:
        for part in text_slices(batch, "content", 1 << 18):
            offsets, words = line_words(part.column("content"))
            made = [variants(words[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(made)), [len(h) for h, _ in made]))
            h = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in made)]).view(np.int64)
            kind = np.concatenate([np.zeros(0, np.int64), *(k for _, k in made)])
            yield pa.RecordBatch.from_arrays([part.column("n").take(take), pa.array(h), pa.array(kind)], names=["n", "h", "kind"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("content").to_pylist(), batch.column("other").to_pylist(), strict=True)
        split = [tuple(_words(x) for x in p) for p in pairs]
        yield batch.filter(pa.array([within_one_edit(a, b) for a, b in split], pa.bool_())).select(["n"])


def _words(line: str) -> list[str]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def distinct_lines(spark: SparkSession, docs: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lines, first): every line of ``docs`` (doc_id, text), and for each distinct one with words (key, p,
    near): its earliest place p (d, row, line, crc) and whether a near-equal one comes before it."""
    lines = s.table(docs.select("doc_id", "text").mapInArrow(_lines, LINE_SCHEMA))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "row", "line", "crc")
    first = s.table(lines.where("n_words > 0").groupBy("key").agg(F.min(place).alias("p"), F.min("halves").alias("halves")))
    s.release()
    halves = first.select("key", F.explode("halves").alias("h"))
    shared = s.table(halves.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h"))
    s.release()
    gated = s.table(halves.join(shared, "h").select("key").distinct())
    s.release()
    # numbers in order of place stand for the lines from here on
    wanted = numbered(gated.join(first.select("key", "p"), "key"), ["p"], "n", ONE_TASK_ROWS + 1, s)
    wanted = s.table(wanted)
    parts = []
    for i in range(PASSES):
        some = lines.select("key", place.alias("p"), "content").where(F.pmod(F.xxhash64("key"), F.lit(PASSES)) == i)
        parts.append(s.table(some.join(wanted, ["key", "p"]).select("n", "content").dropDuplicates(["n"])))
        s.release()
    texts = reduce(DataFrame.unionByName, parts)
    emitted = s.table(texts.mapInArrow(_neighbourhood, "n long, h long, kind long").withColumn("g", F.greatest("kind", F.lit(0))))
    least = (F.min(F.when(test, F.col("n"))).alias(c) for c, test in (("w", F.col("kind") < 0), ("d", F.col("kind") == 0), ("r", F.col("kind") > 0)))
    earliest = s.table(emitted.groupBy("h", "g").agg(*least, F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo < hi").drop("lo", "hi"))
    s.release()
    met = emitted.join(earliest, ["h", "g"]).withColumn("e", F.when(F.col("kind") < 0, F.col("d")).when(F.col("kind") == 0, F.col("w")).otherwise(F.col("r")))
    claims = s.table(met.where("e < n").select("n", "e").distinct())
    s.release()
    pairs = claims.join(texts, "n").join(texts.toDF("e", "other"), "e")
    near = pairs.select("n", "content", "other").mapInArrow(_verify, "n long").distinct().join(wanted.select("n", "key"), "n")
    fate = s.table(first.select("key", "p").join(near.select("key", F.lit(True).alias("near")), "key", "left"))
    s.release()
    return lines, fate


def kept_lines(spark: SparkSession, docs: DataFrame, s: Scratch) -> DataFrame:
    """(doc_id, row, line, content, keep) of every line of ``docs`` (doc_id, text)."""
    lines, fate = distinct_lines(spark, docs, s)
    here = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("p.d")) & (F.col("row") == F.col("p.row")) & (F.col("line") == F.col("p.line"))
    keep = F.col("p").isNull() | (F.col("near").isNull() & here)
    return lines.join(fate, "key", "left").select("doc_id", "row", "line", "content", keep.alias("keep"))


def line_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, kept_crc) of each document that has lines: kept_crc adds up
    crc32(line) * (line number from 1) % 1000003 over kept lines.  Equal rows are one document."""
    with Scratch(spark, "line-dedup") as s:
        lines, fate = distinct_lines(spark, docs, s)
        term = lambda crc, line: F.col(crc) * (F.col(line) + 1) % 1_000_003
        bare = F.col("n_words") == 0  # such lines stay
        once = lines.select("doc_id", "row", "line", "n_words", "crc")
        # a distinct line without words is counted by its place, so equal rows count once
        whole = once.groupBy("doc_id", "row").agg((F.max("line") + 1).alias("n_lines"))
        blank = once.where(bare).distinct().groupBy("doc_id", "row").agg(F.count("*").alias("k"), F.sum(term("crc", "line")).alias("c"))
        kept = fate.where("near IS NULL").select(F.when(F.col("p.d") != NO_ID, F.col("p.d")).alias("doc_id"), F.col("p.row").alias("row"), F.col("p.crc").alias("crc"), F.col("p.line").alias("line"))
        kept = kept.groupBy("doc_id", "row").agg(F.count("*").alias("k"), F.sum(term("crc", "line")).alias("c"))
        parts = whole.select("doc_id", "row", "n_lines", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
        for x in (blank, kept):
            parts = parts.unionByName(x.select("doc_id", "row", F.lit(0).cast("long").alias("n_lines"), "k", "c"))
        got = parts.groupBy("doc_id", "row").agg(F.sum("n_lines").alias("n_lines"), F.sum("k").alias("n_kept"), F.sum("c").alias("kept_crc"))
        return s.keep(got.select("doc_id", "n_lines", "n_kept", "kept_crc"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, s: Scratch) -> DataFrame:
    """(doc_id, row, text): the documents, of rows equal in doc_id and text one, with the lines they keep."""
    lines = kept_lines(spark, docs, s).distinct()
    kept = F.sort_array(F.collect_list(F.when(F.col("keep"), F.struct("line", "content"))))
    return lines.groupBy("doc_id", "row").agg(F.array_join(F.transform(kept, lambda x: x["content"]), "\n").alias("text"))
