"""Operator 12, language identification: nearest of several centroids a language, over TF-IDF vectors of character n-grams.

1. A text's n-grams are those of 1 to ORDERS characters of its letters and marks, case folded, everything else being one
   space between words, hashed to 2**BITS places.  Its vector is log(1 + count) times idf, of length one.
2. idf counts, over all documents to learn from, in how many each place occurs (in tasks, then summed by place).
3. For each language, at most ``most`` over the number of languages of its documents, those whose id's hash comes first,
   are clustered by spherical k-means into at most CLUSTERS centroids.  Each centroid keeps as its radius the distance
   within which QUANTILE of its documents lie.
4. A text's language is that of the centroid with the greatest cosine, which is the score; it is rejected if its
   distance, 1 - cosine, is over that centroid's radius.

The model is one vector a centroid, 2**BITS numbers: CLUSTERS for each language, and at most MOST_LANGUAGES languages (more
are an error), so what is broadcast does not grow with the documents.

Defined results: texts that are null or hold no letter are ``und`` with score 0 and rejected, and nothing is learned from
them; rows with null lang, or null doc_id, are not learned from and not held out; without anything to learn from, every text
is ``und``; ties go to the language that sorts first; repeated rows each get a row; extra columns are ignored; an empty
table gives an empty result; bytes that are not UTF-8 count as the replacement character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.llm.words import give_back, text_slices, tidy, worker_state

BITS, ORDERS, CLUSTERS, QUANTILE, FOLDS = 13, 3, 4, 0.995, 5
#: Documents that centroids are fitted on, at most, in all; languages, at most; documents whose counts are held at once; seed of the clustering.
MOST, MOST_LANGUAGES, ROWS, SEED = 3000, 1000, 256, 12
WIDTH = 1 << BITS
UNKNOWN = "und"
SCHEMA = "doc_id long, lang string, score double, accepted boolean"


def letters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of letters between single spaces, and which texts hold a letter."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    has = np.asarray(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False), bool)
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(space, pc.utf8_trim(plain, " "), space, none), has


def counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts of the n-grams by place) for some texts after others; spaces alone are no n-gram."""
    lengths = np.asarray(pc.utf8_length(texts), np.int64)
    for first in range(0, len(lengths), ROWS):
        end = min(first + ROWS, len(lengths))
        x = np.frombuffer("".join(texts.slice(first, end - first).to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
        row = np.repeat(np.arange(end - first), lengths[first:end])
        table, gram = np.zeros((end - first) * WIDTH, np.int64), np.zeros(len(x) + 1, np.uint64)
        for n in range(1, ORDERS + 1):
            size = max(len(x) - n + 1, 0)
            gram = gram[:size] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
            place = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            use = row[:size] == row[n - 1 :]
            if n == 1:
                use &= x != 32
            table += np.bincount((row[:size] * WIDTH + place)[use], minlength=len(table))
        yield first, end, table.reshape(end - first, WIDTH)


def vectors(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; rows without n-grams are 0."""
    v = np.log1p(table.astype(np.float32)) * idf.astype(np.float32)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    languages: list[str]  # of each centroid

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, cosine) of each row."""
        cosine = v @ self.centroids.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(v)), best].astype(float), 0, 1)


def clusters(v: np.ndarray, k: int, seed: int = SEED, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of length one, nearest of each row): spherical k-means from seeded, spread-out first centroids."""
    rng, chosen = np.random.default_rng(seed), [int((v @ v.sum(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        apart = np.maximum(1 - (v @ v[chosen].T).max(axis=1), 0).astype(float) ** 2
        if apart.sum() < 1e-9:
            break
        chosen.append(int(rng.choice(len(v), p=apart / apart.sum())))
    centres, own = v[chosen], np.zeros(len(v), int)
    for step in range(steps):
        before, own = own, (v @ centres.T).argmax(axis=1)
        if step and (own == before).all():
            break
        sums = np.stack([v[own == i].sum(axis=0) for i in range(len(centres))])
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centres)
    used = np.unique(own := (v @ centres.T).argmax(axis=1))
    return centres[used], np.searchsorted(used, own)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for part in text_slices(batch):
            texts, has = letters(part.column("text"))
            for first, end, table in counts(texts):
                seen += (table > 0).sum(axis=0)
                n += int(has[first:end].sum())
    places = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(seen[places], n))], names=["place", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            texts, _ = letters(part.column("text"))
            x = [row.tobytes() for _, _, table in counts(texts) for row in np.minimum(table, 65_535).astype("<u2")]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(x, pa.binary())], names=["lang", "h", "x"])


def language_model(docs: DataFrame, most: int = MOST, k: int = CLUSTERS) -> LanguageModel | None:
    """Learned from ``text`` and ``lang`` of the rows of ``docs`` (doc_id, text, lang) that are not held out; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id")) != 0))
    known = known.select("doc_id", F.make_valid_utf8("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    df = known.select("text").mapInArrow(tidy(_document_frequency), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toPandas()  # a row a place
    n, seen = int(df.loc[df.place < 0, "df"].sum()), np.zeros(WIDTH)
    seen[df.loc[df.place >= 0, "place"]] = df.loc[df.place >= 0, "df"]
    idf = np.log((1 + n) / (1 + seen)) + 1
    each = max(1, most // len(sizes))
    # four times as many as wanted by a hash that needs no shuffle, then exactly the first of them
    limits = docs.sparkSession.createDataFrame([(lang, min(1.0, 4 * each / size)) for lang, size in sizes.items()], "lang string, part double")
    drawn = known.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30))
    drawn = drawn.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("place") <= each).select("lang", "h", "text")
    rows = drawn.mapInArrow(tidy(_features), "lang string, h long, x binary").toPandas().sort_values(["lang", "h", "x"], kind="stable")
    centres, radii, languages = [], [], []
    for lang in sorted(sizes):
        own = rows.loc[rows.lang == lang, "x"]
        v = vectors(np.stack([np.frombuffer(x, "<u2") for x in own]), idf)
        c, nearest = clusters(v, k)
        distance = 1 - (v * c[nearest]).sum(axis=1)
        centres.append(c)
        radii += [float(np.quantile(distance[nearest == i], QUANTILE)) for i in range(len(c))]
        languages += [lang] * len(c)
    give_back()
    return LanguageModel(idf, np.concatenate(centres).astype(np.float32), np.array(radii), languages)


def _identify(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("plain", dict)
        model = shared.value
        for batch in batches:
            for part in text_slices(batch):
                texts, has = letters(part.column("text"))
                best, score = np.zeros(len(has), np.int64), np.zeros(len(has))
                for first, end, table in counts(texts) if model else ():
                    best[first:end], score[first:end] = model.nearest(vectors(table, model.idf))
                known = has & (model is not None)
                score = np.where(known, score, 0.0)
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                accepted = known & (1 - score <= model.radii[best]) if model else known
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "lang", "score", "accepted"])

    return run


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang, score, accepted) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    return rows.mapInArrow(tidy(_identify(spark.sparkContext.broadcast(model))), SCHEMA)


def language_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every document, learned from those not held out."""
    found = identify(spark, docs, language_model(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("lang").alias("lang_pred"), F.round("score", 6).alias("score"), "accepted")
