"""Operator 3, n-gram Jaccard join by a token-group matrix.

Sets of hashed word shingles are joined exactly at a Jaccard threshold t, in classes of linked documents:

1. Equal sets are one node, the least document that has the set.  A task signs the first document only of each set
   that it meets, and what it signed then goes under that least document, so no order of rows matters.
2. Signatures: linked sets of sizes a and b differ in at most H = (a + b)(1 - t)/(1 + t) shingles.  The
   hash range is cut into H + 1 + spare blocks, so at least 1 + spare blocks of two linked sets hold the
   same shingles: a block with its shingles is a joint token.  Blocks of few shingles are left out by a
   set that has at most ``spare`` of them, as another block must then agree too.  Sets of one size class
   share a cut, as do those near the border of two classes, which no link skips.
3. Groups: a document's head is the least document within two steps over joint tokens, and documents of
   one head are a group, cut into groups of at most about DOCS documents and SHINGLES shingles; the heads
   come along as queries to groups that they are not in.
4. Parity bitmaps, of one or two bits a shingle, bound from below how many shingles two sets differ in.  They
   alone go to the groups first, and only texts of pairs that may still be linked are moved to a group.  It
   holds the union of its members' shingles: a query whose overlap with the union is below t times its size
   can't be linked to a member and is not compared.  The others' pairs are intersected exactly.
5. Joint tokens that several components and several groups hold make queries to other groups, which go the
   same way; where their texts are more than there are documents, first those of a spanning forest of the
   likeliest links, then all that are left.

So no list of documents is expanded into pairs, no task's group grows with its class, texts move a bounded
number of times but for near misses, and no link between different components is lost.  Shingles are
compared by 64-bit hashes.

Defined results: texts that are null or hold no word have an empty set and are linked with nothing;
fewer than ``k`` words are one shingle; rows with one doc_id are one node, null doc_ids are linked with
nothing (component null); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.llm.shingles import NOMINATED_SCHEMA, OPENED_SCHEMA, SIGNATURE_SCHEMA, nominate, open_groups, sign
from triweave.llm.words import tidy
from triweave.operators.graph import connected_components
from triweave.plans.scratch import Scratch

#: Bounds of a group; queries that a group's copy answers; ranges of joint tokens handled one after the other; texts a document that go to other groups at once.
DOCS, SHINGLES, QUERIES, PASSES, MOVES = 2048, 1 << 20, 4096, 10, 1
#: Numbers of the filters that spare most rows a shuffle; a set that so large a share of all rows have is joined by broadcast.
BUCKETS, HOT = 1 << 20, 4096


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _near(rows: DataFrame, key: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` may be in ``keys``, or with left_anti those where it can't: by a filter of at most BUCKETS numbers."""
    buckets = keys.select(_bucket(key).alias("_bucket")).distinct()
    return rows.join(F.broadcast(buckets), _bucket(key) == F.col("_bucket"), how)


def _copies(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(set_key, b, c): sets of several rows, with their least document and number of rows; (a, b): the other documents of those."""
    rows = signed.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), "set_key")
    keys = scratch.table(rows.groupBy("set_key").agg(F.min("a").alias("b"), F.count("*").alias("c")).where("c > 1"))
    hot = F.col("c") * HOT >= signed.count()  # at most HOT sets
    marked = rows.join(F.broadcast(keys.where(hot).select("set_key", "b")), "set_key", "left")
    others = marked.where("b IS NULL").drop("b").join(keys.where(~hot).select("set_key", "b"), "set_key")
    return keys, marked.where("b IS NOT NULL").select("a", "b").unionByName(others.select("a", "b")).where("a <> b")


def _sets(signatures: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, n, sigs, bits): one row a set, under the least document that has it, whichever documents the tasks signed."""
    rows = signatures.where("bits IS NOT NULL")
    again = _near(rows, "set_key", keys).join(keys.select("set_key", "b"), "set_key", "left").withColumn("doc", F.coalesce("b", "doc_id"))
    again = scratch.table(again.dropDuplicates(["set_key"]).select("doc", "n", "sigs", "bits"))
    return _near(rows, "set_key", keys, "left_anti").select(F.col("doc_id").alias("doc"), "n", "sigs", "bits").unionByName(again)


def _held(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, doc) of joint tokens that several documents hold."""
    postings, parts = sets.where("size(sigs) > 0").select(F.explode("sigs").alias("sig"), "doc"), []
    for i in range(PASSES):  # by ranges of tokens, which bounds the disk that the shuffles take at once
        some = postings.where(F.pmod("sig", F.lit(PASSES)) == i)
        shared = scratch.table(some.groupBy("sig").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("c")).where("lo < hi"))
        scratch.release()
        longer = shared.where("c > 2").select("sig")
        parts.append(shared.where("c = 2").select("sig", F.explode(F.array("lo", "hi")).alias("doc")))
        parts.append(scratch.table(_near(some, "sig", longer).join(longer, "sig")).select("sig", "doc"))
        scratch.release()
    return scratch.table(functools.reduce(DataFrame.unionByName, parts))


def _heads(held: DataFrame, label: DataFrame | None, name: str) -> DataFrame:
    """(doc, name): the least label, or document, of those that share a joint token with a document."""
    rows = held.select("sig", "doc", F.col("doc").alias("label")) if label is None else held.join(label.toDF("doc", "label"), "doc")
    least = rows.groupBy("sig").agg(F.min("label").alias("label"))
    return held.join(least, "sig").groupBy("doc").agg(F.min("label").alias(name))


def _dealt(held: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, g, near, head): each document's group and the heads within one and two steps."""
    one = scratch.table(_heads(held, None, "near"))
    rows = scratch.table(one.join(_heads(held, one, "head"), "doc").join(sizes, "doc"))
    parts = F.ceil(F.greatest(F.col("c") / F.lit(DOCS), F.col("s") / F.lit(SHINGLES)))
    clusters = rows.groupBy("head", "near").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("parts", parts)
    whole = clusters.where("parts <= 1").groupBy("head").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).select("head", F.ceil(2 * F.greatest(F.col("c") / F.lit(DOCS), F.col("s") / F.lit(SHINGLES)) - 0.5).alias("bins"))
    places = scratch.table(clusters.select("head", "near", "parts").join(whole, "head", "left"))  # so a large cluster's join can be split
    own = F.xxhash64("head", "near", F.pmod(F.xxhash64("doc"), F.col("parts")))
    shared = F.xxhash64("head", F.pmod(F.xxhash64("near"), F.greatest("bins", F.lit(1))))
    return scratch.table(rows.join(places, ["head", "near"]).select("doc", F.when(F.col("parts") > 1, own).otherwise(shared).alias("g"), "near", "head"))


def _opened(named: DataFrame, texts: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the units in ``named`` (unit, side, doc_id, comp), whose texts alone are read and moved."""
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = named.join(_near(texts, "doc_id", named), "doc_id").repartition(n, "unit").sortWithinPartitions("unit", "side", "doc_id")
    links = scratch.table(full.select("unit", "side", "doc_id", "comp", "text").mapInArrow(tidy(open_groups(k, num, den)), OPENED_SCHEMA))
    scratch.release()
    return links


def _asked(held: DataFrame, dealt: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, side, doc_id): queries to groups with which a joint token is shared, of other components, and those groups.

    Joint tokens with one list of groups ask as one.
    """
    spans = scratch.table(held.join(dealt, "doc").groupBy("sig").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 < g2").select("sig"))
    place = dealt.join(components.toDF("doc", "component"), "doc", "left").select("doc", "g", F.coalesce("component", "doc").alias("comp"))
    mixed = scratch.table(_near(held, "sig", spans).join(spans, "sig").join(place, "doc"))
    groups = scratch.table(mixed.groupBy("sig", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    key, one, two = ["c", "x1", "x2"], F.xxhash64("g", "lo", "hi"), F.xxhash64(F.lit(1), "g", "lo", "hi")
    lists = scratch.table(groups.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2")))
    to = scratch.table(groups.join(lists, "sig").select(*key, F.col("g").alias("to"), "lo", "hi").distinct())
    whose = scratch.table(mixed.join(lists, "sig").select(*key, "doc", "g", "comp").distinct())
    asks = scratch.table(whose.join(to, key).where("g > to AND NOT (lo = hi AND lo = comp)").select("doc", "to").distinct())
    counts = scratch.table(asks.groupBy("to").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts")))
    unit = F.xxhash64("to", "part").alias("unit")
    queries = asks.join(counts, "to").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts"))).select(unit, F.lit(0).alias("side"), F.col("doc").alias("doc_id"))
    members = dealt.withColumnRenamed("g", "to").join(counts, "to").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return scratch.table(queries.unionByName(members.select(unit, F.lit(2).alias("side"), F.col("doc").alias("doc_id"))))


def _named(asked: DataFrame, components: DataFrame | None, bits: DataFrame, num: int, den: int, forest: bool, scratch: Scratch) -> DataFrame:
    """(unit, side, doc_id, comp): the rows of ``asked`` whose bitmaps allow a link between components, or a forest of them."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.withColumn("comp", F.col("doc_id"))
    if components is not None:
        rows = asked.join(components.toDF("doc_id", "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    rows = rows.join(bits, "doc_id")
    rows = rows.repartition(n, "unit").sortWithinPartitions("unit", "side", "doc_id").select("unit", "side", "doc_id", "comp", "n", "bits")
    return scratch.table(rows.mapInArrow(tidy(nominate(num, den, forest)), NOMINATED_SCHEMA).distinct())


def similar_groups(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); linked: intersection/union >= threshold."""
    num, den = threshold
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark, "ngram-join") as s:
        signatures = s.table(texts.mapInArrow(tidy(sign(k, num, den)), SIGNATURE_SCHEMA))
        signed = s.table(signatures.drop("sigs", "bits"))
        keys, equal = _copies(signed, s)
        equal = s.table(equal)
        sizes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.max("n").alias("n"))
        sets = _sets(signatures, keys, s)
        held = _held(sets, s)
        bits = s.table(_near(sets.select(F.col("doc").alias("doc_id"), "n", "bits"), "doc_id", held.select(F.col("doc").alias("doc_id"))))
        s.drop(signatures)  # the largest table; from here on only shared tokens count
        s.release()
        dealt = _dealt(held, sizes, s)
        own = dealt.select(F.col("g").alias("unit"), F.lit(1).alias("side"), F.col("doc").alias("doc_id"))
        heads = dealt.select(F.col("g").alias("unit"), F.explode(F.array("near", "head")).alias("doc_id")).distinct().join(own.drop("side"), ["unit", "doc_id"], "left_anti")
        rows = own.unionByName(heads.select("unit", F.lit(0).alias("side"), "doc_id"))
        links = _opened(_named(rows, None, bits, num, den, False, s), texts, k, num, den, s)
        components = s.table(connected_components(links.unionByName(equal), s))
        asked = _asked(held, dealt.select("doc", "g"), components, s)
        named = _named(asked, components, bits, num, den, False, s)
        many = named.count() > MOVES * dealt.count()  # then the likeliest links first, which leave fewer texts to move
        for forest in (True, False) if many else (False,):
            if many:
                named = _named(asked, components, bits, num, den, forest, s)
            links = _opened(named, texts, k, num, den, s)
            stars = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            components = s.table(connected_components(stars.unionByName(links), s))
        signed = signed.select("doc_id", F.col("n").alias("n_shingles"))
        known = signed.where("doc_id IS NOT NULL").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        known = known.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return s.keep(known.unionByName(signed.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents without those that an earlier one stands for, in order of doc_id, null last, and the
    text's hash; of rows with one doc_id and one text, the one whose other columns sort first as JSON stays, and
    other texts of that doc_id are other documents.  Columns may have any other names."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        gone = similar_groups(spark, docs, k, threshold).where("component_id < doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    with Scratch(spark, "one-of-each") as s:
        # 128 bits, so other texts of a doc_id are not taken for one
        doc_id, text = F.col("row.doc_id").cast("long"), F.col("row.text")
        keyed = docs.select(F.struct(*docs.columns).alias("row")).select(
            doc_id.isNull().alias("absent"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("h"), "row"
        )
        key = ["absent", "id", "h"]
        rows = s.table(keyed.groupBy(key).agg(F.min_by("row", F.to_json("row")).alias("row")))
        nodes = s.table(numbered(rows.select(key), key, "node", scratch=s))
        rows = s.table(rows.join(nodes, key).select("node", "row"))
        gone = similar_groups(spark, rows.select(F.col("node").alias("doc_id"), "row.text"), k, threshold).where("component_id < doc_id").select(F.col("doc_id").alias("node"))
        return s.keep(rows.join(gone, "node", "left_anti").select("row.*"))
