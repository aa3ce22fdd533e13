"""Generated observations: the same rows however they are dealt, and each family's own mark."""

import hashlib

import pytest
from pyspark.sql import functions as F

from triweave.model import Design, ModelError
from triweave.operators import encode
from triweave.sources import recipes


def test_recipes_do_not_depend_on_partitions(spark):
    for family in recipes.FAMILIES:
        frames = [recipes.recipe(s, family, 600, shape, "spread", seed=4) for s, shape in ((spark, "even"), (spark, "tall"))]
        for frame in frames:
            rows = sorted(map(tuple, frame.collect()))
            assert rows == sorted(map(tuple, frame.repartition(7).collect())) and len(rows) == 600
            assert all(k is not None and k >= 0 for r in rows for k in r[1:4]) and all(0.25 <= r[4] <= 16 for r in rows)
            encode.validate_observations(frame, Design(("k1", "k2", "k3")))
    with pytest.raises(ModelError):
        recipes.recipe(spark, "none", 10)


def test_draws_are_the_digest_and_families_keep_their_mark(spark):
    got = {r.row_id: r.u for r in spark.range(50).select(F.col("id").alias("row_id"), recipes.draw(9, 2, F.col("id")).alias("u")).collect()}
    assert got == {i: int(hashlib.md5(f"9:2:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(50)}
    made = {f: recipes.recipe(spark, f, 3000).cache() for f in ("nested", "hubs", "tensor", "ragged")}
    assert made["nested"].groupBy("k1").agg(F.count_distinct("k2").alias("n")).agg(F.max("n")).first()[0] == 1
    assert 0.25 < made["hubs"].where("k2 = 0").count() / 3000 < 0.45
    assert made["tensor"].select("k1", "k2", "k3").distinct().count() == 3000
    counts = [r["count"] for r in made["ragged"].groupBy("k1").count().orderBy(F.desc("count")).collect()]
    assert counts[0] > 10 * counts[-1]
