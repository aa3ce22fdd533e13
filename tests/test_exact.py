"""Exact sums against whole-number arithmetic, on doubles of all sizes."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from triweave.model import ModelError
from triweave.operators.exact import added, digit_sums, digits, exact_sums, finished, refuse_overflow


def some_doubles(rng, n):
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0**20, 2.0**-20, 2.0**1020, 1e16, 1.0, 2.0**-1020, 1 - 2.0**-53]
    while len(out) < n:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            out.append(x)
    return out


def test_digits_make_up_the_double(spark):
    rng = random.Random(1)
    xs = some_doubles(rng, 600) + [2.0**k for k in range(-1074, 1024, 7)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 20)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", digits(F.col("x")).alias("d")).collect()
    for r in rows:
        assert sum(Fraction(d.part) * Fraction(2) ** (20 * d.bin) for d in r.d) == Fraction(r.x)


def test_exact_sums_are_rounded_once_in_any_order(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([1.0, -1.0]) * rng.random() * 2.0 ** rng.randrange(-80, 80)) for g in range(5) for _ in range(200)]
    rows += [(9, 1e16), (9, 1.0), (9, 1.0), (10, 1e300), (10, 1.0), (10, -1e300), (11, None), (11, float("nan")), (12, -0.0), (13, 5e-324), (13, 5e-324)]
    want = {g: math.fsum(x for k, x in rows if k == g and x is not None and not math.isnan(x)) for g, _ in rows}
    assert want[9] == 10000000000000002.0
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "g int, x double").repartition(parts)
        got = {r.g: (r.s, r.n_rows) for r in exact_sums(frame, ["g"], {"s": F.col("x")}).collect()}
        assert got == {g: (s, sum(1 for k, _ in rows if k == g)) for g, s in want.items()}
        rng.shuffle(rows)


def test_batches_add_up_and_overflow_is_refused(spark):
    one = spark.createDataFrame([(1, 1e16, 2.0), (1, 1.0, 2.0)], "g int, x double, y double")
    two = spark.createDataFrame([(1, 1.0, 2.0), (2, -3.5, None)], "g int, x double, y double")
    values = {"x": F.col("x"), "y": F.col("y")}
    sums = [digit_sums(b, ["g"], values) for b in (one, two)]
    got = {r.g: (r.x, r.y, r.n_rows) for r in finished(added(sums[0].unionByName(sums[1]), ["g"]), ["g"], ["x", "y"]).collect()}
    assert got == {1: (1e16 + 2, 6.0, 3), 2: (-3.5, 0.0, 1)}
    large = spark.createDataFrame([(1, 1.7e308, 1.0), (1, 1.7e308, 1.0)], "g int, x double, y double")
    with pytest.raises(ModelError, match="overflow"):
        refuse_overflow(exact_sums(large, ["g"], values), ["x", "y"], "weights")
    assert exact_sums(large, [], values).first().y == 2.0
    assert exact_sums(large.where("false"), ["g"], values).count() == 0
