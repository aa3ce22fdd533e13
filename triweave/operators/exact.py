"""Sums of doubles that are exact and rounded once, so no order of rows, tasks or batches changes them.

A finite double is a whole number of units in few bins: bin k counts units of 2^(BITS k), and a double's digits in
PARTS neighbouring bins are whole numbers below 2^BITS.  Digits are summed as longs by group and bin, with partial
sums before the shuffle, and such sums may be added to those of other batches.  A group has at most some hundred bins,
whatever its rows; only there, one rounding gives the double.  Longs hold 2^43 rows a group.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from triweave.model import ModelError

BITS, LOWEST, PARTS = 20, -51, 4
#: Below the lowest bin's unit, the digits of the smallest doubles.
_UNIT = (PARTS - 1 - LOWEST) * BITS


def _parts(value: Column) -> tuple[Column, list[Column]]:
    """(top bin, the signed digits from it downwards), null for nulls, infinities and NaN."""
    x = value.cast("double")
    size = F.abs(x)
    power = lambda k: F.pow(F.lit(2.0), (k * BITS).cast("double"))  # noqa: E731 - exact for whole exponents
    near = F.floor(F.log2(size) / BITS)
    exact = F.when(size < power(near), near - 1).when(size >= power(near + 1), near + 1).otherwise(near)
    finite = x.isNotNull() & ~F.isnan(x) & (size < float("inf"))
    top = F.when(finite, F.greatest(F.coalesce(exact, F.lit(0)), F.lit(LOWEST)))
    scaled = size * power(-top)
    parts = [F.floor(scaled)] + [F.floor((scaled * float(1 << BITS * (j - 1)) % 1.0) * float(1 << BITS)) for j in range(1, PARTS)]
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return top, [sign * p for p in parts]


def digits(value: Column) -> Column:
    """array of (bin int, part long); nulls, infinities and NaN have none."""
    top, parts = _parts(value)
    rows = F.array(*(F.struct((top - j).cast("int").alias("bin"), p.alias("part")) for j, p in enumerate(parts)))
    return F.when(top.isNotNull(), F.filter(rows, lambda d: (d["part"] != 0) | (d["bin"] == top)))


def packed_sums(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, v, bin, part) as ``digit_sums``, but a group may have several rows of one bin: ``added`` makes them one.

    For groups of few rows and values of few magnitudes.  The digits of all values go through the shuffle side by side, in
    one row for each group and top bins, where ``digit_sums`` moves a row for each digit.
    """
    made = {f"_{i}": _parts(c) for i, c in enumerate(values.values())}
    named = rows.select(*keys, *(t.cast("int").alias(f"_top{i}") for i, (t, _) in made.items()), *(p.alias(f"_part{i}{j}") for i, (_, ps) in made.items() for j, p in enumerate(ps)))
    sums = [F.sum(f"_part{i}{j}").alias(f"_part{i}{j}") for i in made for j in range(PARTS)]
    packed = named.groupBy(*keys, *(f"_top{i}" for i in made)).agg(F.count("*").alias("_n"), *sums)
    cell = lambda v, bin, part: F.struct(F.lit(v).alias("v"), bin.cast("int").alias("bin"), part.cast("long").alias("part"))
    cells = [cell(-1, F.lit(0), F.col("_n"))] + [cell(v, F.col(f"_top{i}") - j, F.col(f"_part{i}{j}")) for v, i in enumerate(made) for j in range(PARTS)]
    kept = F.filter(F.array(*cells), lambda d: d["part"] != 0)
    return packed.select(*keys, F.explode(kept).alias("_d")).select(*keys, "_d.*")


def digit_sums(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, v, bin, part): the digits of each value summed by group; ``v`` is the value's place, -1 counts the rows."""
    count = F.array(F.struct(F.lit(-1).alias("v"), F.lit(0).alias("bin"), F.lit(1).cast("long").alias("part")))
    none = F.array().cast("array<struct<bin: int, part: bigint>>")
    named = lambda i: lambda d: F.struct(F.lit(i).alias("v"), d["bin"].alias("bin"), d["part"].alias("part"))
    each = [F.transform(F.coalesce(digits(c), none), named(i)) for i, c in enumerate(values.values())]
    return added(rows.select(*keys, F.explode(F.concat(count, *each)).alias("_d")).select(*keys, "_d.*"), keys)


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Digit sums of several batches as one."""
    return parts.groupBy(*keys, "v", "bin").agg(F.sum("part").alias("part"))


@F.pandas_udf(DoubleType())
def _rounded(of: pd.Series) -> pd.Series:
    def one(ds) -> float | None:
        total = sum(int(d["part"]) << (BITS * int(d["bin"]) + _UNIT) for d in ds)
        try:
            return total / (1 << _UNIT)  # of whole numbers, so rounded once
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return of.map(one)


def finished(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, names, n_rows) from digit sums; a sum beyond the doubles is infinite."""
    lists = [F.collect_list(F.when(F.col("v") == i, F.struct("bin", "part"))).alias(f"_v{i}") for i in range(len(names))]  # at most some hundred bins
    grouped = sums.groupBy(*keys).agg(*lists, F.sum(F.when(F.col("v") == -1, F.col("part"))).alias("n_rows"))
    return grouped.select(*keys, *(_rounded(f"_v{i}").alias(n) for i, n in enumerate(names)), "n_rows")


def exact_sums(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, values' names, n_rows): exact sums by group (of all rows, without keys); nulls and values that are not finite are left out."""
    return finished(digit_sums(rows, keys, values), keys, list(values))


def refuse_overflow(rows: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``rows``, or an error where a sum is beyond the doubles."""
    if not rows.where(reduce(lambda p, q: p | q, (F.abs(c) == float("inf") for c in columns))).isEmpty():
        raise ModelError("sum overflow", what)
    return rows
