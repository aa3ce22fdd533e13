"""Ten families of generated observations as column expressions of the row number: any size, in parallel, and again the same.

Every number is a counter-based draw: the first 52 bits of the MD5 of seed, stream and row number, as a part of one.  So rows
do not depend on partitions, tasks or each other.  ``shape`` sets the factors' numbers of levels for n rows: ``even`` (three
alike) or ``tall`` (one long, two short); ``weighting``: ``unit``, or ``spread`` over quarters from 0.25 to 16.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.model import ModelError

SHAPES = {"even": (0.02, 0.02, 0.02), "tall": (0.2, 0.01, 0.005)}


def draw(seed: int, stream: int, row: Column) -> Column:
    """A number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), row.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def below(u: Column, n: int) -> Column:
    """A whole number below n from a number in [0, 1)."""
    return F.floor(u * n).cast("long")


Draws = Callable[[int], Column]
Keys = tuple[Column, Column, Column]


def _uniform(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    return below(u(0), n[0]), below(u(1), n[1]), below(u(2), n[2])


def _chain(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Levels of like place, and in a twentieth of the rows the next one in one factor."""
    place, step = u(0), F.when(u(1) < 0.05, below(u(2), 3)).otherwise(-1)
    return tuple(F.pmod(below(place, m) + (step == q).cast("long"), F.lit(m)) for q, m in enumerate(n))


def _communities(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Blocks of levels, with few rows from one block to another."""
    blocks = max(2, min(n) // 8)
    home = below(u(0), blocks)
    return tuple(F.least(below((F.when(u(4 + q) < 0.02, below(u(7 + q), blocks)).otherwise(home) + u(1 + q)) / blocks, m), F.lit(m - 1)) for q, m in enumerate(n))


def _nested(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Each level of the first factor in one of the second, and that in one of the third."""
    first = below(u(0), n[0])
    second = first % n[1]
    return first, second, second % n[2]


def _pair_dominant(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """The third level mostly follows from the other two."""
    a, b = below(u(0), n[0]), below(u(1), n[1])
    return a, b, F.when(u(3) < 0.9, (a * 7 + b * 3) % n[2]).otherwise(below(u(2), n[2]))


def _ragged(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Levels' counts fall fast."""
    return tuple(below(F.pow(u(q), F.lit(4.0)), m) for q, m in enumerate(n))


def _worker_firm(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Workers stay with a firm but for a tenth of their rows; the third factor is time."""
    worker = below(u(0), n[0])
    return worker, F.when(u(3) < 0.9, worker * 31 % n[1]).otherwise(below(u(1), n[1])), below(u(2), n[2])


def _trade(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """Origins, destinations near them, and products that each origin has few of."""
    origin = below(u(0), n[0])
    return origin, F.pmod(origin + below(F.pow(u(1), F.lit(3.0)), n[1]), F.lit(n[1])), F.pmod(origin * 5 + below(u(2), max(1, n[2] // 4)), F.lit(n[2]))


def _hubs(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """A third of all rows at one level of each factor."""
    return tuple(F.when(u(3 + q) < 1 / 3, F.lit(0).cast("long")).otherwise(below(u(q), m)) for q, m in enumerate(n))


def _tensor(u: Draws, i: Column, n: tuple[int, int, int]) -> Keys:
    """All combinations in order of the row number, again from the start where they are used up."""
    return i % n[0], F.floor(i / n[0]).cast("long") % n[1], F.floor(i / (n[0] * n[1])).cast("long") % n[2]


FAMILIES = {
    "uniform": _uniform, "chain": _chain, "communities": _communities, "nested": _nested, "pair_dominant": _pair_dominant,
    "ragged": _ragged, "worker_firm": _worker_firm, "trade": _trade, "hubs": _hubs, "tensor": _tensor,
}


def recipe(spark: SparkSession, family: str, rows: int, shape: str = "even", weighting: str = "unit", seed: int = 1) -> DataFrame:
    """(row_id, k1, k2, k3, w, y): ``rows`` observations of a family; y is the sum of three effects of the levels and noise."""
    if family not in FAMILIES or shape not in SHAPES or weighting not in ("unit", "spread"):
        raise ModelError("unknown recipe", f"{family}, {shape}, {weighting}")
    i = F.col("row_id")
    n = tuple(max(2, int(rows * part)) for part in SHAPES[shape])
    u = lambda stream: draw(seed, stream, i)
    keys = dict(zip(("k1", "k2", "k3"), FAMILIES[family](u, i, n), strict=True))
    made = spark.range(rows).withColumnRenamed("id", "row_id").withColumns(keys)
    w = F.lit(1.0) if weighting == "unit" else (1 + below(u(20), 64)) / 4.0
    effects = F.col("k1") % 7 - F.col("k2") % 5 + F.col("k3") % 3
    return made.withColumns({"w": w, "y": effects + u(21) - 0.5})
