"""Tuples packed in blocks of arrays, for factors whose coefficients are too many for a broadcast: a product with the Gramian then
moves a block's levels and not its tuples.

Blocks are cut from the tuples in order of component and of the largest factor's levels, so a block has few levels beside its
tuples; a level with more tuples than a block is dealt over several.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triweave.functions.ranks import numbered
from triweave.operators.encode import CODES
from triweave.plans.scratch import Scratch

BLOCK_TUPLES, LEVELS_A_SUM = 300_000, 100_000
PACKED = "block long, la array<int>, lb array<int>, lc array<int>, ia binary, ib binary, ic binary, w binary"


def dealt_to_blocks(tuples: DataFrame, labels: DataFrame, largest: int, scratch: Scratch, block: int) -> DataFrame:
    """(block, a, b, c, w)."""
    code = CODES[largest]
    own = labels.where(F.col("q") == largest).select(F.col("l").alias(code), "component")
    sizes = scratch.table(tuples.groupBy(code).agg(F.count("*").alias("n")).join(own, code))
    placed = scratch.table(numbered(sizes, ["component", code], "place", scratch=scratch).withColumn("part", F.floor(F.col("place") / LEVELS_A_SUM)))
    before = placed.groupBy("part").agg(F.sum("n").alias("s"))  # a row for each 100,000 levels
    before = before.select("part", (F.sum("s").over(W.orderBy("part")) - F.col("s")).alias("base"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("place")) - F.col("n")
    starts = placed.withColumn("inside", inside).join(F.broadcast(before), "part").select(code, "n", (F.col("inside") + F.col("base")).alias("start"))
    others = [c for c in CODES if c != code]
    at = F.col("start") + F.pmod(F.xxhash64(*others), F.col("n"))
    return tuples.select(*CODES, "w").join(starts, code).select(F.floor(at / block).alias("block"), *CODES, "w")


def packed(frame: pd.DataFrame) -> pd.DataFrame:
    levels, codes = zip(*(np.unique(frame[c].to_numpy(), return_inverse=True) for c in CODES), strict=True)
    columns = {"block": [frame["block"].iloc[0]]} | {f"l{c}": [v.astype("int32")] for c, v in zip(CODES, levels, strict=True)}
    return pd.DataFrame(columns | {f"i{c}": [v.astype("int32").tobytes()] for c, v in zip(CODES, codes, strict=True)} | {"w": [frame["w"].to_numpy(float).tobytes()]})


def _product(k: int):
    names = [f"x{i}" for i in range(k)]

    def run(block: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        levels = [np.asarray(row[f"l{c}"]) for c in CODES]
        starts = np.concatenate(([0], np.cumsum([len(v) for v in levels])))
        codes, w = [np.frombuffer(row[f"i{c}"], "int32") for c in CODES], np.frombuffer(row["w"])
        place = starts[cells["q"].to_numpy()] + cells["at"].to_numpy()
        out = {"q": np.repeat(np.arange(3, dtype="int32"), np.diff(starts)), "l": np.concatenate(levels)}
        for name in names:
            x = np.zeros(starts[-1])
            x[place] = cells[name].to_numpy()
            v = w * sum(x[s : s + len(own)][i] for s, own, i in zip(starts, levels, codes, strict=False))
            out[name] = np.concatenate([np.bincount(i, v, len(own)) for i, own in zip(codes, levels, strict=True)])
        return pd.DataFrame(out)

    return run


class Blocks:
    """Products of the Gramian of ``tuples`` (a, b, c, w) with ``k`` columns; close it to drop its tables."""

    def __init__(self, tuples: DataFrame, labels: DataFrame, k: int, scratch: Scratch, counts: tuple[int, int, int], block: int = BLOCK_TUPLES):
        self.k, self.scratch, self.spark, self.names = k, scratch, tuples.sparkSession, []
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = dealt_to_blocks(tuples, labels, int(np.argmax(counts)), scratch, block).repartition(self.parts, "block")
        self.blocks = self._bucketed(rows.groupBy("block").applyInPandas(packed, PACKED), "block")
        levels = [self.blocks.select(F.lit(q).alias("q"), "block", F.posexplode(f"l{c}").alias("at", "l")) for q, c in enumerate(CODES)]
        self.members = self._bucketed(reduce(DataFrame.unionByName, levels).repartition(self.parts, "q", "l"), "q", "l")

    def _bucketed(self, rows: DataFrame, *key: str) -> DataFrame:
        name = f"blocks_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.parts, *key).option("path", f"{self.scratch.root}/scratch/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def table(self, rows: DataFrame) -> DataFrame:
        """Rows of levels, with q and l, as a table that a product and a join with its result read without a shuffle."""
        return self._bucketed(rows, "q", "l")

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def gramian(self, x: DataFrame) -> DataFrame:
        """B'WB x as (q, l, x)."""
        names = [f"x{i}" for i in range(self.k)]
        own = x.select(F.col("q").cast("int").alias("q"), F.col("l").cast("int").alias("l"), *(F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)))
        cells = self.members.join(own, ["q", "l"]).select("block", "q", "at", *names)
        made = self.blocks.groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(_product(self.k), "q int, l int, " + ", ".join(f"{n} double" for n in names))
        return made.groupBy("q", "l").agg(F.array(*(F.sum(n) for n in names)).alias("x"))
