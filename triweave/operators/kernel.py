"""Exact rank and nullity of B for components of any size: peeling on tables, elimination of the bounded rest.

A level that only one tuple has makes that tuple's row independent of all others: the tuple leaves with it, the rank grows by
one, and other levels may now have one tuple.  A round is one group-by and one join.  What no level determines any more,
a component's core, is eliminated exactly in a task; a core over CORE tuples is refused rather than taken for floats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.local.kernel import kernel_certificate
from triweave.local.problem import Local
from triweave.model import ModelError
from triweave.operators.encode import CODES
from triweave.operators.linear import edges
from triweave.plans.scratch import Scratch

CORE = 20_000


def peeled(tuples: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(core, gone): the tuples of which each level has two at least, and those that some round took away; both (tid, a, b, c, component)."""
    rest, rounds = scratch.table(tuples.select("tid", *CODES, "component")), []
    while True:
        alone = edges(rest, "tid").groupBy("q", "l").agg(F.min("tid").alias("tid"), F.count("*").alias("n")).where("n = 1").select("tid").distinct()
        alone = scratch.table(alone)
        if alone.isEmpty():
            gone = rounds[0] if rounds else rest.where("false")
            for more in rounds[1:]:
                gone = gone.unionByName(more)
            return rest, gone
        rounds.append(scratch.table(rest.join(alone, "tid")))
        before, rest = rest, scratch.table(rest.join(alone, "tid", "left_anti"))
        scratch.drop(before)


def _core_rank(frame: pd.DataFrame) -> pd.DataFrame:
    codes = np.column_stack([np.unique(frame[c], return_inverse=True)[1] for c in CODES])
    rank = sum(c["rank"] for c in kernel_certificate(Local(codes, np.ones(len(codes)))))
    return pd.DataFrame({"component": [frame["component"].iloc[0]], "rank": [rank]}).astype({"component": "int32"})


def rank_nullity(tuples: DataFrame, labels: DataFrame, scratch: Scratch, core: int = CORE) -> DataFrame:
    """(component, rank, nullity, structural) for tuples (tid, a, b, c) and labels (q, l, component): structural where nothing
    but the two shifts between factors is in the kernel."""
    own = tuples.join(labels.where("q = 0").select(F.col("l").alias("a"), "component"), "a")
    rest, gone = peeled(own, scratch)
    largest = rest.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > core:
        raise ModelError("core too large", f"{largest} tuples, over {core}")
    ranks = rest.groupBy("component").applyInPandas(_core_rank, "component int, rank long")
    ranks = ranks.unionByName(gone.groupBy("component").agg(F.count("*").alias("rank"))).groupBy("component").agg(F.sum("rank").alias("rank"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("v"))
    return sizes.join(ranks, "component").select("component", "rank", (F.col("v") - F.col("rank")).alias("nullity"), (F.col("v") - F.col("rank") == 2).alias("structural"))
