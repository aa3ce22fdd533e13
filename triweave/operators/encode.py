"""From observations to coded, collapsed tuples and weight frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.functions.ranks import ONE_TASK_ROWS, numbered, range_parts
from triweave.model import Design, Frame, ModelError, Topology
from triweave.operators.exact import exact_sums
from triweave.plans.scratch import Scratch

CODES = ("a", "b", "c")


def validate_observations(obs: DataFrame, design: Design) -> None:
    """Refuses an empty table, null keys, weights that are not positive and finite, targets that are not finite."""
    bad_key = reduce(lambda x, y: x | y, (F.col(k).isNull() for k in design.factors))
    checks = [F.count("*").alias("n"), F.sum(bad_key.cast("long")).alias("keys")]
    if design.weight:
        w = F.col(design.weight).cast("double")
        checks.append(F.sum((w.isNull() | F.isnan(w) | (w <= 0) | (w == float("inf"))).cast("long")).alias("weights"))
    for i, t in enumerate(design.targets):
        y = F.col(t).cast("double")
        checks.append(F.sum((y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).cast("long")).alias(f"target{i}"))
    row = obs.agg(*checks).first().asDict()
    if not row.pop("n"):
        raise ModelError("empty problem")
    for name, count in row.items():
        if count:
            raise ModelError(f"invalid {name}", f"{count} rows")


def level_codes(obs: DataFrame, factors: tuple[str, ...], bound: int | None = None) -> list[DataFrame]:
    """For each factor (key, code): dense codes in key order."""
    out = []
    for factor, code in zip(factors, CODES, strict=True):
        keys = obs.select(F.col(factor).alias(f"key_{code}")).distinct()
        out.append(numbered(keys, [f"key_{code}"], code, bound).withColumn(code, F.col(code).cast("int")))
    return out


def encode(obs: DataFrame, design: Design, bound: int | None = None, check: bool = False) -> Topology:
    """Level dictionaries, unique tuples in lexicographic order and each observation's tuple.

    ``bound``: a known upper bound of the number of observations, which saves counting.
    """
    if check:
        validate_observations(obs, design)
    obs = written(obs, bound)
    codes = level_codes(obs, design.factors, bound)
    coded = written(with_codes(obs, design, codes), bound)
    tuples = numbered(coded.select(*CODES).distinct(), list(CODES), "tid", bound).select("tid", *CODES)
    observations = coded.join(tuples, list(CODES))
    levels = reduce(DataFrame.unionByName, (t.select(F.lit(q).cast("int").alias("q"), F.col(c).alias("l"), F.col(f"key_{c}").cast("string").alias("key")) for q, (c, t) in enumerate(zip(CODES, codes, strict=True))))
    return Topology(design, levels, tuples, observations)


def written(rows: DataFrame, bound: int | None) -> DataFrame:
    """``rows``, as a table that stays with the result where there may be many: they are used several times."""
    return Scratch(rows.sparkSession, "observations").keep(rows) if bound is not None and bound > ONE_TASK_ROWS else rows


def with_codes(obs: DataFrame, design: Design, codes: list[DataFrame]) -> DataFrame:
    """The observations with codes a, b, c from the factors' dictionaries, which go by broadcast if they are small."""
    for factor, code, table in zip(design.factors, CODES, codes, strict=True):
        obs = obs.join(table.withColumnRenamed(f"key_{code}", factor), factor)
    return obs


def coded_observations(obs: DataFrame, design: Design, bound: int | None = None) -> DataFrame:
    """The observations with codes a, b, c."""
    obs = written(obs, bound)
    return with_codes(obs, design, level_codes(obs, design.factors, bound))


def collapse(coded: DataFrame, weight: str | None, extra: dict | None = None) -> DataFrame:
    """(a, b, c, w, n_obs): duplicates summed before the shuffle, and once more after it.  ``extra``: further aggregates."""
    w = F.sum(F.col(weight)) if weight else F.count("*").cast("double")
    return coded.groupBy(*CODES).agg(w.alias("w"), F.count("*").alias("n_obs"), *(v.alias(k) for k, v in (extra or {}).items()))


def exact_collapse(coded: DataFrame, weight: str) -> DataFrame:
    """(a, b, c, w, n_obs): as ``collapse``, with each tuple's weights summed exactly and rounded once."""
    return exact_sums(coded, list(CODES), {"w": F.col(weight)}).withColumnRenamed("n_rows", "n_obs")


def canonical_tuples(collapsed: DataFrame, bound: int | None = None, dealt: bool = False) -> DataFrame:
    """Tuples with ``tid``, their rank in lexicographic order; ``dealt``: of observations that ``dealt_by_tuple`` dealt."""
    return numbered(collapsed, list(CODES), "tid", bound, dealt=dealt)


def mostly_distinct(rows: DataFrame, factors: tuple[str, ...]) -> bool:
    """Whether summing before a shuffle would leave more than half of the rows."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*factors))).first()
    return 2 * distinct > n


def dealt_by_tuple(coded: DataFrame, bound: int) -> DataFrame:
    """Coded observations in tasks of ascending tuples: the sums by tuple and the tuples' numbers then need no shuffle of their own."""
    return coded.repartitionByRange(range_parts(coded.sparkSession, bound), *CODES)


def check_canonical(tuples: DataFrame) -> None:
    """Refuses repeated tuples and tids that are not their ranks' order."""
    twice = tuples.groupBy(*CODES).count().where("count > 1")
    if not twice.isEmpty():
        raise ModelError("tuples not canonical", "repeated")
    first = tuples.select(F.struct(*CODES).alias("t"), F.col("tid").alias("i"))
    steps = tuples.select(F.struct(*CODES).alias("t2"), (F.col("tid") - 1).alias("i"))
    if not first.join(steps, "i").where("t2 <= t").isEmpty():
        raise ModelError("tuples not canonical", "out of order")


def check_levels(tuples: DataFrame, counts: tuple[int, int, int]) -> None:
    """Refuses codes out of range and levels that no tuple uses."""
    row = tuples.agg(*(f(c).alias(f"{n}_{c}") for c in CODES for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct)))).first()
    for code, count in zip(CODES, counts, strict=True):
        if row[f"lo_{code}"] is None:
            raise ModelError("empty problem")
        if row[f"lo_{code}"] < 0 or row[f"hi_{code}"] >= count:
            raise ModelError("tuple out of bounds", code)
        if row[f"n_{code}"] != count:
            raise ModelError("unused level", code)


def weight_frame(topology: Topology, kind: str, values: DataFrame | str | None = None) -> Frame:
    """Weights of the tuples from ``observations`` (row_id, w) or one of their columns, ``tuples`` (tid, w),
    ``unit_observations`` or ``unit_tuples``."""
    row_id = topology.design.row_id or "row_id"
    if kind == "observations" and isinstance(values, str):
        w = topology.observations.groupBy("tid").agg(F.sum(values).alias("w"))
    elif kind == "observations":
        w = topology.obs_map.join(values, row_id).groupBy("tid").agg(F.sum("w").alias("w"))
    elif kind == "tuples":
        w = values.select("tid", "w")
    elif kind == "unit_observations":
        w = topology.obs_map.groupBy("tid").agg(F.count("*").cast("double").alias("w"))
    elif kind == "unit_tuples":
        return Frame(topology, topology.tuples.withColumn("w", F.lit(1.0)))
    else:
        raise ModelError("unknown weight input", kind)
    return Frame(topology, topology.tuples.join(w, "tid"))


def scatter_to_observations(topology: Topology, values: DataFrame) -> DataFrame:
    """(row_id, values' columns): each tuple's values on its observations."""
    return topology.obs_map.join(values, "tid").drop("tid")


def group_offsets(obs_map: DataFrame, bound: int | None = None) -> DataFrame:
    """(tid, n, start): how many observations a tuple has and where its group starts in order of tid."""
    from pyspark.sql import Window as W

    sizes = obs_map.groupBy("tid").agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("block", F.floor(F.col("tid") / 100_000))
    before = blocks.groupBy("block").agg(F.sum("n").alias("s"))  # a row for each 100,000 tuples
    before = before.select("block", (F.sum("s").over(W.orderBy("block")) - F.col("s")).alias("base"))
    inside = F.sum("n").over(W.partitionBy("block").orderBy("tid")) - F.col("n")
    return blocks.withColumn("inside", inside).join(before, "block").select("tid", "n", (F.col("inside") + F.col("base")).alias("start"))
