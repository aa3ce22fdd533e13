"""Takes the effects of three categorical factors out of measures of a table's rows, as one weighted least squares fit a measure.

    python -m jobs.residualize --input DIR_OR_FILE --output DIR [--config jobs/residualize.json] [--format parquet]

The shipped config measures texts: word length and variety of words, less what source, language and size class
explain, each document weighing its words.  A config names SQL expressions over the input's columns: ``let`` (names that later
ones may use), ``where``, three ``factors``, a positive ``weight``, up to 32 ``targets``, and the factor that parts the output.

Output, all Parquet, replaced as a whole, so a rerun leaves the same files' rows:
  rows/     row_id, the factors, the weight, and for each target its value, ``_fitted`` and ``_residual``; a folder a level of ``partition_by``
  effects/  target, factor, level, effect, degree: the coefficients, orthogonal to what no data can tell; a folder a target
  report/   target, routes, ratio (of the normal equations' residual), accepted
Rows that ``where`` leaves out, and rows with a weight or target that is null, take no part and are counted in the log.
A fit that is not certified to ``accept`` is an error, and nothing is written.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.model import Design
from triweave.operators import components, encode, linear
from triweave.plans import solve
from triweave.plans.scratch import Scratch

LOG = logging.getLogger("jobs.residualize")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "residualize.json")


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if len(config["factors"]) != 3 or not 1 <= len(config["targets"]) <= solve.MOST_TARGETS or config["partition_by"] not in config["factors"]:
        raise ValueError("a config has three factors, 1 to 32 targets, and parts its output by a factor")
    return config


def observations(table: DataFrame, config: dict) -> DataFrame:
    """(row_id, k0, k1, k2, w, y0, y1, ...) of the rows that take part."""
    rows = table
    for name, expression in config.get("let", {}).items():
        rows = rows.withColumn(name, F.expr(expression))
    rows = rows.where(config.get("where", "true"))
    names = [F.expr(config["row_id"]).alias("row_id"), *(F.expr(e).alias(f"k{i}") for i, e in enumerate(config["factors"].values())), F.expr(config["weight"]).cast("double").alias("w")]
    rows = rows.select(*names, *(F.expr(e).cast("double").alias(f"y{i}") for i, e in enumerate(config["targets"].values())))
    return rows.dropna(subset=["w", *(f"y{i}" for i in range(len(config["targets"])))])


def collapsed(topology: encode.Topology, n: int) -> DataFrame:
    """(tid, a, b, c, w, y0, ...): each tuple's weight and weighted mean targets."""
    sums = [F.sum(F.col("w") * F.col(f"y{i}")).alias(f"wy{i}") for i in range(n)]
    rows = topology.observations.groupBy("tid", "a", "b", "c").agg(F.sum("w").alias("w"), *sums)
    return rows.select("tid", "a", "b", "c", "w", *((F.col(f"wy{i}") / F.col("w")).alias(f"y{i}") for i in range(n)))


def residualize(spark: SparkSession, source: str, output: str, config: dict, form: str = "parquet") -> dict[str, int]:
    """Runs the job; returns how many rows it read, used and wrote."""
    targets, factors = list(config["targets"]), list(config["factors"])
    columns = [f"y{i}" for i in range(len(targets))]
    table = spark.read.format(form).load(source)
    design = Design(("k0", "k1", "k2"), "w", tuple(columns), "row_id")
    with Scratch(spark, "residualize") as s:
        obs = s.table(observations(table, config))  # texts are read once
        read, used = table.count(), obs.count()
        LOG.info("read %d rows of %s, %d take part", read, source, used)
        encode.validate_observations(obs, design)
        topology = encode.encode(obs, design, used)
        topology.observations = s.table(topology.observations)
        t = s.table(collapsed(topology, len(targets)))
        labels = s.table(components.component_labels(t, s))
        coefficients, report = solve.fit(t, labels, columns, s, accept=config.get("accept", 1e-8))
        report = s.table(report)
        refused = [targets[r.k] for r in report.where("NOT coalesce(accepted, false)").collect()]  # at most 32
        if refused:
            raise RuntimeError(f"not certified: {', '.join(refused)}")
        name_of = lambda k, names: F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)
        fitted = t.select("tid", "a", "b", "c")
        for k in range(len(targets)):
            fitted = linear.incidence(fitted, coefficients.where(F.col("k") == k).select("q", "l", "x"), name=f"f{k}")
        rows = topology.observations.join(fitted.drop("a", "b", "c"), "tid")
        each = [c for k, name in enumerate(targets) for c in (F.col(f"y{k}").alias(name), F.col(f"f{k}").alias(f"{name}_fitted"), (F.col(f"y{k}") - F.col(f"f{k}")).alias(f"{name}_residual"))]
        rows = rows.select("row_id", *(F.col(f"k{i}").alias(name) for i, name in enumerate(factors)), F.col("w").alias("weight"), *each)
        part = config["partition_by"]
        rows.repartition(part, F.pmod(F.xxhash64("row_id"), F.lit(_files(spark)))).write.mode("overwrite").partitionBy(part).parquet(f"{output}/rows")  # a hot level in several tasks and files
        effects = coefficients.join(linear.degrees(t, "degree"), ["q", "l"]).join(topology.levels, ["q", "l"])
        effects = effects.select(name_of("k", targets).alias("target"), name_of("q", factors).alias("factor"), F.col("key").alias("level"), F.col("x").alias("effect"), "degree")
        effects.write.mode("overwrite").partitionBy("target").parquet(f"{output}/effects")
        report.select(name_of("k", targets).alias("target"), "routes", "ratio", "accepted").coalesce(1).write.mode("overwrite").parquet(f"{output}/report")
    written = spark.read.parquet(f"{output}/rows").count()
    LOG.info("wrote %d rows to %s/rows", written, output)
    return {"read": read, "used": used, "written": written}


def _files(spark: SparkSession) -> int:
    """Files a level of the output has at most."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=CONFIG)
    parser.add_argument("--format", default="parquet", choices=("parquet", "orc", "json", "csv"))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("residualize").getOrCreate()
    try:
        residualize(spark, args.input, args.output, read_config(args.config), args.format)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
