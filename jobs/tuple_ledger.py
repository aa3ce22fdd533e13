"""Keeps weighted sums of three-factor tuples up to date as files of observations arrive, without reading old files again.

    python -m jobs.tuple_ledger --input DIR_OR_GLOB --output DIR [--config jobs/tuple_ledger.json] [--format parquet]

A file stream takes the files that are new since the last run (its checkpoint is output/checkpoint) in batches.  Each batch
becomes exact digit sums by tuple in ledger/batch=N, which a batch that runs again writes over.  Then those partitions of
current/ for which the ledger holds a later batch than they do are summed anew and replaced; each of their rows names that
batch in ``through_batch``, the high-water mark, so a run that broke off between the two steps is made good by the next.
The sums do not depend on how rows are dealt to files, batches or runs.

A config names SQL expressions over the input's columns: three ``keys``, one ``partition_by`` that is coarse enough for a folder
a value, ``weight``, ``targets``, and how many files a batch takes.  Tuples of current/: the keys, ``n_rows``, ``weight`` (the sum),
for each target ``w_<target>``, the sum of weight times target, and ``through_batch``; a folder a partition.
Rows with a null key or partition, a weight that is not positive and finite, or a target that is not finite go to
rejected/batch=N, with their columns.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.operators.exact import added, finished, packed_sums, refuse_overflow
from triweave.plans.scratch import Scratch

LOG = logging.getLogger("jobs.tuple_ledger")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tuple_ledger.json")


def read_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if len(config["keys"]) != 3 or len(config["partition_by"]) != 1 or not config["targets"]:
        raise ValueError("a config has three keys, one partition and at least one target")
    return config


def _named(rows: DataFrame, config: dict) -> tuple[DataFrame, list[str]]:
    """``rows`` with the config's columns as _k..., _p, _w and _y..., and ``_good``."""
    keys = [f"_k{i}" for i in range(3)]
    made = dict(zip([*keys, "_p"], [*config["keys"].values(), *config["partition_by"].values()], strict=True))
    rows = rows.withColumns({c: F.expr(e) for c, e in made.items()} | {"_w": F.expr(config["weight"]).cast("double")} | {f"_y{i}": F.expr(e).cast("double") for i, e in enumerate(config["targets"].values())})
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = [F.col(c).isNotNull() for c in (*keys, "_p")] + [finite("_w") & (F.col("_w") > 0)] + [finite(f"_y{i}") for i in range(len(config["targets"]))]
    return rows.withColumn("_good", reduce(lambda p, q: p & q, good)), list(made)


def add_batch(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Writes one batch's digit sums and its rejected rows; the same files if it runs again."""
    columns = batch.columns
    rows, keys = _named(batch, config)
    values = {"_w": F.col("_w")} | {f"_wy{i}": F.col("_w") * F.col(f"_y{i}") for i in range(len(config["targets"]))}
    packed_sums(rows.where("_good"), keys, values).write.mode("overwrite").parquet(f"{output}/ledger/batch={number}")
    rows.where("NOT _good").select(columns).write.mode("overwrite").parquet(f"{output}/rejected/batch={number}")


def take_new(spark: SparkSession, source: str, output: str, config: dict, form: str = "parquet") -> int:
    """Streams the new files into the ledger; returns the rows taken."""
    schema = spark.read.format(form).load(source).schema
    stream = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", config.get("files_per_batch", 1000)).load(source)
    numbers: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, output, config)
        numbers.append(number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    taken = 0
    for number in numbers:
        good = spark.read.parquet(f"{output}/ledger/batch={number}").where("v = -1").agg(F.sum("part")).first()[0] or 0
        bad = spark.read.parquet(f"{output}/rejected/batch={number}").count()
        LOG.info("batch %d: %d rows taken, %d rejected", number, good, bad)
        taken += good + bad
    return taken


def _found(read) -> DataFrame | None:
    """The table, or None before its first write."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _tuples(sums: DataFrame, config: dict) -> DataFrame:
    """Digit sums (_k0, _k1, _k2, _p, through_batch, v, bin, part) as rows of current/."""
    targets, (part,) = list(config["targets"]), config["partition_by"]
    keys, names = ["_k0", "_k1", "_k2", "_p", "through_batch"], ["weight", *(f"w_{t}" for t in targets)]
    rows = finished(sums, keys, names).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(config["keys"])} | {"_p": part})
    return rows.select(*config["keys"], "n_rows", *names, "through_batch", part)


def bring_up(spark: SparkSession, output: str, config: dict) -> int:
    """Sums those partitions anew for which the ledger holds a batch after their mark in current/; returns the tuples written."""
    ledger = _found(lambda: spark.read.parquet(f"{output}/ledger"))
    if ledger is None:
        return 0
    (part,) = config["partition_by"]
    with Scratch(spark, "ledger") as s:
        newest = ledger.groupBy("_p").agg(F.max("batch").alias("through_batch"))
        current = read_current(spark, output, config)
        if current is not None:
            marks = current.groupBy(F.col(part).alias("_p")).agg(F.max("through_batch").alias("mark"))
            newest = newest.join(marks, "_p", "left").where("mark IS NULL OR through_batch > mark").drop("mark")
        newest = s.table(newest)  # a row a folder, and current/ is not read while it is written
        keys = ["_k0", "_k1", "_k2", "_p", "through_batch"]
        sums = added(ledger.join(F.broadcast(newest), "_p").repartition(*keys), keys)  # dealt once by tuple, for both groupings
        rows = s.table(_tuples(sums, config))
        n = rows.count()
        if n:
            names = ["weight", *(f"w_{t}" for t in config["targets"])]
            refuse_overflow(rows, names, "tuples")
            spread = F.pmod(F.xxhash64(*config["keys"]), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
            rows.repartition(part, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{output}/current")
        LOG.info("wrote %d tuples of %d partitions to %s/current", n, newest.count(), output)
        return n


def read_current(spark: SparkSession, output: str, config: dict) -> DataFrame | None:
    """The tuples as they stand; None before the first run that took rows."""
    ledger = _found(lambda: spark.read.parquet(f"{output}/ledger"))
    if ledger is None:
        return None
    schema = _tuples(ledger.withColumnRenamed("batch", "through_batch"), config).schema
    return _found(lambda: spark.read.schema(schema).parquet(f"{output}/current"))


def update_ledger(spark: SparkSession, source: str, output: str, config: dict, form: str = "parquet") -> dict[str, int]:
    """Runs the job; returns how many rows it took and how many tuples it wrote."""
    taken = take_new(spark, source, output, config, form)
    LOG.info("took %d new rows of %s", taken, source)
    return {"taken": taken, "written": bring_up(spark, output, config)}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=CONFIG)
    parser.add_argument("--format", default="parquet", choices=("parquet", "orc", "json", "csv"))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("tuple-ledger").getOrCreate()
    try:
        update_ledger(spark, args.input, args.output, read_config(args.config), args.format)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
