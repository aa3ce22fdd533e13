"""Tables written to the folder that all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="triweave-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get()
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a result that ``Scratch.keep`` left, once it is used up."""
    kept = {f.rsplit("/", 2)[0] for f in df.inputFiles()}
    root = shared_dir(df.sparkSession).rsplit("/", 1)[1]
    for folder in kept:
        if f"/{root}/" in folder:
            delete(df.sparkSession, folder)


#: Rows of an Arrow batch within a run; texts may be long, so fewer than Spark's default.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: A join whose smaller side has at most so much in every partition hashes it instead of sorting both sides.
HASH_JOINS, HASH_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"


class Scratch:
    """A folder for one run of an operator: ``table`` for intermediates, ``keep`` for what outlives the run.

    >>> with Scratch(spark, "op") as s:
    ...     a = s.table(df)      # written, read back, deleted at the end
    ...     return s.keep(a)     # written and left in place

    ``numbers``: the run's rows are a few numbers each, as levels and tuples are, so its joins hash small sides and its Arrow
    batches are long.
    """

    def __init__(self, spark: SparkSession, name: str, numbers: bool = False):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: weakref.WeakSet[DataFrame] = weakref.WeakSet()
        self.settings = {ARROW_ROWS: str(50 * BATCH_ROWS), HASH_JOINS: HASH_BYTES} if numbers else {ARROW_ROWS: str(BATCH_ROWS)}

    def __enter__(self) -> Scratch:
        self.before = {k: self.spark.conf.get(k) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.set(k, v)
        delete(self.spark, f"{self.root}/scratch")

    def _write(self, df: DataFrame, path: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; a table of this run as it is."""
        if df in self.tables:
            return df
        self.count += 1
        return self.given(self._write(df, f"{self.root}/scratch/{self.count}", compression="zstd"))

    def given(self, df: DataFrame) -> DataFrame:
        """``df``, which reads a table already, so ``table`` need not write it."""
        self.tables.add(df)
        return df

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self._write(df, f"{self.root}/{name}", compression="zstd")

    def release(self) -> None:
        """Lets go of finished steps: Spark deletes shuffle files once their handles are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this run before its end."""
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{self.root.rsplit('/', 1)[1]}/scratch/" in f:
                delete(self.spark, f)
