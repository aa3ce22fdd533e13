"""Incremental collapse: a stream of weighted keys kept as sums by tuple, in update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_collapse(stream: DataFrame, factors: tuple[str, str, str], weight: str | None = None) -> DataFrame:
    """(factors, w, n_obs) for ``writeStream.outputMode("update")``; the state has one row for each tuple."""
    w = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    return stream.groupBy(*factors).agg(w.alias("w"), F.count("*").alias("n_obs"))
