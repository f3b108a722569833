"""Rows dealt by key over as many tasks as their number asks for. The bytes that a shuffle writes say little about what a
task holds of them afterwards: texts that repeat shrink tenfold, and tasks merged by those bytes hold millions of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of the long table that a task gets.
ROWS = 1 << 18


def tasks(spark: SparkSession, n_rows: int) -> int:
    """Tasks of about ``ROWS`` rows for ``n_rows`` rows, at least one to a core."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS))


def dealt(df: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """``df``, of ``n_rows`` rows, hashed by ``keys`` over so many tasks. A number asked for is not lowered afterwards."""
    return df.repartition(tasks(df.sparkSession, n_rows), *keys)
