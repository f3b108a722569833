"""The verdict over mandatory checks, and the checks that compare what was offered with what
is stored and exported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.contract import INPUTS, Tables
from tickweave.functions.scalars import differs


def check(name: str, findings: DataFrame) -> DataFrame:
    """One mandatory check: passed when there is no finding."""
    return findings.agg(F.count(F.lit(1)).alias("n_findings")).select(F.lit(name).alias("name"), (F.col("n_findings") == 0).alias("passed"), "n_findings")


def checks(named: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(n, f) for n, f in named.items()])


def verdict(results: DataFrame, expected: int) -> DataFrame:
    """Ok only if every check passed and the expected number of checks ran."""
    counted = results.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"))
    return counted.select("n_checks", "n_passed", ((F.col("n_checks") == F.col("n_passed")) & (F.col("n_checks") == expected)).alias("ok"))


def content_differs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Runs whose digests differ, or that only one side has. Both: (run_id, content_sha256)."""
    a = first.select("run_id", F.col("content_sha256").alias("a"))
    b = second.select("run_id", F.col("content_sha256").alias("b"))
    return a.join(b, "run_id", "full_outer").where(differs("a", "b")).select("run_id")


def switches_differ(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Input switches on one side only: instants and the inputs from then on."""
    columns = ["run_id", "sample_index", *INPUTS]
    a = found.select(*columns, F.lit(1).alias("n"))
    b = expected.select(*columns, F.lit(-1).alias("n"))
    return a.unionByName(b).groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def exported_differs(aligned: DataFrame, exported: DataFrame) -> DataFrame:
    """(run, tick) whose exported row is not the stored row."""
    columns = [c for c in exported.columns if c in aligned.columns]
    a = aligned.select(*columns, F.lit(1).alias("n"))
    b = exported.select(*columns, F.lit(-1).alias("n"))
    return a.unionByName(b).groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") != 0).select("run_id", "sample_index")


def counts_changed(before: Tables, after: Tables) -> DataFrame:
    """Tables whose number of rows changed: re-ingestion must change nothing."""
    from tickweave.operators.ingest import row_counts

    a = row_counts(before).withColumnRenamed("n_rows", "before")
    b = row_counts(after).withColumnRenamed("n_rows", "after")
    return a.join(b, "table_name").where(F.col("before") != F.col("after"))
