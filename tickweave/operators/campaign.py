"""Accounting of a campaign: declared tasks against their records. Every declared task has
exactly one outcome; nothing that failed, is missing or was repeated disappears."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.scalars import identity_words

PRIMARY, HELD = "primary", "held"
TRAINING = "training"
#: Replicates that one task expands: a small file of them is one task, and each becomes a few dozen declared tasks.
SPREAD = 10_000


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def declared_tasks(
    replicates: DataFrame, budgets: Mapping[str, Sequence[int]], fits: Mapping[str, Sequence[str]],
    grid: Mapping[str, int], held_condition: str, held_budgets: Sequence[int], held_families: Sequence[str],
) -> DataFrame:
    """One row per declared fit and training. ``replicates``: (condition, replicate, run_id).
    Declared factors are arrays to explode, so the table is replicates x constants and no
    table is crossed with another. The replicates are spread first, so that what a task expands
    is bounded whatever files they come from."""
    replicates = replicates.repartition(max(1, -(-replicates.count() // SPREAD)))
    of_condition = F.lit(None).cast("array<bigint>")
    for condition, values in budgets.items():
        of_condition = F.when(F.col("condition") == condition, F.array(*[F.lit(int(b)).cast("long") for b in values])).otherwise(of_condition)
    base = replicates.withColumn("budget", F.explode(of_condition))
    held = (F.col("condition") == held_condition) & F.col("budget").isin(*[int(b) for b in held_budgets])
    base = base.withColumn("analysis", F.explode(F.when(held, _strings((PRIMARY, HELD))).otherwise(_strings((PRIMARY,)))))
    primary = F.col("analysis") == PRIMARY

    def entries(kinds: Sequence[str], families: Sequence[str]) -> Column:
        rows = [F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("int").alias("index")) for k in kinds]
        rows += [
            F.struct(F.lit(TRAINING).alias("kind"), F.lit(f).alias("family"), F.lit(i).cast("int").alias("index")) for f in families for i in range(grid[f])
        ]
        return F.array(*rows)

    chosen = F.when(primary, entries(fits[PRIMARY], list(grid))).otherwise(entries(fits[HELD], held_families))
    tasks = base.select("*", F.inline(chosen))
    head = F.format_string("%s/r%02d/b%02d/%s", "condition", F.col("replicate").cast("long"), "budget", "analysis")
    training = F.col("kind") == TRAINING
    return tasks.select(
        *tasks.columns,
        F.when(training, F.concat(head, F.lit("/"), "family", F.lit("/"), F.col("index").cast("string"))).otherwise(F.concat(head, F.lit("/"), "kind")).alias("key"),
        F.when(training, F.concat(head, F.lit("/MR_F"))).alias("start_key"),
        F.when(training, F.concat(head, F.lit("/"), "family")).alias("family_key"),
    )


def family_sizes(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("kind") == TRAINING).groupBy("family_key").agg(F.count(F.lit(1)).alias("n_configurations"))


def coverage(expected: DataFrame, records: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Expected, recorded, missing, unexpected and duplicate keys per condition. Both sides:
    (condition, key). Records are counted by key first, so a key repeated any number of
    times is one row of the join."""
    e = expected.select(*keys, "key").distinct().withColumn("_e", F.lit(1))
    r = records.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("_n"))
    both = e.join(r, [*keys, "key"], "full_outer")
    counts = both.groupBy(*keys).agg(
        F.count("_e").alias("expected"), F.count("_n").alias("recorded"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("duplicate"),
    )
    return counts.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicate") == 0))


def combine_problems(expected: DataFrame, records: DataFrame) -> DataFrame:
    """(key, problem): keys that keep runs from being combined. ``records``: (directory, key,
    filed_as)."""
    e = expected.select("key").distinct().withColumn("_e", F.lit(1))
    r = records.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("key") != F.col("filed_as")).alias("_misfiled"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("_n").isNull(), "no record"), F.when(F.col("_e").isNull(), "not a task of the runs"),
            F.when(F.col("_n") > 1, "recorded twice"), F.when(F.col("_misfiled") > 0, "filed under another key"),
        )
    )
    return e.join(r, "key", "full_outer").select("key", F.explode(problems).alias("problem"))


def compatibility(provenances: DataFrame) -> DataFrame:
    """(scope, attribute, n_values) of attributes in which runs differ. Commit, specification
    and environment must agree over all runs, the data within each condition."""
    shared = provenances.select("run_id", "condition", F.expr("stack(3, 'commit', commit, 'specification', specification, 'environment', environment) as (attribute, value)"))
    over_all = shared.groupBy("attribute").agg(F.count_distinct("value").alias("n_values")).select(F.lit("all").alias("scope"), "attribute", "n_values")
    data = provenances.groupBy("condition").agg(F.count_distinct("data").alias("n_values")).select(F.col("condition").alias("scope"), F.lit("data").alias("attribute"), "n_values")
    return over_all.unionByName(data).where(F.col("n_values") > 1)


def provenance_problems(provenances: DataFrame) -> DataFrame:
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("commit").rlike(r"^([0-9a-f]{40}|[0-9a-f]{64})\z"), F.lit(False)), "commit is not a full object name"),
            F.when(F.col("specification").isNull(), "no specification"), F.when(F.col("environment").isNull(), "no environment"), F.when(F.col("data").isNull(), "no data identity"),
        )
    )
    return provenances.select("run_id", F.explode(problems).alias("problem"))


def selections(records: DataFrame) -> DataFrame:
    """The configuration kept per family: the lowest criterion among those that did not fail,
    the first declared on a tie. A family whose every configuration failed has none. A record
    written twice counts once."""
    ok = F.col("failure").isNull()
    best = F.min_by(F.when(ok, F.col("key")), F.when(ok, F.struct("criterion", "index")))
    chosen = records.where(F.col("kind") == TRAINING).distinct().groupBy("family_key").agg(
        F.count(F.lit(1)).alias("n_tried"), F.count("failure").alias("n_failed"), best.alias("selected"),
        F.min(F.when(ok, F.col("criterion"))).alias("criterion"), F.sum("seconds").alias("seconds"),
    )
    return chosen.withColumn("failure", F.when(F.col("selected").isNull(), "every configuration failed"))


def blocked_tasks(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """State of every training by its start: ``ready``, ``blocked`` (the start failed; a
    failure with its reason) or ``waiting`` (no record of the start). The declared factors are
    exploded, which the size estimate does not see; the join is a merge, so no side is broadcast."""
    starts = records.groupBy("key").agg(F.max("failure").alias("start_failure")).withColumn("_there", F.lit(True)).withColumnRenamed("key", "start_key")
    joined = tasks.where(F.col("kind") == TRAINING).join(starts.hint("merge"), "start_key", "left")
    state = F.when(F.col("_there").isNull(), "waiting").when(F.col("start_failure").isNotNull(), "blocked").otherwise("ready")
    return joined.select(
        "key", "start_key", state.alias("state"),
        F.when(state == "blocked", F.concat(F.lit("not trained, since its start failed: "), F.col("start_failure"))).alias("failure"),
    )


def run_summary(records: DataFrame, keys: Sequence[str] = ("condition", "kind")) -> DataFrame:
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.count("failure").alias("n_failures"), F.sum("seconds").alias("seconds"),
        F.max("seconds").alias("longest"), F.count_distinct("family_key").alias("n_families"),
    )


def identity_collisions(runs: DataFrame) -> DataFrame:
    """Identities defined twice, and different identities that share their derived words."""
    per = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    twice = per.where(F.col("n") > 1).select(F.col("run_id").alias("item"), F.lit("defined twice").alias("problem"), "n")
    words = per.select("run_id", *identity_words("run_id"))
    shared = words.groupBy(*[f"word_{i}" for i in range(4)]).agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("item")).where(F.col("n") > 1)
    return twice.unionByName(shared.select("item", F.lit("shared words").alias("problem"), "n"))


def relative_differences(first: DataFrame, second: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Per value column: records compared, records on one side only, and the largest relative
    difference between two runs of a job."""
    a = first.select(key, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    b = second.select(key, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")

    def relative(v: str) -> Column:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        scale = F.greatest(F.abs(x), F.abs(y))
        return F.when(scale == 0.0, 0.0).otherwise(F.abs(x - y) / scale)

    long = both.select("_a", "_b", F.inline(F.array(*[F.struct(F.lit(v).alias("field"), relative(v).alias("d")) for v in values])))
    return long.groupBy("field").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_compared"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_one_side"), F.max("d").alias("largest"),
    )
