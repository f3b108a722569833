"""The ingestion gate: many offered runs at once, each accepted, already present or refused
with its reason. The gate is linear in the offered rows: what only a comparison between
runs or plants can show is looked for in the dimensions, never by re-reading the store."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.contract import SCHEMAS, Tables, conform
from tickweave.functions.scalars import differs
from tickweave.operators import quality
from tickweave.operators.digests import run_digests, rows_digest
from tickweave.session import staged as stage

INGESTED, PRESENT = "ingested", "already_present"
# In the order in which the gates are passed: the first that fails decides the status.
REFUSALS = ("quality", "content_changed", "plant_conflict", "dataset_conflict", "run_conflict", "unit_conflict")
# Rows that name a run the offer doesn't list.
UNLISTED = "run_not_listed"


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side without an equal row on the other, nulls equal, copies counted. One
    exchange: both sides are counted together instead of being subtracted twice."""
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(columns).withColumn("_n", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_net")).where(F.col("_net") != 0)
    side = F.when(F.col("_net") > 0, "first").otherwise("second")
    return net.select(side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_net"))).alias("_copy"), *columns).drop("_copy")


def staged(offered: Tables, run_ids: list[str] | None = None) -> Tables:
    """A staging copy of the rows of the offered runs and of their plants; of all runs when
    none are named. What is checked is this copy, and what is appended is the same rows: an
    offer that changes while it is read, or is expensive to work out, is read once. The copy is Parquet in
    the shared folder, so each gate fetches only the columns it looks at."""
    if run_ids is None:
        return Tables(**{name: stage(df, f"offer-{name}") for name, df in offered.items()})
    runs = offered.operating_runs.where(F.col("run_id").isin(run_ids))
    plants = runs.select("plant_id").distinct()

    def of_plants(df: DataFrame) -> DataFrame:
        return df.join(plants, "plant_id", "left_semi").select(df.columns)

    return staged(Tables(
        plants=of_plants(offered.plants), process_parameters=of_plants(offered.process_parameters),
        sensors=of_plants(offered.sensors), operating_runs=runs,
        measurements=offered.measurements.where(F.col("run_id").isin(run_ids)),
    ))


def quality_findings_by_run(tables: Tables, width: int = quality.DEFAULT_WIDTH) -> DataFrame:
    """(run_id, branch, n_findings) of every quality finding. A defect of a plant, a channel
    or a parameter counts against every run of that plant."""
    s = quality.Source.of(tables, width, shared=True)
    conditions = quality.row_conditions()
    decided_by_row = {name for branches in conditions.values() for name in branches}
    by_run, by_plant = [], []
    for table, branches in conditions.items():
        named = F.array_compact(F.array(*[F.when(c, name) for name, c in branches.items()]))
        key, parts = ("run_id", by_run) if table == "operating_runs" else ("plant_id", by_plant)
        parts.append(getattr(tables, table).select(key, F.explode(named).alias("branch")))
    owner = tables.sensors.select("sensor_id", "plant_id").distinct()
    for check in quality.CHECKS:
        if check.name in decided_by_row or check.name in ("mixed_units", "absent_measurements"):
            continue
        found = check.find(s).withColumn("branch", F.lit(check.name))
        if check.name == "unknown_channels":
            users = s.profile.select("run_id", "sensor_id").distinct()
            by_run.append(found.select("sensor_id", "branch").join(users, "sensor_id").select("run_id", "branch"))
        elif "run_id" in found.columns:
            by_run.append(found.select("run_id", "branch"))
        elif "plant_id" in found.columns:
            by_plant.append(found.select("plant_id", "branch"))
        else:
            by_plant.append(found.select("sensor_id", "branch").join(owner, "sensor_id").select("plant_id", "branch"))
    any_absent = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in s.profile.columns if c.startswith("absent_")])
    by_run.append(s.profile.where(any_absent).select("run_id", F.lit("absent_measurements").alias("branch")))
    runs = tables.operating_runs.select("run_id", "plant_id").distinct()
    of_plants = reduce(DataFrame.unionByName, by_plant).distinct().join(runs, "plant_id").select("run_id", "branch")
    return reduce(DataFrame.unionByName, by_run).unionByName(of_plants).groupBy("run_id", "branch").agg(
        F.count(F.lit(1)).alias("n_findings")
    )


def _conflicting_plants(offered: Tables, stored: Tables) -> DataFrame:
    """Known plants whose plant, parameter or channel rows differ from the stored ones, and
    plants that claim a channel of another plant in the store."""
    known = stored.plants.select("plant_id").distinct()
    parts = []
    for name in ("plants", "process_parameters", "sensors"):
        a, b = getattr(offered, name), getattr(stored, name)
        offered_plants = offered.plants.select("plant_id").distinct()
        own = a.join(known, "plant_id", "left_semi").select(SCHEMAS[name].names).distinct()
        theirs = b.join(offered_plants, "plant_id", "left_semi").select(SCHEMAS[name].names).distinct()
        parts.append(symmetric_difference(own, theirs).select("plant_id"))
    owners = stored.sensors.select("sensor_id", F.col("plant_id").alias("owner")).distinct()
    parts.append(offered.sensors.join(owners, "sensor_id").where(differs("plant_id", "owner")).select("plant_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _unit_conflicts(offered: Tables, stored: Tables) -> DataFrame:
    """Plants that would give a variable a second unit: the unit in the store stands, else
    that of the first plant in name order."""
    old = stored.sensors.select("variable_name", F.lit(0).alias("rank"), "plant_id", "unit")
    new = offered.sensors.select("variable_name", F.lit(1).alias("rank"), "plant_id", "unit")
    stands = old.unionByName(new).groupBy("variable_name").agg(F.min_by("unit", F.struct("rank", "plant_id")).alias("stands"))
    return new.join(stands, "variable_name").where(differs("unit", "stands")).select("plant_id").distinct()


def unlisted_runs(offered: Tables) -> DataFrame:
    """(run_id, n_rows): measurements of runs that the offer doesn't list."""
    rows = offered.measurements.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(offered.operating_runs.select("run_id").distinct(), "run_id", "left_anti")


@dataclass(frozen=True)
class Examined:
    """An offer with what doesn't depend on the store: the runs with a defect, the digests of the content and the runs that only
    measurements name."""

    tables: Tables
    defective: DataFrame
    rebuilt: DataFrame
    unlisted: DataFrame

    @classmethod
    def of(cls, offered: Tables, width: int = quality.DEFAULT_WIDTH) -> Examined:
        defective = quality_findings_by_run(offered, width).select("run_id").distinct()
        return cls(offered, defective, run_digests(offered).select("run_id", F.col("content_sha256").alias("rebuilt")), unlisted_runs(offered))


def examined(offered: Tables, width: int = quality.DEFAULT_WIDTH) -> Examined:
    """A staged copy of the offer, examined once for all gates it is taken to: the long table is checked here and digested here;
    a gate reads of it only what it appends."""
    found = Examined.of(staged(offered), width)
    return Examined(found.tables, stage(found.defective, "defective"), stage(found.rebuilt, "rebuilt"), stage(found.unlisted, "unlisted"))


def gate(offer: Tables | Examined, stored: Tables, width: int = quality.DEFAULT_WIDTH) -> DataFrame:
    """(run_id, plant_id, status, refused_by): every gate is evaluated for all runs; the
    first that fails decides. A run that only measurements name is refused, too."""
    known_of = offer if isinstance(offer, Examined) else Examined.of(offer, width)
    offered, rebuilt = known_of.tables, known_of.rebuilt
    runs = offered.operating_runs.groupBy("run_id", "plant_id").agg(
        F.first("dataset_id").alias("dataset_id"), F.first("content_sha256").alias("recorded")
    )
    bad_quality = known_of.defective.withColumn("f_quality", F.lit(True))
    plant_conflict = _conflicting_plants(offered, stored).withColumn("f_plant", F.lit(True))
    unit_conflict = _unit_conflicts(offered, stored).withColumn("f_unit", F.lit(True))
    names = SCHEMAS["operating_runs"].names
    offered_row = rows_digest(offered.operating_runs, ["run_id"], names, "row").select("run_id", F.col("content_sha256").alias("offered_row"))
    stored_row = rows_digest(stored.operating_runs, ["run_id"], names, "row").select("run_id", F.col("content_sha256").alias("stored_row"))
    owner = stored.operating_runs.groupBy("run_id").agg(F.first("dataset_id").alias("stored_dataset"))
    # only runs offered again are read back from the store
    again = runs.select("run_id").distinct()
    held = stored.with_(measurements=stored.measurements.join(again, "run_id", "left_semi").select(SCHEMAS["measurements"].names))
    stored_digest = run_digests(held).select("run_id", F.col("content_sha256").alias("stored_content"))
    joined = (
        runs.join(bad_quality, "run_id", "left").join(rebuilt, "run_id", "left").join(plant_conflict, "plant_id", "left")
        .join(unit_conflict, "plant_id", "left").join(offered_row, "run_id", "left").join(stored_row, "run_id", "left")
        .join(owner, "run_id", "left").join(stored_digest, "run_id", "left")
    )
    known = F.col("stored_row").isNotNull()
    failed = {
        "quality": F.col("f_quality"),
        "content_changed": differs("recorded", "rebuilt"),
        "plant_conflict": F.col("f_plant"),
        "dataset_conflict": known & differs("dataset_id", "stored_dataset"),
        "run_conflict": known & (differs("offered_row", "stored_row") | differs("rebuilt", "stored_content")),
        "unit_conflict": ~known & F.col("f_unit"),
    }
    refused = F.coalesce(*[F.when(failed[g], F.lit(g)) for g in REFUSALS])
    judged = joined.select(
        "run_id", "plant_id", refused.alias("refused_by"),
        F.when(refused.isNotNull(), "refused").when(known, PRESENT).otherwise(INGESTED).alias("status"),
    )
    return judged.unionByName(known_of.unlisted.select(
        "run_id", F.lit(None).cast("string").alias("plant_id"), F.lit(UNLISTED).alias("refused_by"), F.lit("refused").alias("status")
    ))


def stop_at_first_refusal(report: DataFrame) -> DataFrame:
    """Runs in the order of their names; nothing after the first refusal is taken."""
    first = report.where(F.col("status") == "refused").agg(F.min("run_id").alias("_stop"))
    return report.join(F.broadcast(first), how="cross").select(
        "run_id", "plant_id", "refused_by",
        F.when(F.col("_stop").isNull() | (F.col("run_id") <= F.col("_stop")), F.col("status")).otherwise("not_reached").alias("status"),
    )


def accepted(offered: Tables, stored: Tables, report: DataFrame) -> Tables:
    """The rows to append: parents of new plants, and the runs the gate took."""
    taken = report.where(F.col("status") == INGESTED)
    runs, plants = taken.select("run_id").distinct(), taken.select("plant_id").distinct()
    new_plants = plants.join(stored.plants.select("plant_id").distinct(), "plant_id", "left_anti")

    def by(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        return df.join(keys, key, "left_semi")

    return Tables(
        plants=conform(by(offered.plants, new_plants, "plant_id"), "plants"),
        process_parameters=conform(by(offered.process_parameters, new_plants, "plant_id"), "process_parameters"),
        sensors=conform(by(offered.sensors, new_plants, "plant_id"), "sensors"),
        operating_runs=conform(by(offered.operating_runs, runs, "run_id"), "operating_runs"),
        measurements=conform(by(offered.measurements, runs, "run_id"), "measurements"),
    )


def ingest(offer: Tables | Examined, stored: Tables, fail_fast: bool = False, width: int = quality.DEFAULT_WIDTH) -> tuple[DataFrame, Tables]:
    """The report, one row per offered run, and the rows to append. An offer that isn't examined yet is staged and examined; the
    report is small and read by every table to append, so it is staged once."""
    offer = offer if isinstance(offer, Examined) else examined(offer, width)
    report = gate(offer, stored, width)
    if fail_fast:
        report = stop_at_first_refusal(report)
    report = stage(report, "gate")
    return report, accepted(offer.tables, stored, report)


def constraint_violations(tables: Tables) -> DataFrame:
    """Second line of defence: the table constraints, asserted on what was written."""
    return quality.report_counts(tables).where(F.col("n_findings") > 0)


def row_counts(tables: Tables) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def stored_counts(offered: Tables, stored: Tables) -> DataFrame:
    """Runs whose stored rows are not as many as were staged."""
    a = offered.measurements.groupBy("run_id").agg(F.count(F.lit(1)).alias("staged"))
    b = stored.measurements.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"))
    return a.join(b, "run_id", "left").where(differs("staged", "stored"))


def first_per_check(report: DataFrame, k: int = 1) -> DataFrame:
    """The first ``k`` findings of each check in text order."""
    w = Window.partitionBy("branch").orderBy("problem", "item", "detail")
    return report.withColumn("_position", F.row_number().over(w)).where(F.col("_position") <= k).drop("_position")
