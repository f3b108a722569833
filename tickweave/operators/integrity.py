"""Checks a reader makes beyond the quality checks: units, names, positions, extents,
agreement of rows with their run, of files with their manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.contract import KNOWN_PARAMETERS, SCHEMAS, Tables, units_dimension
from tickweave.functions.scalars import blank, differs, finite, sensor_id, valid_identifier
from tickweave.plans.dealing import dealt


def to_si(df: DataFrame, units: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """SI value, SI unit and dimension of every row with a known unit. A row with another
    unit is not passed through; ``unknown_units`` lists it."""
    dimension = units.withColumnRenamed("unit", "_unit")
    return df.join(dimension, F.col(unit) == F.col("_unit")).select(
        *df.columns, (F.col(value) * F.col("factor")).alias("si_value"), "si_unit", "dimension",
        (F.col(unit) == F.col("si_unit")).alias("is_si"),
    )


def unknown_units(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    return df.join(units.select(F.col("unit").alias(unit)), unit, "left_anti")


def not_in_si(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """Rows whose unit is unknown or is not the SI unit of its dimension."""
    si = units.where(F.col("unit") == F.col("si_unit")).select(F.col("unit").alias(unit))
    return df.join(si, unit, "left_anti")


def misnamed_channels(sensors: DataFrame) -> DataFrame:
    return sensors.where(differs("sensor_id", sensor_id("plant_id", "variable_name"))).select("sensor_id", "plant_id", "variable_name")


def broken_positions(sensors: DataFrame) -> DataFrame:
    """(plant, kind) whose channel positions are not exactly 0 .. m-1."""
    found = sensors.groupBy("plant_id", "channel_kind").agg(
        F.count(F.lit(1)).alias("n_channels"), F.count_distinct("channel_index").alias("n_positions"),
        F.min("channel_index").alias("first"), F.max("channel_index").alias("last"),
    )
    whole = (F.col("n_positions") == F.col("n_channels")) & (F.col("first") == 0) & (F.col("last") == F.col("n_channels") - 1)
    return found.where(~F.coalesce(whole, F.lit(False)))


def plants_without(plants: DataFrame, children: DataFrame) -> DataFrame:
    held = children.select("plant_id").distinct()
    return plants.select("plant_id").distinct().join(held, "plant_id", "left_anti")


def foreign_dataset_runs(runs: DataFrame, dataset_id: str) -> DataFrame:
    return runs.where(differs("dataset_id", F.lit(dataset_id))).select("run_id", "dataset_id")


def broken_run_rows(runs: DataFrame) -> DataFrame:
    """Runs whose extent, period, number of samples, identity, mode or description is not
    possible."""
    possible = (
        finite("start_time_s") & finite("end_time_s") & (F.col("end_time_s") >= F.col("start_time_s"))
        & finite("sampling_period_s") & (F.col("sampling_period_s") > 0) & (F.col("n_samples") >= 1)
    )
    return runs.select(
        "run_id", (~F.coalesce(possible, F.lit(False))).alias("impossible_extent"),
        (blank("operating_mode") | blank("description")).alias("blank_text"),
        (~valid_identifier("run_id")).alias("bad_identifier"),
    ).where(F.col("impossible_extent") | F.col("blank_text") | F.col("bad_identifier"))


def row_agreement(tables: Tables, profile: DataFrame) -> DataFrame:
    """Per run: rows that name another plant, an unknown channel, the channel of another
    plant, a flag, or a channel of another period. Read from the profile of the long table."""
    runs = tables.operating_runs.select("run_id", F.col("plant_id").alias("run_plant"), F.col("sampling_period_s").alias("run_period"))
    channels = tables.sensors.select("sensor_id", F.col("plant_id").alias("channel_plant"), F.col("sampling_period_s").alias("channel_period"))
    joined = profile.join(runs, "run_id").join(channels, "sensor_id", "left")

    def rows(condition):
        return F.sum(F.when(condition, F.col("n_rows")).otherwise(0))

    known = F.col("channel_plant").isNotNull()
    found = joined.groupBy("run_id").agg(
        rows(differs("plant_id", "run_plant")).alias("other_plant"),
        rows(~known).alias("unknown_channel"),
        rows(known & differs("channel_plant", "run_plant")).alias("foreign_channel"),
        rows(differs("quality_flag", F.lit(0))).alias("flagged"),
        rows(known & differs("channel_period", "run_period")).alias("other_period"),
    )
    counts = [c for c in found.columns if c != "run_id"]
    return found.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts]))


def tick_agreement(tables: Tables) -> DataFrame:
    """Per run: ticks whose channels disagree on the instant, repeated (channel, tick) pairs,
    and channels that do not hold exactly the ticks 0 .. n-1. One exchange on (run, tick)."""
    rows = tables.measurements.select("run_id", "sensor_id", "sample_index", "time_s")
    per_cell = rows.repartition("run_id", "sample_index").groupBy("run_id", "sample_index", "sensor_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_s").alias("first"), F.max("time_s").alias("last")
    )
    per_tick = per_cell.groupBy("run_id", "sample_index").agg(
        (F.min("first") != F.max("last")).cast("long").alias("unequal_instants"), F.count_if(F.col("n") > 1).alias("repeated")
    ).groupBy("run_id").agg(F.sum("unequal_instants").alias("unequal_instants"), F.sum("repeated").alias("repeated"))
    samples = tables.operating_runs.select("run_id", "n_samples")
    per_channel = per_cell.groupBy("run_id", "sensor_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi")
    ).join(samples, "run_id")
    whole = (F.col("n_ticks") == F.col("n_samples")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_samples") - 1)
    incomplete = per_channel.groupBy("run_id").agg(F.count_if(~whole).alias("incomplete_channels"))
    return per_tick.join(incomplete, "run_id").where(
        (F.col("unequal_instants") > 0) | (F.col("repeated") > 0) | (F.col("incomplete_channels") > 0)
    )


def end_points(tables: Tables) -> DataFrame:
    """Runs whose first or last stored instant is not that of the run row."""
    found = tables.measurements.groupBy("run_id").agg(F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))
    runs = tables.operating_runs.select("run_id", "start_time_s", "end_time_s")
    return found.join(runs, "run_id").where(differs("first_s", "start_time_s") | differs("last_s", "end_time_s"))


def known_parameters(parameters: DataFrame, plants: DataFrame) -> DataFrame:
    """(plant, parameter) that is missing, repeated, unknown, not finite or not in its SI
    unit, against the expected list of names and units."""
    expected = F.array(*[F.struct(F.lit(n).alias("parameter"), F.lit(u).alias("expected_unit")) for n, u in KNOWN_PARAMETERS])
    given = parameters.groupBy("plant_id", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit"), F.max("unit").alias("_unit"),
        F.count_if(~finite("value")).alias("not_finite"),
    )
    wanted = plants.select("plant_id").distinct().select("plant_id", F.inline(expected))
    both = wanted.join(given, ["plant_id", "parameter"], "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("expected_unit").isNull(), "unknown").when(F.col("n") > 1, "repeated")
        .when(F.col("not_finite") > 0, "not finite").when(differs("unit", "expected_unit"), "not in its SI unit")
    )
    return both.select("plant_id", "parameter", problem.alias("problem")).where(F.col("problem").isNotNull())


def manifest_agreement(manifest_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs on which a manifest and the run table disagree: presence, plant, hash, samples."""
    a = manifest_runs.select("run_id", F.struct("plant_id", "content_sha256", "n_samples").alias("listed"))
    b = runs.select("run_id", F.struct("plant_id", "content_sha256", "n_samples").alias("stored"))
    both = a.join(b, "run_id", "full_outer")
    problem = (
        F.when(F.col("stored").isNull(), "not stored").when(F.col("listed").isNull(), "not in the manifest")
        .when(differs("listed.plant_id", "stored.plant_id"), "plant differs")
        .when(differs("listed.content_sha256", "stored.content_sha256"), "hash differs")
        .when(differs("listed.n_samples", "stored.n_samples"), "samples differ")
    )
    return both.select("run_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def table_agreement(manifest_tables: DataFrame, digests: DataFrame) -> DataFrame:
    a = manifest_tables.select("table_name", F.col("n_rows").alias("listed_rows"), F.col("content_sha256").alias("listed"))
    b = digests.select("table_name", F.col("n_rows").alias("found_rows"), F.col("content_sha256").alias("found"))
    return a.join(b, "table_name", "full_outer").where(differs("listed_rows", "found_rows") | differs("listed", "found"))


def exported_runs(export: DataFrame, manifest_runs: DataFrame) -> DataFrame:
    """Problems of exported wide runs against their manifest: nulls, number of rows, a tick
    repeated or outside 0 .. n-1, end points. One aggregate by (run, tick), one by run."""
    values = [c for c in export.columns if c not in ("run_id", "sample_index")]
    per_tick = export.groupBy("run_id", "sample_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_s").alias("lo"), F.max("time_s").alias("hi"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in values), F.lit(0))).alias("nulls"),
    )
    per_run = per_tick.groupBy("run_id").agg(
        F.sum("n").alias("found_rows"), F.count(F.lit(1)).alias("n_ticks"), F.min("sample_index").alias("first_tick"),
        F.max("sample_index").alias("last_tick"), F.min("lo").alias("first_s"), F.max("hi").alias("last_s"), F.sum("nulls").alias("nulls"),
    )
    listed = manifest_runs.select("run_id", "rows", "start_time_s", "end_time_s")
    both = listed.join(per_run, "run_id", "full_outer")
    out = both.select(
        "run_id",
        F.array_compact(
            F.array(
                F.when(F.col("rows").isNull(), "not in the manifest"),
                F.when(F.col("found_rows").isNull(), "not exported"),
                F.when(F.col("nulls") > 0, "nulls"),
                F.when(F.col("found_rows") != F.col("rows"), "number of rows"),
                F.when(
                    (F.col("n_ticks") != F.col("found_rows")) | (F.col("first_tick") != 0) | (F.col("last_tick") != F.col("rows") - 1),
                    "ticks do not run from 0",
                ),
                F.when((F.col("first_s") != F.col("start_time_s")) | (F.col("last_s") != F.col("end_time_s")), "end points"),
            )
        ).alias("problems"),
    )
    return out.where(F.size("problems") > 0).select("run_id", F.explode("problems").alias("problem"))


def schema_problems(df: DataFrame, table: str) -> list[str]:
    """How the columns of a file differ from the contract. Known from the schema alone."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    expected = [(f.name, f.dataType.simpleString()) for f in SCHEMAS[table]]
    if found == expected:
        return []
    missing = [n for n, _ in expected if n not in dict(found)]
    extra = [n for n, _ in found if n not in dict(expected)]
    typed = [n for n, t in found if dict(expected).get(n, t) != t]
    return [f"{label} {names}" for label, names in (("missing", missing), ("unexpected", extra), ("type", typed)) if names] or ["order"]


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Nulls per required column, in one pass: files do not enforce nullability."""
    required = [f.name for f in SCHEMAS[table] if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], required, "column_name", "n_nulls")


def dimension_findings(tables: Tables) -> DataFrame:
    """All dimension checks of this module as (check, item)."""
    units = units_dimension(tables.plants.sparkSession)
    parts = [
        not_in_si(tables.process_parameters, units).select(F.lit("parameter unit").alias("check"), F.concat_ws(".", "plant_id", "parameter").alias("item")),
        not_in_si(tables.sensors, units).select(F.lit("channel unit").alias("check"), F.col("sensor_id").alias("item")),
        misnamed_channels(tables.sensors).select(F.lit("channel name").alias("check"), F.col("sensor_id").alias("item")),
        broken_positions(tables.sensors).select(F.lit("channel positions").alias("check"), F.concat_ws(".", "plant_id", "channel_kind").alias("item")),
        plants_without(tables.plants, tables.sensors).select(F.lit("plant without channel").alias("check"), F.col("plant_id").alias("item")),
        plants_without(tables.plants, tables.operating_runs).select(F.lit("plant without run").alias("check"), F.col("plant_id").alias("item")),
        broken_run_rows(tables.operating_runs).select(F.lit("run row").alias("check"), F.col("run_id").alias("item")),
    ]
    return reduce(DataFrame.unionByName, parts)


def pre_publish(tables: Tables) -> DataFrame:
    """What stands against publishing, as (problem, plant_id, variable_name, n): channels whose
    description varies between rows of one plant (n descriptions), variables with more than one
    unit (n units, no unit counted as one), and plants without run (n runs, 0)."""
    n_channels = tables.sensors.count()
    described = tables.sensors.select("plant_id", "variable_name", F.struct("channel_kind", "channel_index", "unit", "sampling_period_s", "noise_model", "noise_std").alias("d"))
    described = dealt(described, ("plant_id", "variable_name"), n_channels).distinct()
    varying = described.groupBy("plant_id", "variable_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    units = tables.sensors.select("variable_name", "unit").distinct()
    mixed = units.groupBy("variable_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    plants, runs = tables.plants.select("plant_id"), tables.operating_runs.select("plant_id").where(F.col("plant_id").isNotNull())
    n_owners = max(plants.count(), runs.count())
    idle = plants_without(dealt(plants, ("plant_id",), n_owners), dealt(runs, ("plant_id",), n_owners))
    parts = [
        varying.select(F.lit("description varies").alias("problem"), "plant_id", "variable_name", "n"),
        mixed.select(F.lit("more than one unit").alias("problem"), F.lit(None).cast("string").alias("plant_id"), "variable_name", "n"),
        idle.select(F.lit("plant without run").alias("problem"), "plant_id", F.lit(None).cast("string").alias("variable_name"), F.lit(0).cast("long").alias("n")),
    ]
    return dealt(reduce(DataFrame.unionByName, parts), ("plant_id", "variable_name"), n_channels)
