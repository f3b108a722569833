"""The long table read as series: aligned rows, lags, block averages, paired plants,
input switches. Nothing is interpolated; what is absent stays absent and is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.contract import INPUTS, MEASURED, STATES, VARIABLES, Tables
from tickweave.functions.scalars import concordance, constant_or_null, run_definition
from tickweave.plans.bands import DEFAULT_WIDTH, Bands
from tickweave.plans.dealing import dealt


def aligned_series(tables: Tables, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """One row per (plant, run, tick) with the channels side by side.

    One exchange: rows are hash partitioned by (plant, run, tick), which also serves the
    inner grouping by channel that makes the exact distinct count a plain count.
    """
    named = tables.sensors.select("plant_id", "sensor_id", "variable_name")
    keys = ["plant_id", "run_id", "sample_index"]
    rows = tables.measurements.select(*keys, "sensor_id", "time_s", "value").join(named, ["plant_id", "sensor_id"])
    per_channel = (
        dealt(rows, keys, tables.measurements.count())
        .groupBy(*keys, "sensor_id", "variable_name")
        .agg(
            F.count(F.lit(1)).alias("n"), F.max("value").alias("value"),
            F.min("time_s").alias("first"), F.max("time_s").alias("last"),
        )
    )
    complete = (
        (F.sum("n") == len(variables)) & (F.count(F.lit(1)) == len(variables)) & (F.min("first") == F.max("last"))
    )
    return per_channel.groupBy(*keys).agg(
        F.min("first").alias("time_s"),
        *[F.max(F.when(F.col("variable_name") == v, F.col("value"))).alias(v) for v in variables],
        F.count(F.lit(1)).alias("n_channels"),
        F.sum("n").alias("n_rows"),
        complete.alias("complete"),
    )


def lagged_measurements(measurements: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every measurement with the stored row before it. The value is "one period ago" only
    where the ticks are consecutive."""
    scanned = Bands(("plant_id", "run_id", "sensor_id"), "sample_index", ("time_s", "value"), width).scan(
        measurements.select("plant_id", "run_id", "sensor_id", "sample_index", "time_s", "value"),
        lag={"previous_stored_value": "value", "_tick": "sample_index", "_time": "time_s"},
    )
    ticks = F.col("sample_index") - F.col("_tick")
    return scanned.select(
        "plant_id", "run_id", "sensor_id", "sample_index", "time_s", "value", "previous_stored_value",
        ticks.alias("ticks_since_previous"),
        (F.col("time_s") - F.col("_time")).alias("seconds_since_previous"),
        F.when(ticks == 1, F.col("previous_stored_value")).alias("value_one_period_ago"),
    )


def block_average(aligned: DataFrame, runs: DataFrame, block_ticks: int) -> DataFrame:
    """Averages over blocks of ``block_ticks`` ticks. A block is labelled from the clock of
    its run; a partial block is reported with its coverage; an input that changes inside the
    block is null. Blocks are keys of their own, so a long run is spread over tasks."""
    if isinstance(block_ticks, bool) or not isinstance(block_ticks, int) or block_ticks < 1:
        raise ValueError(f"block_ticks must be a whole number, 1 or more, got {block_ticks!r}")
    size = F.lit(block_ticks).cast("long")
    blocks = aligned.withColumn("block_index", F.expr(f"sample_index div {block_ticks}L"))
    complete = F.col("complete")
    steady: Column = F.lit(True)
    for name in INPUTS:
        steady = steady & (F.min(name) == F.max(name))
    averaged = blocks.groupBy("plant_id", "run_id", "block_index").agg(
        F.count_if(complete).alias("n_present"),
        *[F.avg(F.when(complete, F.col(s))).alias(f"{s}_mean") for s in STATES],
        *[constant_or_null(i).alias(i) for i in INPUTS],
        steady.alias("inputs_constant"),
    )
    clock = runs.select("run_id", "start_time_s", "sampling_period_s", "n_samples")
    expected = F.least(size, F.col("n_samples") - F.col("block_index") * size)
    return averaged.join(clock, "run_id").select(
        "plant_id", "run_id", "block_index",
        (F.col("start_time_s") + F.col("block_index") * size * F.col("sampling_period_s")).alias("block_start_s"),
        (F.col("start_time_s") + (F.col("block_index") + 1) * size * F.col("sampling_period_s")).alias("block_end_s"),
        expected.alias("n_expected"), "n_present",
        F.try_divide(F.col("n_present").cast("double"), expected.cast("double")).alias("coverage"),
        *[f"{s}_mean" for s in STATES], *INPUTS, "inputs_constant",
    )


def paired_runs(runs: DataFrame, source: str, target: str) -> DataFrame:
    """Runs of two plants with the same definition: an equality on a computed key."""
    keyed = runs.select("run_id", "plant_id", "n_samples", run_definition("run_id", "plant_id").alias("definition"))
    a = keyed.where(F.col("plant_id") == source).select("definition", F.col("run_id").alias("source_run"), F.col("n_samples").alias("n_source"))
    b = keyed.where(F.col("plant_id") == target).select("definition", F.col("run_id").alias("target_run"), F.col("n_samples").alias("n_target"))
    return a.join(b, "definition")


def paired_rows(aligned: DataFrame, runs: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of two plants tick by tick. Each side is attached to its pair first, then the
    sides meet on (pair, tick), a key that spreads one long run over all tasks."""
    pairs = paired_runs(runs, source, target)
    columns = ["sample_index", "time_s", *VARIABLES, "complete"]

    def side(plant: str, run: str, prefix: str) -> DataFrame:
        own = aligned.where(F.col("plant_id") == plant).withColumnRenamed("run_id", run)
        return own.join(pairs.select("definition", "source_run", "target_run").withColumnRenamed(run, "_run"),
                        F.col(run) == F.col("_run")).select(
            "definition", F.col("_run").alias(run),
            *([F.col("target_run")] if run == "source_run" else [F.col("source_run")]),
            F.col("sample_index"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns[1:]],
        )

    keys = ["definition", "source_run", "target_run", "sample_index"]
    a, b = side(source, "source_run", "a"), side(target, "target_run", "b")
    return a.join(b, keys).select(
        *keys,
        (F.col("a_time_s") == F.col("b_time_s")).alias("same_instant"),
        concordance([F.col(f"a_{i}") for i in INPUTS], [F.col(f"b_{i}") for i in INPUTS]).alias("same_inputs"),
        (F.col("a_complete") & F.col("b_complete")).alias("both_complete"),
        *[(F.col(f"b_{s}") - F.col(f"a_{s}")).alias(f"difference_{s}") for s in STATES],
    )


def compare_plants(aligned: DataFrame, runs: DataFrame, source: str, target: str) -> DataFrame:
    """Observed differences of two plants under the same experiment, usable pairs only."""
    usable = F.col("same_instant") & F.col("same_inputs") & F.col("both_complete")
    rows = paired_rows(aligned, runs, source, target).withColumn("usable", usable)

    def used(column: str) -> Column:
        return F.when(F.col("usable"), F.col(column))

    statistics = []
    for state, name in zip(STATES, ("c_a", "t"), strict=True):
        d = used(f"difference_{state}")
        statistics += [
            F.avg(d).alias(f"observed_difference_{name}_mean"), F.stddev_samp(d).alias(f"observed_difference_{name}_std"),
            F.min(d).alias(f"observed_difference_{name}_min"), F.max(d).alias(f"observed_difference_{name}_max"),
        ]
    grouped = rows.groupBy("definition", "source_run", "target_run").agg(
        F.count(F.lit(1)).alias("n_paired"), F.count_if("same_instant").alias("n_same_instant"),
        F.count_if("same_inputs").alias("n_same_inputs"), F.count_if("usable").alias("n_used"), *statistics,
    )
    sizes = paired_runs(runs, source, target).select(
        "source_run", "target_run", F.greatest("n_source", "n_target").cast("double").alias("longer")
    )
    return grouped.join(sizes, ["source_run", "target_run"]).select(
        "definition", "source_run", "target_run", "n_paired",
        F.try_divide(F.col("n_paired").cast("double"), F.col("longer")).alias("coverage"),
        "n_same_instant", "n_same_inputs", "n_used",
        *[c for c in grouped.columns if c.startswith("observed_")],
    )


def with_previous_inputs(aligned: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Aligned rows with ``changed``: the first row of a run, or inputs unlike the row before."""
    scanned = Bands(("run_id",), "sample_index", (), width).scan(aligned, lag={"_was": F.struct(*INPUTS)})
    same = concordance([F.col(i) for i in INPUTS], [F.col(f"_was.{i}") for i in INPUTS])
    return scanned.withColumn("changed", ~F.coalesce(same, F.lit(False)))


def input_switches(aligned: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Instants at which the inputs change, and the inputs from then on."""
    return with_previous_inputs(aligned, width).where("changed").select("run_id", "sample_index", "time_s", *INPUTS)


def input_segments(aligned: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Runs of rows with equal inputs: one row per segment with its first and last tick. The
    switches are few, so the second scan, over them alone, is small."""
    last = aligned.groupBy("run_id").agg(F.max("sample_index").alias("_last"))
    switches = input_switches(aligned, width)
    bounded = Bands(("run_id",), "sample_index", (), width).scan(switches, lead={"_next": "sample_index"})
    return bounded.join(last, "run_id").select(
        "run_id", F.col("sample_index").alias("first_tick"),
        F.coalesce(F.col("_next") - 1, F.col("_last")).alias("last_tick"), *INPUTS,
    ).withColumn("n_ticks", F.col("last_tick") - F.col("first_tick") + 1)


def run_in_channel_order(tables: Tables, run_id: str) -> DataFrame:
    """The rows of one run, measured channels before inputs, by position and tick."""
    rows = tables.measurements.where(F.col("run_id") == run_id)
    channels = tables.sensors.select("plant_id", "sensor_id", "channel_kind", "channel_index")
    return rows.join(channels, ["plant_id", "sensor_id"]).orderBy(
        (F.col("channel_kind") == MEASURED).desc(), "channel_index", "sample_index"
    ).select("channel_kind", "channel_index", "sensor_id", "sample_index", "time_s", "value")


def part_moments(rows: DataFrame, keys: list[str], variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Population mean and deviation of every variable over the rows of a part, and whether
    the deviation can scale anything."""
    out = []
    for v in variables:
        out += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std")]
    moments = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *out)
    usable = F.lit(True)
    for v in variables:
        usable = usable & (F.col(f"{v}_std") > 0.0) & (F.col(f"{v}_std") < float("inf"))
    return moments.withColumn("usable", F.coalesce(usable, F.lit(False)))


def input_levels(aligned: DataFrame, nominal: dict[str, float]) -> DataFrame:
    """Largest deviation of each input from its nominal value, per run; an input that never
    moves has amplitude one, so that a level is always defined."""
    largest = [F.max(F.abs(F.col(i) - F.lit(nominal[i]))).alias(i) for i in INPUTS]
    found = aligned.groupBy("run_id").agg(*largest)
    return found.select("run_id", *[F.when(F.col(i) == 0.0, 1.0).otherwise(F.col(i)).alias(f"{i}_amplitude") for i in INPUTS])
