"""Quality checks of the contract tables. Every check returns the defective rows; an empty
answer is a pass. Nothing is repaired, filled in or dropped.

The long table is read twice: ``profile`` reduces it, by one partial aggregate, to one row per
(plant, run, channel, flag), and fourteen checks read that; what is about single rows,
duplicates, steps, instants and absent channels, comes from the one exchange of ``rowpass``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.contract import INPUT, MEASURED, NOISE_MODEL, QUALITY_GOOD, Tables
from tickweave.functions.scalars import blank, differs, is_sha256, not_finite
from tickweave.operators import rowpass
from tickweave.operators.rowpass import DEFAULT_WIDTH
from tickweave.session import staged

TEXT_FIELDS = {
    "measurements": ("plant_id", "run_id", "sensor_id"),
    "operating_runs": ("run_id", "plant_id", "dataset_id", "operating_mode", "description", "content_sha256"),
    "sensors": ("sensor_id", "plant_id", "variable_name", "channel_kind", "unit"),
    "plants": ("plant_id", "name", "process_type"),
    "process_parameters": ("plant_id", "parameter", "unit"),
}
OTHER_FIELDS = {
    "measurements": ("sample_index", "time_s", "value", "quality_flag"),
    "operating_runs": ("start_time_s", "end_time_s", "sampling_period_s", "n_samples"),
    "sensors": ("channel_index", "sampling_period_s"),
    "plants": (),
    "process_parameters": ("value",),
}


def absent_fields(table: str) -> dict[str, Column]:
    """Required field -> condition that it is absent. Noise fields depend on the kind of
    channel and belong to the metadata checks."""
    return {c: blank(c) for c in TEXT_FIELDS[table]} | {c: F.col(c).isNull() for c in OTHER_FIELDS[table]}


def profile(measurements: DataFrame) -> DataFrame:
    """One row per (plant, run, channel, flag): counts and extremes of its rows."""
    return measurements.groupBy("plant_id", "run_id", "sensor_id", "quality_flag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("sample_index").alias("first_tick"),
        F.max("sample_index").alias("last_tick"),
        F.max("time_s").alias("last_time_s"),
        F.count_if(not_finite("value")).alias("value_not_finite"),
        F.count_if(not_finite("time_s")).alias("time_not_finite"),
        *[
            F.count_if(condition).alias(f"absent_{name}")
            for name, condition in absent_fields("measurements").items()
        ],
    )


@dataclass(frozen=True)
class Source:
    """The tables of one check run, what the checks share, and the band width.

    ``of(.., shared=True)`` is for many checks at once: the profile, one row per channel of a
    run, and the marks of single rows are worked out once and cut from their lineage, so the
    long table is not read again by every check that needs them.
    """

    tables: Tables
    width: int = DEFAULT_WIDTH
    shared: bool = False

    @classmethod
    def of(cls, tables: Tables, width: int = DEFAULT_WIDTH, shared: bool = False) -> Source:
        return cls(tables, width, shared)

    @cached_property
    def profile(self) -> DataFrame:
        found = profile(self.tables.measurements)
        return staged(found, "profile") if self.shared else found

    @cached_property
    def _marks(self) -> DataFrame:
        return staged(rowpass.marks(self.tables, self.width), "marks")

    def marks(self, kind: str) -> DataFrame:
        """Marks of single rows; only those of ``kind`` are sought where nothing is shared."""
        return self._marks if self.shared else rowpass.marks(self.tables, self.width, (kind,))


@dataclass(frozen=True)
class Check:
    """``find`` gives typed columns; ``item`` and ``detail`` are SQL text built from them.
    ``run`` names the column that holds the run, where the finding is about one run."""

    family: str
    name: str
    problem: str
    find: Callable[[Source], DataFrame]
    item: str
    detail: str = "cast(null as string)"
    n_rows: str = "cast(null as bigint)"
    run: str | None = None
    crosses_runs: bool = False


# --- duplicates ------------------------------------------------------------------------


def _repeated(table: str, keys: Sequence[str]) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        counted = getattr(s.tables, table).groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
        return counted.where(F.col("occurrences") > 1)

    return find


# --- references ------------------------------------------------------------------------


def _orphans(key: str, parent: str) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        found = s.profile.groupBy(key).agg(F.sum("n_rows").alias("n_rows"))
        return found.join(getattr(s.tables, parent).select(key).distinct(), key, "left_anti")

    return find


def _foreign(key: str, parent: str, by: Sequence[str]) -> Callable[[Source], DataFrame]:
    """Rows whose plant is not that of the run or channel they name. The join is on the
    profile, so a parent stored twice counts its rows twice, as a row-level join would."""

    def find(s: Source) -> DataFrame:
        owner = getattr(s.tables, parent).select(key, F.col("plant_id").alias("owner"))
        joined = s.profile.join(owner, key).where(differs("plant_id", "owner"))
        return joined.groupBy(*by, "plant_id", "owner").agg(F.sum("n_rows").alias("n_rows"))

    return find


def _no_plant(table: str, key: str) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        rows = getattr(s.tables, table).groupBy(key, "plant_id").agg(F.count(F.lit(1)).alias("n_rows"))
        return rows.join(s.tables.plants.select("plant_id").distinct(), "plant_id", "left_anti")

    return find


# --- required fields -------------------------------------------------------------------


def _absent(table: str) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        names = list(absent_fields(table))
        if table == "measurements":
            counts = s.profile.agg(*[F.sum(f"absent_{n}").alias(n) for n in names])
        else:
            counts = getattr(s.tables, table).agg(
                *[F.count_if(c).alias(n) for n, c in absent_fields(table).items()]
            )
        found = counts.unpivot([], names, "field", "n_rows")
        return found.where(F.col("n_rows") > 0).select(F.lit(table).alias("table_name"), "field", "n_rows")

    return find


# --- finite numbers --------------------------------------------------------------------


def _profile_count(count: str) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        found = s.profile.groupBy("run_id", "sensor_id").agg(F.sum(count).alias("n_rows"))
        return found.where(F.col("n_rows") > 0)

    return find


def _infinite(table: str, keys: Sequence[str], columns: Sequence[str]) -> Callable[[Source], DataFrame]:
    def find(s: Source) -> DataFrame:
        broken = reduce(lambda a, b: a | b, [not_finite(c) for c in columns])
        rows = getattr(s.tables, table).where(broken)
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))

    return find


# --- metadata --------------------------------------------------------------------------


def _sensors_where(condition: Callable[[], Column], *columns: str) -> Callable[[Source], DataFrame]:
    return lambda s: s.tables.sensors.where(condition()).select("sensor_id", *columns)


def _bad_noise() -> Column:
    level = F.col("noise_std")
    return (F.col("channel_kind") == MEASURED) & (
        differs("noise_model", F.lit(NOISE_MODEL)) | level.isNull() | ~(level >= 0)
    )


def _bad_kind() -> Column:
    return F.col("channel_kind").isNull() | ~F.col("channel_kind").isin(MEASURED, INPUT)


def _input_noise() -> Column:
    return (F.col("channel_kind") == INPUT) & (F.col("noise_model").isNotNull() | F.col("noise_std").isNotNull())


def _mixed_units(s: Source) -> DataFrame:
    """Two levels: distinct (variable, unit) first, so the text holds each unit once."""
    units = s.tables.sensors.select("variable_name", "unit").where(F.col("unit").isNotNull()).distinct()
    found = units.groupBy("variable_name").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    return found.where(F.size("units") > 1).select("variable_name", F.array_join("units", " against ").alias("units"))


def _periods(s: Source) -> DataFrame:
    used = s.profile.select("run_id", "sensor_id").distinct()
    runs = s.tables.operating_runs.select("run_id", F.col("sampling_period_s").alias("run_period_s"))
    sensors = s.tables.sensors.select("sensor_id", F.col("sampling_period_s").alias("channel_period_s"))
    return used.join(runs, "run_id").join(sensors, "sensor_id").where(differs("run_period_s", "channel_period_s"))


def _impossible_extent() -> Column:
    return ~(F.col("end_time_s") >= F.col("start_time_s")) | ~(F.col("n_samples") >= 1) | ~(F.col("sampling_period_s") > 0)


def _extent(s: Source) -> DataFrame:
    return s.tables.operating_runs.where(_impossible_extent()).select("run_id", "start_time_s", "end_time_s", "n_samples")


def row_conditions() -> dict[str, dict[str, Column]]:
    """Checks that one dimension row decides by itself: table -> branch -> condition. The
    gate evaluates them in one pass over each table."""
    def absent(table: str) -> Column:
        return reduce(lambda a, b: a | b, absent_fields(table).values())

    return {
        "sensors": {
            "absent_sensors": absent("sensors"), "channel_kinds": _bad_kind(), "measured_without_noise": _bad_noise(), "inputs_with_noise": _input_noise(),
            "channel_periods": ~(F.col("sampling_period_s") > 0), "infinite_periods": not_finite("sampling_period_s"), "infinite_noise": not_finite("noise_std"),
        },
        "operating_runs": {
            "absent_operating_runs": absent("operating_runs"), "run_extents": _impossible_extent(), "content_hashes": ~is_sha256("content_sha256"),
            "infinite_run_times": not_finite("start_time_s") | not_finite("end_time_s") | not_finite("sampling_period_s"),
        },
        "process_parameters": {"absent_process_parameters": absent("process_parameters"), "infinite_parameters": not_finite("value")},
        "plants": {"absent_plants": absent("plants")},
    }


def _flags(s: Source) -> DataFrame:
    found = s.profile.where(differs("quality_flag", F.lit(QUALITY_GOOD)))
    return found.groupBy("run_id", "sensor_id", "quality_flag").agg(F.sum("n_rows").alias("n_rows"))


# --- cadence ---------------------------------------------------------------------------


def channel_extents(s: Source) -> DataFrame:
    """Rows, first and last tick of every (run, channel), next to the samples of the run."""
    found = s.profile.groupBy("run_id", "sensor_id").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_tick").alias("first_tick"), F.max("last_tick").alias("last_tick")
    )
    return found.join(s.tables.operating_runs.select("run_id", "n_samples"), "run_id")


def _gaps(s: Source) -> DataFrame:
    missing = (F.col("sample_index") - F.col("previous_tick") - 1).alias("missing")
    return rowpass.steps(s.marks(rowpass.GAPS), rowpass.GAPS).select("run_id", "sensor_id", "previous_tick", missing)


def _not_increasing(s: Source) -> DataFrame:
    return rowpass.steps(s.marks(rowpass.ORDER), rowpass.ORDER).select("run_id", "sensor_id", "sample_index", "time_s", "previous_time_s")


def _off_clock(s: Source) -> DataFrame:
    found = s.marks(rowpass.CLOCK).where(F.col("kind") == rowpass.CLOCK)
    return found.select("run_id", "sensor_id", "sample_index", "time_s", "expected_time_s")


def _stored_twice(s: Source) -> DataFrame:
    found = s.marks(rowpass.DUPLICATES).where(F.col("kind") == rowpass.DUPLICATES)
    return found.select("run_id", "sensor_id", "sample_index", "occurrences")


def _last_instant(s: Source) -> DataFrame:
    last = s.profile.groupBy("run_id").agg(F.max("last_time_s").alias("last_time_s"))
    runs = s.tables.operating_runs.groupBy("run_id", "end_time_s").agg(F.count(F.lit(1)))
    return last.join(runs, "run_id").where(differs("last_time_s", "end_time_s")).select(
        "run_id", "end_time_s", "last_time_s"
    )


def _no_rows(s: Source) -> DataFrame:
    held = s.profile.select("run_id").distinct()
    return s.tables.operating_runs.join(held, "run_id", "left_anti").select("run_id", "n_samples")


# --- absent channels -------------------------------------------------------------------


def _missing_channels(s: Source) -> DataFrame:
    return rowpass.absent_channels(s.marks(rowpass.CHANNELS), s.tables)


_RUN_SENSOR = "concat(run_id, ' / ', sensor_id)"

# The names and problem texts of the checks.
CHECKS: tuple[Check, ...] = (
    Check("duplicates", "duplicate_measurements", "measurement stored more than once",
          _stored_twice,
          "concat(run_id, ' / ', sensor_id, ' / tick ', sample_index)", n_rows="occurrences", run="run_id"),
    Check("duplicates", "duplicate_runs", "run defined more than once",
          _repeated("operating_runs", ("run_id",)), "run_id", n_rows="occurrences", run="run_id", crosses_runs=True),
    Check("duplicates", "duplicate_channels", "channel defined more than once",
          _repeated("sensors", ("sensor_id",)), "sensor_id", n_rows="occurrences", crosses_runs=True),
    Check("duplicates", "duplicate_variables", "variable with more than one channel on a plant",
          _repeated("sensors", ("plant_id", "variable_name")), "concat(plant_id, ' / ', variable_name)",
          n_rows="occurrences", crosses_runs=True),
    Check("duplicates", "duplicate_positions", "two channels of one kind share a position",
          _repeated("sensors", ("plant_id", "channel_kind", "channel_index")),
          "concat(plant_id, ' / ', channel_kind, ' / ', channel_index)", n_rows="occurrences", crosses_runs=True),
    Check("duplicates", "duplicate_plants", "plant defined more than once",
          _repeated("plants", ("plant_id",)), "plant_id", n_rows="occurrences", crosses_runs=True),
    Check("duplicates", "duplicate_parameters", "parameter given more than once",
          _repeated("process_parameters", ("plant_id", "parameter")), "concat(plant_id, ' / ', parameter)",
          n_rows="occurrences", crosses_runs=True),
    Check("references", "unknown_runs", "measurement of a run that does not exist",
          _orphans("run_id", "operating_runs"), "run_id", n_rows="n_rows", run="run_id"),
    Check("references", "unknown_channels", "measurement of a channel that does not exist",
          _orphans("sensor_id", "sensors"), "sensor_id", n_rows="n_rows"),
    Check("references", "foreign_run_rows", "measurement names another plant than its run",
          _foreign("run_id", "operating_runs", ("run_id",)),
          "concat(run_id, ': ', plant_id, ' against ', owner)", n_rows="n_rows", run="run_id"),
    Check("references", "foreign_channel_rows", "measurement uses the channel of another plant",
          _foreign("sensor_id", "sensors", ("run_id", "sensor_id")),
          "concat(run_id, ' / ', sensor_id, ': ', plant_id, ' against ', owner)", n_rows="n_rows", run="run_id"),
    Check("references", "runs_without_plant", "run of a plant that does not exist",
          _no_plant("operating_runs", "run_id"), "concat(run_id, ' / ', coalesce(plant_id, 'NULL'))",
          n_rows="n_rows", run="run_id", crosses_runs=True),
    Check("references", "channels_without_plant", "channel of a plant that does not exist",
          _no_plant("sensors", "sensor_id"), "concat(sensor_id, ' / ', coalesce(plant_id, 'NULL'))",
          n_rows="n_rows", crosses_runs=True),
    Check("references", "parameters_without_plant", "parameter of a plant that does not exist",
          _no_plant("process_parameters", "parameter"), "concat(parameter, ' / ', coalesce(plant_id, 'NULL'))",
          n_rows="n_rows", crosses_runs=True),
    *[
        Check("required_fields", f"absent_{t}", f"{t}: required field absent", _absent(t),
              "concat(table_name, '.', field)", n_rows="n_rows")
        for t in ("measurements", "operating_runs", "sensors", "plants", "process_parameters")
    ],
    Check("non_finite", "infinite_values", "measurements.value", _profile_count("value_not_finite"),
          _RUN_SENSOR, n_rows="n_rows", run="run_id"),
    Check("non_finite", "infinite_times", "measurements.time_s", _profile_count("time_not_finite"),
          _RUN_SENSOR, n_rows="n_rows", run="run_id"),
    Check("non_finite", "infinite_parameters", "process_parameters.value",
          _infinite("process_parameters", ("plant_id", "parameter"), ("value",)),
          "concat(plant_id, ' / ', parameter)", n_rows="n_rows"),
    Check("non_finite", "infinite_periods", "sensors.sampling_period_s",
          _infinite("sensors", ("sensor_id",), ("sampling_period_s",)), "sensor_id", n_rows="n_rows"),
    Check("non_finite", "infinite_noise", "sensors.noise_std",
          _infinite("sensors", ("sensor_id",), ("noise_std",)), "sensor_id", n_rows="n_rows"),
    Check("non_finite", "infinite_run_times", "operating_runs times and period",
          _infinite("operating_runs", ("run_id",), ("start_time_s", "end_time_s", "sampling_period_s")),
          "run_id", n_rows="n_rows", run="run_id"),
    Check("metadata", "channel_kinds", "channel kind is not measured or input",
          _sensors_where(_bad_kind, "channel_kind"),
          "sensor_id", "coalesce(channel_kind, 'NULL')"),
    Check("metadata", "measured_without_noise", "measured channel without a valid noise model and level",
          _sensors_where(_bad_noise, "noise_model", "noise_std"), "sensor_id",
          "concat(coalesce(noise_model, 'NULL'), ' / ', coalesce(cast(noise_std as string), 'NULL'))"),
    Check("metadata", "inputs_with_noise", "known input presented with noise",
          _sensors_where(_input_noise, "noise_model", "noise_std"),
          "sensor_id", "concat(coalesce(noise_model, 'NULL'), ' / ', coalesce(cast(noise_std as string), 'NULL'))"),
    Check("metadata", "channel_periods", "sampling period is not positive",
          _sensors_where(lambda: ~(F.col("sampling_period_s") > 0), "sampling_period_s"), "sensor_id",
          "cast(sampling_period_s as string)"),
    Check("metadata", "mixed_units", "one variable with different units on different plants",
          _mixed_units, "variable_name", "units", crosses_runs=True),
    Check("metadata", "run_channel_periods", "run and channel disagree on the sampling period", _periods, _RUN_SENSOR,
          "concat(cast(run_period_s as string), ' s against ', cast(channel_period_s as string), ' s')", run="run_id"),
    Check("metadata", "run_extents", "run with an impossible extent", _extent, "run_id",
          "concat('from ', start_time_s, ' to ', end_time_s, ' s, ', n_samples, ' samples')", run="run_id"),
    Check("metadata", "content_hashes", "content hash is not a SHA-256",
          lambda s: s.tables.operating_runs.where(~is_sha256("content_sha256")).select("run_id", "content_sha256"),
          "run_id", "coalesce(content_sha256, 'NULL')", run="run_id"),
    Check("metadata", "quality_flags", "quality flag that the contract does not define", _flags, _RUN_SENSOR,
          "concat('flag ', quality_flag, ' on ', n_rows, ' rows')", n_rows="n_rows", run="run_id"),
    Check("cadence", "row_counts", "number of rows is not the number of samples of the run",
          lambda s: channel_extents(s).where(F.col("n_rows") != F.col("n_samples")).select("run_id", "sensor_id", "n_rows", "n_samples"),
          _RUN_SENSOR, "concat(n_rows, ' rows, ', n_samples, ' samples')", run="run_id"),
    Check("cadence", "tick_ranges", "ticks do not run from 0 to n_samples - 1",
          lambda s: channel_extents(s).where((F.col("first_tick") != 0) | (F.col("last_tick") != F.col("n_samples") - 1))
          .select("run_id", "sensor_id", "first_tick", "last_tick"),
          _RUN_SENSOR, "concat('from ', first_tick, ' to ', last_tick)", run="run_id"),
    Check("cadence", "gaps", "gap: ticks missing between two rows", _gaps, _RUN_SENSOR,
          "concat(missing, ' missing after tick ', previous_tick)", run="run_id"),
    Check("cadence", "time_not_increasing", "time does not increase with the tick", _not_increasing, _RUN_SENSOR,
          "concat('tick ', sample_index, ' at ', time_s, ' s after ', previous_time_s, ' s')", run="run_id"),
    Check("cadence", "off_clock", "instant is not on the sampling clock of its run", _off_clock, _RUN_SENSOR,
          "concat('tick ', sample_index, ' at ', time_s, ' s, expected ', expected_time_s, ' s')", run="run_id"),
    Check("cadence", "last_instants", "run does not end at its last instant", _last_instant, "run_id",
          "concat('end_time_s ', end_time_s, ' s, last row at ', last_time_s, ' s')", run="run_id"),
    Check("cadence", "empty_runs", "run without any measurement", _no_rows, "run_id",
          "concat(n_samples, ' samples recorded')", run="run_id"),
    Check("missing_channels", "missing_channels", "channel absent at an instant of its run", _missing_channels,
          _RUN_SENSOR, "concat('tick ', sample_index)", run="run_id"),
)
BY_NAME = {c.name: c for c in CHECKS}


def findings(tables: Tables, name: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The typed findings of one check."""
    return BY_NAME[name].find(Source.of(tables, width))


def report(
    tables: Tables, checks: Sequence[Check] = CHECKS, width: int = DEFAULT_WIDTH, source: Source | None = None
) -> DataFrame:
    """All findings of ``checks``: check family, problem, item, detail, rows, run."""
    s = source or Source.of(tables, width, shared=True)
    parts = [
        c.find(s).select(
            F.lit(c.family).alias("check"),
            F.lit(c.name).alias("branch"),
            F.lit(c.problem).alias("problem"),
            F.expr(c.item).alias("item"),
            F.expr(c.detail).alias("detail"),
            F.expr(c.n_rows).cast("long").alias("n_rows"),
            (F.col(c.run) if c.run else F.lit(None)).cast("string").alias("run_id"),
        )
        for c in checks
    ]
    return reduce(DataFrame.unionByName, parts)


def report_counts(tables: Tables, checks: Sequence[Check] = CHECKS, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Findings per check; a check without any is listed with zero."""
    s = Source.of(tables, width, shared=True)
    parts = [
        c.find(s).agg(F.count(F.lit(1)).alias("n_findings")).select(
            F.lit(c.family).alias("check"), F.lit(c.problem).alias("problem"), "n_findings"
        )
        for c in checks
    ]
    return reduce(DataFrame.unionByName, parts)


def failed_checks(tables: Tables, width: int = DEFAULT_WIDTH) -> DataFrame:
    return report_counts(tables, width=width).where(F.col("n_findings") > 0)
