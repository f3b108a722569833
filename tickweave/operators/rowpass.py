"""What is wrong with single rows of the long table, from one exchange of it.

Rows are dealt by (run, band of ticks), so a run that holds a third of all rows is spread. Within a band two local sorts
serve every check: by channel and tick for the row before, by tick and channel for rows stored twice and for the channels present at
a tick. Runs and channels are dimensions and meet the rows before the exchange, reduced at once to what a row needs of them. Only
rows with a defect leave the pass, as *marks*, and with them the first and last row of a channel in a band: the steps across
bands are taken from these.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.contract import Tables
from tickweave.functions.scalars import clock_instant, on_clock
from tickweave.plans.dealing import dealt

#: Ticks of a band: few enough that the runs of a small log spread over all tasks, enough that edges are rare.
DEFAULT_WIDTH = 1 << 10
DUPLICATES, GAPS, ORDER, CLOCK, CHANNELS = KINDS = ("duplicate_measurements", "gaps", "time_not_increasing", "off_clock", "missing_channels")
_FIRST, _LAST = "first of band", "last of band"
_COLUMNS = {
    "kind": "string", "plant_id": "string", "run_id": "string", "sensor_id": "string", "sample_index": "long", "time_s": "double",
    "expected_time_s": "double", "previous_tick": "long", "previous_time_s": "double", "occurrences": "long", "band": "long",
}


def _mark(kind: str, *names: str, **columns: Column) -> Column:
    given = {n: F.col(n) for n in names} | columns | {"kind": F.lit(kind)}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS.items()])


def declared(tables: Tables) -> DataFrame:
    """Distinct (sensor_id, plant_id) of the channels."""
    return tables.sensors.where(F.col("sensor_id").isNotNull() & F.col("plant_id").isNotNull()).select("sensor_id", "plant_id").distinct()


def _with_clocks(rows: DataFrame, tables: Tables) -> DataFrame:
    """``off``: the instants that the clocks of the row's run expect instead of its own, null if none does. A run has one clock as a
    rule, which is compared in compiled code; only where that doesn't settle it, all are looked at."""
    own = F.struct("start_time_s", "sampling_period_s")
    clocks = tables.operating_runs.groupBy("run_id").agg(F.collect_list(own).alias("clocks"))
    clocks = clocks.select("run_id", "clocks", F.size("clocks").alias("n"), F.col("clocks")[0]["start_time_s"].alias("start"), F.col("clocks")[0]["sampling_period_s"].alias("period"))
    expected = F.transform("clocks", lambda c: clock_instant("sample_index", c["start_time_s"], c["sampling_period_s"]))
    due = clock_instant("sample_index", "start", "period")
    right = F.col("n").isNull() | ((F.col("n") == 1) & ((F.col("time_s") == due) | F.coalesce(on_clock("time_s", due), F.lit(True))))
    off = F.when(~right, F.filter(expected, lambda x: ~on_clock("time_s", x)))
    return rows.join(clocks, "run_id", "left").withColumn("off", off).drop("clocks", "n", "start", "period")


def _with_channels(rows: DataFrame, tables: Tables) -> DataFrame:
    """``channels``: how many channels the row's plant has, if the row's channel is one of them. A channel has one plant as a rule."""
    known = declared(tables)
    sizes = known.groupBy("plant_id").agg(F.count("*").alias("channels"))
    owners = known.join(sizes, "plant_id").groupBy("sensor_id").agg(F.collect_list(F.struct("plant_id", "channels")).alias("owners"))
    owners = owners.select("sensor_id", "owners", F.size("owners").alias("n"), F.col("owners")[0]["plant_id"].alias("owner"), F.col("owners")[0]["channels"].alias("of_owner"))
    any_ = F.get(F.filter("owners", lambda o: o["plant_id"] == F.col("plant_id")), F.lit(0))["channels"]
    channels = F.when(F.col("owner") == F.col("plant_id"), F.col("of_owner")).when(F.col("n") > 1, any_)
    return rows.join(owners, "sensor_id", "left").withColumn("channels", channels).drop("owners", "n", "owner", "of_owner")


def marks(tables: Tables, width: int = DEFAULT_WIDTH, kinds: Collection[str] = KINDS) -> DataFrame:
    """Marks of ``kinds``, those across bands not among them (``steps_between_bands``)."""
    rows = tables.measurements.select("plant_id", "run_id", "sensor_id", "sample_index", "time_s", "value")
    found: list[tuple[Column, Column]] = []  # condition, mark
    listed = []
    if CLOCK in kinds:
        rows = _with_clocks(rows, tables)
        listed.append(F.transform(F.coalesce("off", F.array()), lambda x: _mark(CLOCK, "run_id", "sensor_id", "sample_index", "time_s", expected_time_s=x)))
    if CHANNELS in kinds:
        rows = _with_channels(rows, tables)
    rows = dealt(rows.withColumn("band", F.expr(f"sample_index div {int(width)}L")), ("run_id", "band"), tables.measurements.count())
    if GAPS in kinds or ORDER in kinds:
        along = Window.partitionBy("run_id", "band", "sensor_id").orderBy("sample_index", "time_s", "value")
        there = F.lit(True)
        rows = rows.withColumns({
            "previous_tick": F.lag("sample_index").over(along), "previous_time_s": F.lag("time_s").over(along),
            "before": F.lag(there).over(along), "after": F.lead(there).over(along),
        })
        previous = {n: F.col(n) for n in ("previous_tick", "previous_time_s")}
        here = ("run_id", "sensor_id", "sample_index", "time_s")
        found += [(_gap(previous["previous_tick"]), _mark(GAPS, *here, **previous)), (_late(previous["previous_time_s"]), _mark(ORDER, *here, **previous))]
        found += [(F.col("before").isNull(), _mark(_FIRST, *here, "band")), (F.col("after").isNull(), _mark(_LAST, *here, "band"))]
    if DUPLICATES in kinds or CHANNELS in kinds:
        order = ("time_s", "value")
        whole = (Window.unboundedPreceding, Window.unboundedFollowing)
        same = Window.partitionBy("run_id", "band", "sample_index", "sensor_id").orderBy(*order)
        rows = rows.withColumns({"copy": F.row_number().over(same), "occurrences": F.count("*").over(same.rowsBetween(*whole))})
        found.append(((F.col("copy") == 1) & (F.col("occurrences") > 1), _mark(DUPLICATES, "run_id", "sensor_id", "sample_index", "occurrences")))
    if CHANNELS in kinds:
        # a tick that names one plant and has all its channels is complete; any other one is looked at by itself
        tick = Window.partitionBy("run_id", "band", "sample_index").orderBy("sensor_id", *order).rowsBetween(*whole)
        held = F.count(F.when(F.col("copy") == 1, F.col("channels"))).over(tick)
        rows = rows.withColumns({"one": F.min("plant_id").over(tick) == F.max("plant_id").over(tick), "held": held, "all": F.max("channels").over(tick)})
        complete = F.col("one") & (F.col("held") == F.coalesce("all", F.lit(0)))
        found.append((~complete, _mark(CHANNELS, "plant_id", "run_id", "sensor_id", "sample_index")))
    # most rows are sound and leave before anything is built of them
    broken = reduce(lambda a, b: a | b, [F.coalesce(condition, F.lit(False)) for condition, _ in found] + [F.col("off").isNotNull()] * bool(listed))
    every = F.concat(F.array_compact(F.array(*[F.when(condition, mark) for condition, mark in found])), *listed) if found else listed[0]
    return rows.where(broken).select(F.explode(every).alias("mark")).select("mark.*")


def _gap(previous: Column) -> Column:
    return F.col("sample_index") - previous - 1 > 0


def _late(previous: Column) -> Column:
    return ~(F.col("time_s") > previous)


def steps(marks: DataFrame, kind: str) -> DataFrame:
    """Marks of gaps or of instants that do not rise, inside bands and across them: the first row of a channel in a band
    follows the last one of the band before it that has rows."""
    edges = marks.where(F.col("kind").isin(_FIRST, _LAST)).select("kind", "run_id", "sensor_id", "sample_index", "time_s", "band")
    along = Window.partitionBy("run_id", "sensor_id").orderBy("band", "kind")
    crossed = edges.withColumns({"previous_tick": F.lag("sample_index").over(along), "previous_time_s": F.lag("time_s").over(along)}).where(F.col("kind") == _FIRST)
    broken = _gap(F.col("previous_tick")) if kind == GAPS else _late(F.col("previous_time_s"))
    columns = ("run_id", "sensor_id", "sample_index", "time_s", "previous_tick", "previous_time_s")
    return marks.where(F.col("kind") == kind).select(*columns).unionByName(crossed.where(broken).select(*columns))


def absent_channels(marks: DataFrame, tables: Tables) -> DataFrame:
    """Channels of a plant that are absent at a tick at which a run of it has others: of the ticks that are not complete, their
    plants' channels without the stored ones."""
    stored = marks.where(F.col("kind") == CHANNELS).select("plant_id", "run_id", "sample_index", "sensor_id")
    ticks = stored.where(F.col("plant_id").isNotNull()).select("plant_id", "run_id", "sample_index").distinct()
    due = ticks.join(declared(tables), "plant_id").alias("due")
    held = stored.select("run_id", "sample_index", "sensor_id").distinct().alias("held")
    same = [F.col(f"due.{c}").eqNullSafe(F.col(f"held.{c}")) for c in ("run_id", "sample_index", "sensor_id")]
    return due.join(held, reduce(lambda a, b: a & b, same), "left_anti").select("run_id", "sample_index", "sensor_id")
