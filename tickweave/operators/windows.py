"""Event windows: excursions found in the known inputs, the ticks of each window by role,
and the division of a budget of windows into a fitting and a validation part.

What a layout asks of an excursion lies a bounded number of ticks around its onset, so the
wide rows are read once, in overlapping bands, however long a run is. From there on only
onsets, a small table, are handled.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.contract import CHANNELS, INPUTS, NOMINAL_PARAMETER_OF, PERIOD_S, STATES, Tables, constant
from tickweave.functions.scalars import clock_instant, concordance, corner_label, differs, on_clock, sign_of
from tickweave.functions.stats import safe_mean
from tickweave.plans.bands import DEFAULT_WIDTH, Bands, Neighbourhood
from tickweave.session import cut_lineage

CONTEXT_READINGS = 10
# Fixed values: (protocol, rows the moved inputs are held, ((phase, scored readings), ...)).
LAYOUTS = (
    ("p3", 20, (("excursion", 20), ("return", 50), ("settled", 40))),
    ("step", 100, (("hold transient", 50), ("hold settled", 50), ("recovery transient", 50), ("recovery settled", 50))),
)
BUDGETS = (2, 5, 10, 20, 40)


def layouts(spark: SparkSession) -> DataFrame:
    rows = [(name, hold, sum(n for _, n in phases)) for name, hold, phases in LAYOUTS]
    return constant(spark, rows, "protocol string, hold long, scored_readings long")


def phases(spark: SparkSession) -> DataFrame:
    """(protocol, phase, order, first and last offset after the onset)."""
    rows = []
    for name, _, parts in LAYOUTS:
        start = 1
        for order, (phase, readings) in enumerate(parts):
            rows.append((name, phase, order, start, start + readings - 1))
            start += readings
    return constant(spark, rows, "protocol string, phase string, phase_order int, first_offset long, last_offset long")


def nominal_inputs(parameters: DataFrame) -> DataFrame:
    """One row per plant with its known nominal inputs, named nominal_<input>."""
    return parameters.groupBy("plant_id").agg(
        *[F.max(F.when(F.col("parameter") == NOMINAL_PARAMETER_OF[i], F.col("value"))).alias(f"nominal_{i}") for i in INPUTS]
    )


def run_preconditions(tables: Tables, aligned: DataFrame) -> DataFrame:
    """(run_id, problem): runs on which no window is formed."""
    spark = aligned.sparkSession
    names = ("variable_name", "channel_kind", "channel_index", "unit")
    expected = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, c[:4], strict=True)]) for c in CHANNELS])
    own = tables.sensors.select("plant_id", "variable_name", "channel_kind", "channel_index", "unit")
    wanted = own.select("plant_id").distinct().select("plant_id", F.inline(expected))
    keys = ["plant_id", "variable_name", "channel_kind", "channel_index", "unit"]
    plants = wanted.join(own, keys, "left_anti").select("plant_id").unionByName(own.join(wanted, keys, "left_anti").select("plant_id")).distinct()
    runs = tables.operating_runs
    channels = runs.join(plants, "plant_id", "left_semi").select("run_id", F.lit("channels").alias("problem"))
    no_layout = runs.join(layouts(spark).select(F.col("protocol").alias("operating_mode")), "operating_mode", "left_anti").select("run_id", F.lit("no layout").alias("problem"))
    period = runs.where(differs("sampling_period_s", F.lit(PERIOD_S))).select("run_id", F.lit("period").alias("problem"))
    clock = runs.select("run_id", F.col("start_time_s").alias("_start"))
    timed = aligned.join(clock, "run_id")
    whole = timed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"),
        F.count_if(~F.col("complete")).alias("incomplete"),
        F.count_if(~on_clock("time_s", clock_instant("sample_index", "_start", F.lit(PERIOD_S)))).alias("off_clock"),
    )
    broken = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("incomplete") > 0) | (F.col("off_clock") > 0)
    ticks = whole.where(broken).select("run_id", F.lit("not consecutive ticks").alias("problem"))
    return channels.unionByName(no_layout).unionByName(period).unionByName(ticks)


def onset_rows(aligned: DataFrame, nominal: DataFrame, modes: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The first row of every excursion with the outcome of what surrounds it. A layout looks
    ten ticks back and a few hundred ahead, so the rows are spread over bands with that
    overlap and read once."""
    spark = aligned.sparkSession
    shape = modes.join(layouts(spark), F.col("operating_mode") == F.col("protocol")).select("run_id", "protocol", "hold", "scored_readings")
    at_nominal = concordance([F.col(i) for i in INPUTS], [F.col(f"nominal_{i}") for i in INPUTS])
    rows = aligned.select("plant_id", "run_id", "sample_index", *INPUTS).join(nominal, "plant_id").join(shape, "run_id")
    rows = rows.select("run_id", "sample_index", "protocol", "hold", "scored_readings", *INPUTS, (~at_nominal).alias("moved"))
    longest = max(sum(n for _, n in parts) for _, _, parts in LAYOUTS)
    near = Neighbourhood(("run_id",), "sample_index", CONTEXT_READINGS, longest, width)
    w = near.window()
    judged = near.spread(rows)
    judged = judged.select(
        "*", F.lag("moved").over(w).alias("_moved_before"),
        F.count_if(~F.col("moved")).over(w.rangeBetween(-CONTEXT_READINGS, -1)).alias("_calm"),
    )
    for name, hold, parts in LAYOUTS:  # one frame per declared layout
        length = sum(n for _, n in parts)
        held, rest = w.rangeBetween(0, hold - 1), w.rangeBetween(hold, length - 1)
        steady = F.lit(True)
        for i in INPUTS:
            steady = steady & (F.min(i).over(held) == F.max(i).over(held))
        judged = judged.withColumn(f"_steady_{name}", steady).withColumn(
            f"_late_{name}", F.coalesce(F.max("moved").over(rest), F.lit(False)) if length > hold else F.lit(False)
        )
    onset = F.col("moved") & ~F.coalesce("_moved_before", F.lit(False))
    first = near.gather(judged).where(onset)

    def of_layout(prefix: str) -> Column:
        return F.coalesce(*[F.when(F.col("protocol") == name, F.col(f"{prefix}_{name}")) for name, _, _ in LAYOUTS])

    return first.select(
        "run_id", "protocol", F.col("sample_index").alias("onset"), "hold", "scored_readings", *INPUTS,
        (F.col("_calm") < CONTEXT_READINGS).alias("no_context"), (~of_layout("_steady")).alias("moved_again"), of_layout("_late").alias("late"),
    )


def excursions(aligned: DataFrame, nominal: DataFrame, modes: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every excursion of every run with its outcome, ``window``, ``skipped`` or ``refused``,
    and the reason. ``modes``: (run_id, operating_mode). The inputs are compared exactly with
    the nominal ones: both are known, none is measured.

    Excursions are few against rows and everything below reads them several times, so they
    are cut from their lineage here.
    """
    ends = aligned.groupBy("run_id").agg(F.max("sample_index").alias("last_tick"))
    found = cut_lineage(onset_rows(aligned, nominal, modes, width).join(ends, "run_id"))
    reason = (
        F.when(F.col("no_context"), "no context")
        .when(F.col("onset") + F.col("scored_readings") > F.col("last_tick"), "run ends before the last scored reading")
        .when(F.col("moved_again"), "inputs change inside the hold").when(F.col("late"), "inputs not nominal in the rest of the window")
    )
    judged = found.withColumn("_reason", reason)
    kept = F.col("_reason").isNull()
    numbered = Bands(("run_id",), "onset", (), width).scan(
        judged, lead={"next_onset": "onset"},
        running={"excursion": ("sum", F.lit(1).cast("long")), "position": ("sum", kept.cast("long"))},
        before={"_scored_before": ("max", F.when(kept, F.col("onset") + F.col("scored_readings")))},
    )
    overlap = kept & F.coalesce(F.col("onset") - CONTEXT_READINGS + 1 <= F.col("_scored_before"), F.lit(False))
    final = F.when(overlap, "context inside the window before").otherwise(F.col("_reason"))
    return numbered.select(
        "run_id", "protocol", "excursion", "onset", "hold", "scored_readings", "last_tick", "next_onset", *INPUTS, "position",
        F.when(final.isNull(), "window").when(final.isin("no context", "run ends before the last scored reading"), "skipped")
        .otherwise("refused").alias("outcome"),
        final.alias("reason"),
    )


def never_nominal(aligned: DataFrame, nominal: DataFrame) -> DataFrame:
    """Runs without a single row at the nominal inputs: the two disagree, and no window of
    such a run is believed."""
    at_nominal = concordance([F.col(i) for i in INPUTS], [F.col(f"nominal_{i}") for i in INPUTS])
    rows = aligned.select("plant_id", "run_id", *INPUTS).join(nominal, "plant_id")
    return rows.groupBy("run_id").agg(F.max(at_nominal).alias("any")).where(~F.col("any")).select("run_id", F.lit("never nominal").alias("problem"))


def find_windows(found: DataFrame, refused_runs: DataFrame | None = None) -> DataFrame:
    """Windows of the runs that break no rule, numbered in time (``position``)."""
    bad = found.where(F.col("outcome") == "refused").select("run_id").distinct()
    if refused_runs is not None:
        bad = bad.unionByName(refused_runs.select("run_id")).distinct()
    windows = found.where(F.col("outcome") == "window").join(bad, "run_id", "left_anti")
    return windows.select(
        "run_id", "protocol", "excursion", "position", "onset", "scored_readings", "last_tick", "next_onset", *INPUTS,
        (F.col("onset") - CONTEXT_READINGS + 1).alias("context_start"), (F.col("onset") + F.col("scored_readings")).alias("scored_end"),
    )


def _spans() -> Column:
    """The ticks of a window by role; at most a few hundred, by its layout."""
    onset, length = F.col("onset"), F.col("scored_readings")
    spans = (("context", F.col("context_start"), onset), ("scored", onset + 1, onset + length), ("input", onset, onset + length - 1))
    return F.array(*[F.struct(F.lit(n).alias("role"), F.sequence(a, b).alias("ticks")) for n, a, b in spans])


def window_ticks(windows: DataFrame) -> DataFrame:
    """(run, excursion, tick, role, offset after the onset, phase): context, scored and
    input rows of every window."""
    spans = windows.select("run_id", "excursion", "protocol", "onset", F.inline(_spans()))
    ticks = spans.select("*", F.explode("ticks").alias("sample_index")).withColumn("offset", F.col("sample_index") - F.col("onset"))
    phase = F.lit(None).cast("string")
    for name, _, parts in LAYOUTS:
        start = 1
        for label, readings in parts:
            here = (F.col("protocol") == name) & (F.col("role") == "scored") & F.col("offset").between(start, start + readings - 1)
            phase = F.when(here, label).otherwise(phase)
            start += readings
    return ticks.select("run_id", "excursion", "sample_index", "role", "offset", phase.alias("phase"))


def window_data(ticks: DataFrame, aligned: DataFrame) -> DataFrame:
    """The rows of every window by role: an equality join on (run, tick), never a range join. The
    ticks are exploded, which the size estimate does not see; the join is a merge, so they are not broadcast."""
    values = aligned.select("run_id", "sample_index", "time_s", *STATES, *INPUTS)
    return ticks.hint("merge").join(values, ["run_id", "sample_index"])


def initial_states(data: DataFrame) -> DataFrame:
    """Mean of the context readings of every window, added in the order of their ticks: rows leave a
    shuffle in any order, and a mean that stands on a bound must not fall now on one side of it, now on
    the other. A window has ``CONTEXT_READINGS`` of them, so they fit an array."""
    context = data.where(F.col("role") == "context")
    readings = context.groupBy("run_id", "excursion").agg(F.array_sort(F.collect_list(F.struct("sample_index", *STATES))).alias("readings"))
    return readings.select("run_id", "excursion", *[safe_mean(F.col(f"readings.{s}")).alias(f"initial_{s}") for s in STATES])


def split_budgets(windows: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Windows of every budget a run can fill, with their part. The last max(1, b div 5) of
    the first b windows validate; the others fit."""
    if not budgets or any(isinstance(b, bool) or not isinstance(b, int) or b < 2 for b in budgets):
        raise ValueError(f"a budget is a whole number of windows, 2 or more, got {budgets!r}")
    declared = F.array(*[F.lit(int(b)).cast("long") for b in sorted(set(budgets))])
    counts = windows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_windows"))
    fits = windows.join(counts, "run_id").withColumn("budget", F.explode(declared)).where(
        (F.col("n_windows") >= F.col("budget")) & (F.col("position") <= F.col("budget"))
    )
    fitting = F.col("position") <= F.col("budget") - F.greatest(F.lit(1), F.expr("budget div 5"))
    return fits.withColumn("part", F.when(fitting, "fitting").otherwise("validation"))


def refused_budgets(windows: DataFrame, runs: DataFrame, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    declared = F.array(*[F.lit(int(b)).cast("long") for b in budgets])
    counts = windows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_windows"))
    every = runs.select("run_id").distinct().join(counts, "run_id", "left").withColumn("budget", F.explode(declared))
    return every.select("run_id", "budget", F.coalesce("n_windows", F.lit(0)).alias("n_windows")).where(F.col("n_windows") < F.col("budget"))


def prefix_ends(parts: DataFrame) -> DataFrame:
    """Last tick of the prefix a budget spans: the onset after its last window, else the end
    of the run."""
    last = parts.groupBy("run_id", "budget").agg(F.max_by(F.coalesce("next_onset", "last_tick"), "onset").alias("prefix_end"))
    return last


def _part_ticks(parts: DataFrame) -> DataFrame:
    """One row per (run, budget, tick) of a budget: what the tick is to it. The grouping is
    by tick, so a budget of many windows is spread."""
    ticks = parts.select("run_id", "budget", "part", F.inline(_spans())).select("run_id", "budget", "part", "role", F.explode("ticks").alias("tick"))

    return ticks.groupBy("run_id", "budget", "tick").agg(
        *[F.max((F.col("part") == p) & (F.col("role") == r)).alias(f"{p}_{r}") for p in ("fitting", "validation") for r in ("context", "scored", "input")]
    )


def part_indices(parts: DataFrame) -> DataFrame:
    """Ticks of each budget by part and role, and those of its prefix that are unused."""
    t = _part_ticks(parts)
    context = F.col("fitting_context") | F.col("validation_context")
    scored = F.col("fitting_scored") | F.col("validation_scored")
    counts = t.groupBy("run_id", "budget").agg(
        *[F.count_if(c).alias(f"{c}_ticks") for c in t.columns if c.startswith(("fitting_", "validation_"))],
        F.count_if(context | scored).alias("_used"),
    )
    return counts.join(prefix_ends(parts), ["run_id", "budget"]).select(
        *[c for c in counts.columns if c != "_used"], "prefix_end", (F.col("prefix_end") + 1 - F.col("_used")).alias("unused_ticks")
    )


def split_integrity(parts: DataFrame) -> DataFrame:
    """Per budget: ticks that are both context and scored, shared by F and V, or beyond the
    prefix; all must be zero."""
    t = _part_ticks(parts).join(prefix_ends(parts), ["run_id", "budget"])
    context = F.col("fitting_context") | F.col("validation_context")
    scored = F.col("fitting_scored") | F.col("validation_scored")
    fit = F.col("fitting_context") | F.col("fitting_scored") | F.col("fitting_input")
    val = F.col("validation_context") | F.col("validation_scored") | F.col("validation_input")
    counts = t.groupBy("run_id", "budget").agg(
        F.count_if(context & scored).alias("context_and_scored"), F.count_if(fit & val).alias("shared"),
        F.count_if(F.col("tick") > F.col("prefix_end")).alias("beyond_prefix"),
    )
    sizes = parts.groupBy("run_id", "budget").agg(
        F.count_if(F.col("part") == "fitting").alias("n_fitting"), F.count_if(F.col("part") == "validation").alias("n_validation")
    )
    return counts.join(sizes, ["run_id", "budget"])


def onset_signs(windows: DataFrame, nominal: DataFrame, runs: DataFrame) -> DataFrame:
    """Sign of each input at the onset of each window, and the corner they form."""
    plants = runs.select("run_id", "plant_id").join(nominal, "plant_id")
    signed = windows.join(plants, "run_id").select(
        "run_id", "excursion", *[sign_of(i, f"nominal_{i}").cast("long").alias(f"s_{i}") for i in INPUTS]
    )
    return signed.withColumn("corner", corner_label([f"s_{i}" for i in INPUTS]))


def excitation(parts: DataFrame, signs: DataFrame) -> DataFrame:
    """Distinct corners of a part and the exact rank of its sign vectors.

    The rank of a matrix is that of the Gram matrix of its distinct rows, and the rank of a
    Gram matrix is the largest k for which the sum of its principal k x k minors is not
    zero. There are at most 81 sign vectors, so all of this is small exact integers.
    """
    names = [f"s_{i}" for i in INPUTS]
    distinct = parts.join(signs, ["run_id", "excursion"]).select("run_id", "budget", "part", "corner", *names).distinct()
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    gram = distinct.groupBy("run_id", "budget", "part").agg(
        F.count(F.lit(1)).alias("distinct_corners"),
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}{j}") for i, j in pairs],
    )

    def g(i: int, j: int) -> Column:
        return F.col(f"g{min(i, j)}{max(i, j)}")

    def minor(rows: tuple[int, ...], columns: tuple[int, ...]) -> Column:
        if len(rows) == 1:
            return g(rows[0], columns[0])
        total = F.lit(0)
        for position, column in enumerate(columns):
            rest = columns[:position] + columns[position + 1 :]
            term = g(rows[0], column) * minor(rows[1:], rest)
            total = total + term if position % 2 == 0 else total - term
        return total

    def principal(k: int) -> Column:
        total = F.lit(0)
        for chosen in combinations(range(4), k):
            total = total + minor(chosen, chosen)
        return total

    rank = F.lit(0)
    for k in (1, 2, 3, 4):
        rank = F.when(principal(k) != 0, k).otherwise(rank)
    return gram.select("run_id", "budget", "part", "distinct_corners", rank.alias("rank"))


def corner_counts(signs: DataFrame) -> DataFrame:
    return signs.groupBy("corner").agg(F.count(F.lit(1)).alias("n_windows"))


def off_design_corners(signs: DataFrame) -> DataFrame:
    """Windows whose inputs are not at one of the sixteen corners of the design."""
    return signs.where(~F.col("corner").rlike(r"^[+-]{4}\z")).select("run_id", "excursion", "corner")
