"""Analysis of stored trajectories: (case_id, segment, i, time_s, C_A, T, inputs, ...), where i
counts the samples of a case and a segment has constant inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.contract import INPUTS
from tickweave.functions.scalars import concordance, differs, nearest_tick, on_clock, ulp
from tickweave.functions.stats import root_mean_square
from tickweave.plans.bands import DEFAULT_WIDTH, Bands

SLACK = 1.0e-9


def _first_of(value: str) -> Column:
    """Order that prefers the largest value and, among equals, the earliest sample."""
    return F.struct(F.col(value), -F.col("i"))


def ranges_and_peaks(trajectory: DataFrame, value: str) -> DataFrame:
    """Smallest and largest value per case, and the first instant of the largest."""
    return trajectory.groupBy("case_id").agg(
        F.min(value).alias("smallest"), F.max(value).alias("peak"), F.max_by("time_s", _first_of(value)).alias("peak_t"), F.count(F.lit(1)).alias("n")
    )


def refined_peaks(trajectory: DataFrame, value: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Estimate of the peak between samples: the largest vertex of the concave parabolas
    through three neighbours of a segment, or the largest sample. A triple answers for the
    interval between its midpoints; the first and last also for the rest of the segment."""
    keys = ("case_id", "segment")
    ends = trajectory.groupBy(*keys).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    here = F.struct("i", F.col("time_s").alias("t"), F.col(value).alias("v"))
    rows = Bands(keys, "i", (), width).scan(trajectory.select(*keys, "i", "time_s", value), lag={"p": here}, lead={"s": here}).join(ends, list(keys))
    t0, t1, t2 = F.col("p.t"), F.col("time_s"), F.col("s.t")
    y0, y1, y2 = F.col("p.v"), F.col(value), F.col("s.v")
    spaced = rows.where((t1 > t0) & (t2 > t1))
    left, right = (y1 - y0) / (t1 - t0), (y2 - y1) / (t2 - t1)
    curved = spaced.withColumn("_left", left).withColumn("_curve", (right - left) / (t2 - t0)).where(F.col("_curve") < 0.0)
    at = F.lit(0.5) * (t0 + t1) - F.col("_left") / (F.lit(2.0) * F.col("_curve"))
    low = F.when(F.col("p.i") == F.col("_first"), t0).otherwise(F.lit(0.5) * (t0 + t1))
    high = F.when(F.col("s.i") == F.col("_last"), t2).otherwise(F.lit(0.5) * (t1 + t2))
    vertices = curved.withColumn("_at", at).where((F.col("_at") >= low) & (F.col("_at") <= high))
    height = y0 + F.col("_left") * (F.col("_at") - t0) + F.col("_curve") * (F.col("_at") - t0) * (F.col("_at") - t1)
    best = vertices.withColumn("_height", height).groupBy("case_id").agg(F.max("_height").alias("vertex"), F.max_by("_at", _first_of("_height")).alias("vertex_t"))
    samples = ranges_and_peaks(trajectory, value).select("case_id", "peak", "peak_t")
    higher = F.coalesce(F.col("vertex") > F.col("peak"), F.lit(False))
    return samples.join(best, "case_id", "left").select(
        "case_id", "peak", "peak_t", F.when(higher, F.col("vertex")).otherwise(F.col("peak")).alias("refined_peak"),
        F.when(higher, F.col("vertex_t")).otherwise(F.col("peak_t")).alias("refined_t"),
    )


def time_above(trajectory: DataFrame, value: str, limit: float, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Seconds above a limit: the trapezoid rule on the indicator, along the whole case."""
    above = F.when(F.col(value) > limit, 1.0).otherwise(0.0)
    rows = Bands(("case_id",), "i", (), width).scan(trajectory.select("case_id", "i", "time_s", above.alias("above")), lead={"_t": "time_s", "_above": "above"})
    piece = F.lit(0.5) * (F.col("above") + F.col("_above")) * (F.col("_t") - F.col("time_s"))
    return rows.groupBy("case_id").agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("seconds_above"))


def balance_closure(trajectory: DataFrame, tolerance: float) -> DataFrame:
    """Closure of the mass and energy balances per case. The terms are given columns:
    feed_of_a, rate, feed_heat, reaction_heat, exchanged_heat. Each segment, evenly sampled,
    is integrated with composite Simpson weights by sample parity; with an odd number of
    intervals the last one by the trapezoid rule, and the segment says so."""
    keys = ["case_id", "segment"]
    span = trajectory.groupBy(*keys).agg(
        F.min("i").alias("_first"), F.max("i").alias("_last"), ((F.max("time_s") - F.min("time_s")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("_h"),
        *[F.min_by(v, "i").alias(f"_{v}0") for v in ("C_A", "T")], *[F.max_by(v, "i").alias(f"_{v}1") for v in ("C_A", "T")],
    )
    rows = trajectory.join(span, keys)
    n = F.col("_last") - F.col("_first")
    even = n - n % 2
    j = F.col("i") - F.col("_first")
    simpson = F.when((j == 0) | (j == even), 1.0).when(j % 2 == 1, 4.0).otherwise(2.0) / 3.0
    weight = F.when(even == 0, 0.0).otherwise(F.when(j <= even, simpson).otherwise(0.0)) + F.when(
        n % 2 == 1, F.when(j >= even, 0.5).otherwise(0.0)
    ).otherwise(0.0)
    w = F.coalesce(F.col("_h"), F.lit(0.0)) * weight
    mass, heat = F.col("feed_of_a") - F.col("rate"), F.col("feed_heat") + F.col("reaction_heat") - F.col("exchanged_heat")

    def size(names) -> Column:
        return reduce(lambda a, b: a + b, [F.abs(c) for c in names])

    per = rows.groupBy(*keys).agg(
        F.sum(w * mass).alias("mi"), F.sum(w * heat).alias("ei"), F.sum(w * size(("feed_of_a", "rate"))).alias("ms"),
        F.sum(w * size(("feed_heat", "reaction_heat", "exchanged_heat"))).alias("es"), F.sum(w * F.col("rate")).alias("reacted"),
        F.sum(w * F.col("reaction_heat")).alias("heating"), F.first("_C_A0").alias("c0"), F.first("_C_A1").alias("c1"), F.first("_T0").alias("t0"), F.first("_T1").alias("t1"),
        (F.max(n) % 2 == 1).alias("odd"),
    )

    def resolution(a: str, b: str) -> Column:
        return ulp(F.greatest(F.abs(a), F.abs(b)))

    cases = per.groupBy("case_id").agg(
        F.sum(F.abs(F.col("c1") - F.col("c0") - F.col("mi"))).alias("mass_residual"), F.sum("ms").alias("mass_scale"), F.sum(resolution("c0", "c1")).alias("mass_resolution"),
        F.sum(F.abs(F.col("t1") - F.col("t0") - F.col("ei"))).alias("energy_residual"), F.sum("es").alias("energy_scale"), F.sum(resolution("t0", "t1")).alias("energy_resolution"),
        F.sum("reacted").alias("reacted"), F.sum("heating").alias("reaction_heating"), F.count_if("odd").alias("odd_segments"),
    )

    def relative(name: str) -> Column:
        r, s, e = F.col(f"{name}_residual"), F.col(f"{name}_scale"), F.col(f"{name}_resolution")
        return F.when(s > 0.0, r / s).when(r <= e, 0.0).otherwise(float("inf"))

    closes = reduce(lambda a, b: a & b, [F.col(f"{n}_residual") <= tolerance * F.col(f"{n}_scale") + F.col(f"{n}_resolution") for n in ("mass", "energy")])
    return cases.select("*", relative("mass").alias("relative_mass_residual"), relative("energy").alias("relative_energy_residual"), closes.alias("closes"))


def verdicts(trajectory: DataFrame, low: float, high: float, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per case: values finite, states possible under the inputs applied so far, inside the
    temperature envelope."""
    start = trajectory.groupBy("case_id").agg(F.min_by("C_A", "i").alias("_c0"), F.min_by("T", "i").alias("_t0"))
    rows = Bands(("case_id",), "i", (), width).scan(
        trajectory, running={"_rich": ("max", F.col("C_Af")), "_cold": ("min", F.least("T_f", "T_c"))}
    ).join(start, "case_id")
    rich, cold = F.greatest("_rich", "_c0"), F.least("_cold", "_t0")
    positive = reduce(lambda a, b: a & b, [F.col(i) > 0.0 for i in INPUTS])
    physical = positive & (F.col("C_A") > 0.0) & (F.col("C_A") <= rich * (1.0 + SLACK)) & (F.col("T") >= cold * (1.0 - SLACK))
    bounded = reduce(lambda a, b: a & b, [~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("C_A", "T", "time_s")])
    return rows.groupBy("case_id").agg(
        F.bool_and(bounded).alias("values_finite"), F.bool_and(physical).alias("states_physical"),
        ((F.min("T") >= low) & (F.max("T") <= high)).alias("inside_envelope"),
    )


def on_sensor_clock(trajectory: DataFrame, period: float) -> DataFrame:
    """The samples of a dense series that are instants of the sensor clock, with their tick.
    The clock starts at the first instant of the case; nothing is interpolated."""
    start = trajectory.groupBy("case_id").agg(F.min("time_s").alias("_start"))
    rows = trajectory.join(start, "case_id")
    tick = nearest_tick("time_s", "_start", F.lit(period))
    ticked = rows.withColumn("tick", tick)
    return ticked.where(on_clock("time_s", F.col("_start") + F.col("tick") * F.lit(period))).drop("_start")


def subsampling_problems(trajectory: DataFrame, period: float, width: int = DEFAULT_WIDTH) -> DataFrame:
    """(case, problem, n): sensor instants that are not stored, stored twice, or inputs that
    change between two of them."""
    sampled = on_sensor_clock(trajectory, period)
    span = trajectory.groupBy("case_id").agg(F.min("time_s").alias("_start"), F.max("time_s").alias("_end"))
    # the last instant of the clock that the case reaches; a quotient alone may fall one short of it
    about = F.floor((F.col("_end") - F.col("_start")) / period)
    reached = F.when(F.col("_start") + (about + 1) * F.lit(period) <= F.col("_end"), about + 1).when(F.col("_start") + about * F.lit(period) <= F.col("_end"), about).otherwise(about - 1)
    per_tick = sampled.groupBy("case_id", "tick").agg(F.count(F.lit(1)).alias("n"))
    found = per_tick.groupBy("case_id").agg(F.count(F.lit(1)).alias("ticks"), F.max("tick").alias("last"), F.count_if(F.col("n") > 1).alias("twice"))
    held = found.join(span, "case_id").select("case_id", "twice", (F.greatest(reached, "last") + 1 - F.col("ticks")).alias("missing"))
    stepped = Bands(("case_id",), "i", (), width).scan(trajectory, lag={"_u": F.struct(*INPUTS)})
    changed = stepped.where(F.col("_u").isNotNull() & ~concordance([F.col(c) for c in INPUTS], [F.col(f"_u.{c}") for c in INPUTS])).select("case_id", "i")
    between = changed.join(sampled.select("case_id", "i"), ["case_id", "i"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("between"))
    counts = held.join(between, "case_id", "left").select("case_id", "missing", "twice", F.coalesce("between", F.lit(0)).alias("between"))
    return counts.unpivot(["case_id"], ["missing", "twice", "between"], "problem", "n").where(F.col("n") > 0)


def phase_differences(first: DataFrame, second: DataFrame, keys: list[str], value: str, sigma: float) -> DataFrame:
    """Second minus first on equal (keys, i), over the whole run and by phase: largest, root
    mean square, samples, share above zero, and both in units of sigma. ``first`` also names
    the phase of each sample."""
    b = second.select(*keys, "i", F.col(value).alias("_b"))
    d = first.select(*keys, "i", "phase", F.col(value).alias("_a")).join(b, [*keys, "i"]).withColumn("d", F.col("_b") - F.col("_a"))
    sets = [[F.col(k) for k in keys], [F.col(k) for k in keys] + [F.col("phase")]]
    grouped = d.groupingSets(sets, *[F.col(k) for k in keys], F.col("phase")).agg(
        F.grouping_id().alias("_grain"),
        F.count(F.lit(1)).alias("n"), F.max(F.abs("d")).alias("largest"), root_mean_square("d").alias("rms"), F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("share_above"),
    )
    return grouped.select(
        *keys, F.when(F.col("_grain") == 0, F.col("phase")).otherwise("whole run").alias("phase"), "n", "largest", "rms", "share_above",
        (F.col("largest") / sigma).alias("largest_in_sigmas"), (F.col("rms") / sigma).alias("rms_in_sigmas"),
    )


def first_moves(trajectory: DataFrame, value: str) -> DataFrame:
    """Per segment: the direction of the first move, the extreme in that direction, where it
    lies, and how far it is beyond the end. Where the first sample does not move, the
    direction is that of the largest deviation from the start."""
    keys = ["case_id", "segment"]
    v = F.col(value)
    per = trajectory.groupBy(*keys).agg(
        F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.min_by(v, "i").alias("_v0"), F.max_by(v, "i").alias("_end"), F.max(v).alias("_hi"), F.min(v).alias("_lo"),
        F.max_by("i", F.struct(v, -F.col("i"))).alias("_hi_i"), F.min_by("i", F.struct(v, "i")).alias("_lo_i"),
        F.max_by("time_s", F.struct(v, -F.col("i"))).alias("_hi_t"), F.min_by("time_s", F.struct(v, "i")).alias("_lo_t"),
    )
    second = trajectory.select(*keys, F.col("i").alias("_i"), v.alias("_v1"))
    both = per.join(second, [per["case_id"] == second["case_id"], per["segment"] == second["segment"], second["_i"] == per["_i0"] + 1], "left").select(
        *[per[c] for c in per.columns], "_v1"
    )
    up, down = F.col("_hi") - F.col("_v0"), F.col("_v0") - F.col("_lo")
    largest = F.when(up > down, 1).when(down > up, -1).when(up == 0.0, 0).when(F.col("_hi_i") < F.col("_lo_i"), 1).otherwise(-1)
    step = F.col("_v1") - F.col("_v0")
    direction = F.when(step > 0, 1).when(step < 0, -1).otherwise(largest)
    rising = F.col("direction") > 0
    at = F.when(rising, F.col("_hi_i")).otherwise(F.col("_lo_i"))
    extreme = F.when(rising, F.col("_hi")).otherwise(F.col("_lo"))
    return both.withColumn("direction", direction).select(
        *keys, "direction", extreme.alias("extreme"), F.when(rising, F.col("_hi_t")).otherwise(F.col("_lo_t")).alias("extreme_t"),
        ((at > F.col("_i0")) & (at < F.col("_i1"))).alias("inside"), F.col("_end").alias("value_at_end"), F.abs(extreme - F.col("_end")).alias("beyond_end"),
    )


def settle_residuals(trajectory: DataFrame, reference: dict[str, float]) -> DataFrame:
    """Distance of the last sample of every segment from a reference state."""
    return trajectory.groupBy("case_id", "segment").agg(*[F.abs(F.max_by(v, "i") - F.lit(r)).alias(f"residual_{v}") for v, r in reference.items()])


def worst_cases(cases: DataFrame, keys: list[str], value: str, accepted: str) -> DataFrame:
    """Worst case of a grid with its label (the first on ties), and how many were rejected."""
    return cases.groupBy(*keys).agg(
        F.max(value).alias("worst"), F.max_by("case_id", F.struct(F.col(value), F.col("case_id"))).alias("worst_case"), F.count(F.lit(1)).alias("n_cases"),
        F.count_if(~F.col(accepted)).alias("n_rejected"),
    )


def rejected_cases(cases: DataFrame, accepted: str) -> DataFrame:
    return cases.where(~F.col(accepted))


def valid_comparisons(pairs: DataFrame, checks: DataFrame) -> DataFrame:
    """(first_case, second_case, valid): the first must be accepted in full; the second may
    leave the envelope, nothing else."""
    full = F.col("values_finite") & F.col("states_physical") & F.col("inside_envelope")
    a = checks.select(F.col("case_id").alias("first_case"), full.alias("_a"))
    b = checks.select(F.col("case_id").alias("second_case"), (F.col("values_finite") & F.col("states_physical")).alias("_b"))
    return pairs.join(a, "first_case").join(b, "second_case").select("first_case", "second_case", (F.col("_a") & F.col("_b")).alias("valid"))


def switching_instants(segments: DataFrame, keys: list[str], period: float, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Instants at which declared segments end: running sums of their durations, and whether
    each is a tick of the clock. ``segments``: (*keys, position, duration_s)."""
    summed = Bands(tuple(keys), "position", (), width).scan(segments, running={"ends_at_s": ("sum", F.col("duration_s"))})
    tick = nearest_tick("ends_at_s", F.lit(0.0), F.lit(period))
    return summed.withColumn("tick", tick).withColumn("on_clock", on_clock("ends_at_s", F.col("tick") * F.lit(period)))


def changed_between(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    b = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return first.join(b, keys).where(reduce(lambda p, q: p | q, [differs(v, f"_{v}") for v in values])).select(*keys)
