"""Noise and series diagnostics: does a series of errors look like the noise specified, are
runs sampled and switched as defined, do repetitions repeat what they should."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.contract import INPUTS, STATES
from tickweave.functions.scalars import differs, on_clock
from tickweave.functions.stats import TAIL_BEYOND, root_mean_square
from tickweave.plans.bands import DEFAULT_WIDTH, Bands

MINIMUM_SAMPLES = 100
LARGEST_RATIO = 1.0e100
LARGEST_VALUE = 1.0e100
SCORES = ("mean_z", "spread_z", "lag_one_z", "beyond_one_sigma_z", "beyond_two_sigma_z")


def series_problems(errors: DataFrame) -> DataFrame:
    """(run, channel, problem): series outside the domain of the statistics. ``errors``:
    (run_id, variable_name, sample_index, error, sigma)."""
    e = F.col("error")
    found = errors.groupBy("run_id", "variable_name").agg(
        F.count(F.lit(1)).alias("n"), F.max(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))).alias("infinite"),
        F.max(F.abs(e)).alias("largest"), F.min("sigma").alias("sigma"),
    )
    positive = F.coalesce((F.col("sigma") > 0) & (F.col("sigma") < float("inf")), F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") < MINIMUM_SAMPLES, "too few samples"), F.when(F.col("infinite"), "not finite"),
            F.when(~F.col("infinite") & (F.col("largest") > LARGEST_VALUE), "beyond the domain"), F.when(~positive, "noise level not positive"),
            F.when(positive & ~F.col("infinite") & (F.col("largest") > LARGEST_RATIO * F.col("sigma")), "not noise of this level"),
        )
    )
    return found.select("run_id", "variable_name", F.explode(problems).alias("problem"))


def noise_statistics(errors: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Statistics of each error series with their z-scores, from one grouped aggregate. The
    product with the next sample comes from a banded lead, so a long series is spread."""
    keys = ["run_id", "variable_name"]
    stepped = Bands(tuple(keys), "sample_index", (), width).scan(errors, lead={"_next": "error"})
    s = F.col("error") / F.col("sigma")
    after = F.col("_next") / F.col("sigma")
    sums = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("sigma").alias("sigma"), F.avg("error").alias("mean"), F.avg(s * s).alias("_ms"), F.sum(s * s).alias("_ss"),
        F.sum(s * after).alias("_lag"), F.avg(F.when(F.abs(s) > 1.0, 1.0).otherwise(0.0)).alias("beyond_one_sigma"),
        F.avg(F.when(F.abs(s) > 2.0, 1.0).otherwise(0.0)).alias("beyond_two_sigma"), F.max(F.abs(s)).alias("largest_in_sigmas"),
    )
    n = F.col("n")
    lag_one = F.when(F.col("_ss") == 0.0, 0.0).otherwise(F.coalesce("_lag", F.lit(0.0)) / F.col("_ss"))

    def tail(column: str, k: int) -> Column:
        p = TAIL_BEYOND[k]
        return (F.col(column) - p) / F.sqrt(F.lit(p * (1.0 - p)) / n)

    return sums.select(
        *keys, "n", "sigma", "mean", (F.col("mean") * F.sqrt(n) / F.col("sigma")).alias("mean_z"), (F.col("sigma") * F.sqrt("_ms")).alias("rms"),
        ((F.pow("_ms", F.lit(1.0 / 3.0)) - (1.0 - F.lit(2.0) / (9.0 * n))) / F.sqrt(F.lit(2.0) / (9.0 * n))).alias("spread_z"),
        lag_one.alias("lag_one"), (lag_one * F.sqrt(n)).alias("lag_one_z"), "beyond_one_sigma", tail("beyond_one_sigma", 1).alias("beyond_one_sigma_z"),
        "beyond_two_sigma", tail("beyond_two_sigma", 2).alias("beyond_two_sigma_z"), "largest_in_sigmas",
    )


def correlations(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Pearson correlation per group and its z-score; a constant series has none."""
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), (F.min(x) == F.max(x)).alias("_cx"), (F.min(y) == F.max(y)).alias("_cy")
    )
    constant = F.col("_cx") | F.col("_cy")
    r = F.when(~constant, F.col("_c") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0)))
    return found.select(*keys, "n", r.alias("r"), (r * F.sqrt("n")).alias("z"), F.when(constant, "constant series").alias("problem"))


def within_run_pairs(wide: DataFrame) -> DataFrame:
    """The two readings of a run tick by tick. ``wide``: (run_id, sample_index, <state>...)."""
    return wide.select(F.concat_ws(": ", "run_id", F.lit(f"{STATES[0]} with {STATES[1]}")).alias("label"), F.col(STATES[0]).alias("x"), F.col(STATES[1]).alias("y"))


def declared_run_pairs(wide: DataFrame, pairs: DataFrame, crossed: bool) -> DataFrame:
    """Readings of declared pairs of runs (label, first_run, second_run) on equal ticks; every
    state with every state if ``crossed``, else each with itself. Which runs are compared is
    declared by the caller: the runs of a plant are not paired all with all."""
    a = wide.join(pairs, wide["run_id"] == pairs["first_run"]).select("label", "second_run", "sample_index", *[F.col(s).alias(f"a_{s}") for s in STATES])
    b = wide.select(F.col("run_id").alias("second_run"), "sample_index", *[F.col(s).alias(f"b_{s}") for s in STATES])
    both = a.join(b, ["second_run", "sample_index"])
    combos = [(s, t) for s in STATES for t in STATES if crossed or s == t]
    entries = F.array(*[F.struct(F.lit(f"{s} with {t}").alias("what"), F.col(f"a_{s}").alias("x"), F.col(f"b_{t}").alias("y")) for s, t in combos])
    return both.select("label", F.inline(entries)).select(F.concat_ws(": ", "label", "what").alias("label"), "x", "y")


def score_sheet(statistics: DataFrame, correlation_tables: list[DataFrame]) -> DataFrame:
    """(label, z): every z-score of every series and pair."""
    long = statistics.unpivot(["run_id", "variable_name"], list(SCORES), "score", "z")
    parts = [long.select(F.concat_ws(" ", "run_id", "variable_name", "score").alias("label"), "z")]
    parts += [c.where(F.col("z").isNotNull()).select("label", "z") for c in correlation_tables]
    return reduce(DataFrame.unionByName, parts)


def sheet_summary(sheet: DataFrame, z_limit: float = 4.0) -> DataFrame:
    size = F.abs("z")
    return sheet.agg(
        F.count(F.lit(1)).alias("n_scores"), F.max(size).alias("largest_abs_z"), F.max_by("label", F.struct(size, "label")).alias("largest_label"),
        F.count_if(size > z_limit).alias("outside_limit"), F.avg("z").alias("mean_of_scores"), root_mean_square("z").alias("rms_of_scores"),
    )


def switch_check(switches: DataFrame, expected: DataFrame) -> DataFrame:
    """Per run: input switches found, expected, and those on one side only or with other
    inputs. Both: (run_id, sample_index, inputs)."""
    a = switches.select("run_id", "sample_index", F.struct(*INPUTS).alias("found"))
    b = expected.select("run_id", "sample_index", F.struct(*INPUTS).alias("expected"))
    both = a.join(b, ["run_id", "sample_index"], "full_outer")
    counts = both.groupBy("run_id").agg(
        F.count("found").alias("n_found"), F.count("expected").alias("n_expected"), F.count_if(differs("found", "expected")).alias("n_different")
    )
    return counts.withColumn("as_defined", F.col("n_different") == 0)


def stored_runs(wide: DataFrame, runs: DataFrame, expected_rows: DataFrame, switches: DataFrame) -> DataFrame:
    """Per run: rows as expected, instants on the clock of the run, switches as defined.
    ``expected_rows``: (run_id, expected_rows); ``switches``: the result of ``switch_check``."""
    clock = runs.select("run_id", "start_time_s", "sampling_period_s")
    on = on_clock("time_s", F.col("start_time_s") + F.col("sample_index") * F.col("sampling_period_s"))
    found = wide.join(clock, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~on).alias("off_clock"))
    joined = found.join(expected_rows, "run_id", "left").join(switches.select("run_id", "as_defined"), "run_id", "left")
    return joined.select(
        "run_id", "n_rows", "off_clock", F.coalesce(F.col("n_rows") == F.col("expected_rows"), F.lit(False)).alias("rows_as_expected"),
        F.coalesce("as_defined", F.lit(True)).alias("switches_as_defined"),
    ).withColumn("ok", F.col("rows_as_expected") & (F.col("off_clock") == 0) & F.col("switches_as_defined"))


def observation_grid(wide: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per run: rows, whether the instants strictly increase, and input changes."""
    stepped = Bands(("run_id",), "sample_index", (), width).scan(wide, lag={"_t": "time_s", "_u": F.struct(*INPUTS)})
    moved = reduce(lambda a, b: a | b, [differs(i, F.col(f"_u.{i}")) for i in INPUTS])
    return stepped.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_if(F.col("time_s") <= F.col("_t")) == 0).alias("strictly_increasing"),
        F.count_if(F.col("_t").isNotNull() & moved).alias("input_changes"),
    )


def repetition(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per run of two realisations: rows, rows on one side only, rows whose instants, inputs
    or readings differ. A repetition differs in nothing; a new realisation of the noise
    differs in its readings and in nothing else."""
    columns = ["time_s", *STATES, *INPUTS]
    a = first.select("run_id", "sample_index", F.struct(*columns).alias("a"))
    b = second.select("run_id", "sample_index", F.struct(*columns).alias("b"))
    both = a.join(b, ["run_id", "sample_index"], "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()

    def any_differs(names) -> Column:
        return paired & reduce(lambda p, q: p | q, [differs(F.col(f"a.{c}"), F.col(f"b.{c}")) for c in names])

    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~paired).alias("one_side"), F.count_if(any_differs(["time_s"])).alias("instants_differ"),
        F.count_if(any_differs(INPUTS)).alias("inputs_differ"), F.count_if(any_differs(STATES)).alias("readings_differ"),
    )


def worst(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Largest value per group with its label; ties go to the first label."""
    ranked = F.struct(F.col(value).alias("v"), F.col(label).alias("l"))
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    tied = rows.join(top, keys).where(F.col(value) == F.col("_top")) if keys else rows
    if not keys:
        return rows.agg(F.max(value).alias("worst"), F.max_by(label, ranked).alias("label"))
    return tied.groupBy(*keys).agg(F.first("_top").alias("worst"), F.min(label).alias("label"))
