import math
import random
import statistics

import pytest
from plants import NORTH, SOUTH, log, without
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.functions import scalars as S
from tickweave.operators import integrity, rowpass, series
from tickweave.plans.bands import Bands, Neighbourhood
from tickweave.plans import dealing, medians
from tickweave.plans.medians import grouped_median


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_banded_scan_equals_plain_windows(spark, width):
    rng = random.Random(width)
    data = [(rng.choice("abb"), t, rng.randint(0, 9)) for t in rng.sample(range(200), 120)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint")
    got = Bands(("k",), "t", ("v",), width).scan(
        df, lag={"p": "v"}, lead={"n": "v"}, running={"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, before={"b": ("min", F.col("v"))}
    )
    w = Window.partitionBy("k").orderBy("t", "v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                     F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("width", [2, 5, 64])
def test_neighbourhood_sees_what_a_plain_range_window_sees(spark, width):
    df = spark.createDataFrame([(t, t % 5) for t in range(0, 60) if t % 7], "t bigint, v bigint").withColumn("k", F.lit("a"))
    near = Neighbourhood(("k",), "t", 3, 8, width)
    spread = near.spread(df)
    got = near.gather(spread.withColumn("s", F.sum("v").over(near.window().rangeBetween(-3, 8)))).orderBy("t").collect()
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t").rangeBetween(-3, 8))).orderBy("t").collect()
    assert [(r["t"], r["s"]) for r in got] == [(r["t"], r["s"]) for r in want]


def test_lags_stop_at_holes_and_at_the_start_of_a_run(spark):
    tables = without("measurements", f"run_id = '{SOUTH}' AND sample_index IN (3, 4, 7)")(log(spark))
    found = series.lagged_measurements(tables.measurements, width=3).where("sensor_id LIKE '%.C_A'").collect()
    got = {(r["run_id"], r["sample_index"]): (r["value_one_period_ago"], r["previous_stored_value"], r["ticks_since_previous"], r["seconds_since_previous"]) for r in found}
    here = lambda k, south: 120.0 + k * k + south * k
    assert got[SOUTH, 0] == got[NORTH, 0] == (None, None, None, None)
    assert got[SOUTH, 5] == (None, here(2, 1), 3, 18.0) and got[SOUTH, 8] == (None, here(6, 1), 2, 12.0)
    assert got[SOUTH, 6] == (here(5, 1), here(5, 1), 1, 6.0)
    assert all(got[NORTH, k] == (here(k - 1, 0), here(k - 1, 0), 1, 6.0) for k in range(1, 6))


def test_what_two_plants_differ_in(spark):
    tables = log(spark)
    wide = series.aligned_series(tables)
    (row,) = series.compare_plants(wide, tables.operating_runs, "north", "south").collect()
    # six of nine ticks meet; the coolant moves on both at once, so the inputs agree; south - north is k and 4
    assert (row["n_paired"], row["n_used"]) == (6, 6) and row["coverage"] == pytest.approx(6 / 9)
    assert row["observed_difference_c_a_mean"] == pytest.approx(2.5) and (row["observed_difference_t_min"], row["observed_difference_t_max"]) == (4.0, 4.0)
    assert series.compare_plants(wide, tables.operating_runs, "south", "west").isEmpty()


def test_ticks_with_other_inputs_are_paired_but_not_used(spark):
    tables = log(spark, readings={"q": lambda k, south: 0.003 + 0.001 * (south and k in (1, 2))})
    (row,) = series.compare_plants(series.aligned_series(tables), tables.operating_runs, "north", "south").collect()
    assert (row["n_paired"], row["n_same_inputs"], row["n_used"]) == (6, 4, 4) and row["observed_difference_c_a_mean"] == pytest.approx((0 + 3 + 4 + 5) / 4)


@pytest.mark.parametrize("size", [1, 2, 4, 50])
def test_blocks_against_plain_sums(spark, size):
    tables = without("measurements", f"run_id = '{SOUTH}' AND sample_index = 6")(log(spark, {SOUTH: 9}))
    found = series.block_average(series.aligned_series(tables), tables.operating_runs, size).collect()
    ticks = [k for k in range(9) if k != 6]
    for b in found:
        own = [k for k in ticks if k // size == b["block_index"]]
        assert b["n_present"] == len(own) and b["n_expected"] == min(size, 9 - size * b["block_index"])
        assert (b["block_start_s"], b["block_end_s"]) == (30.0 + 6.0 * size * b["block_index"], 30.0 + 6.0 * size * (b["block_index"] + 1))
        cold = {330.0 if k < 5 else 333.0 for k in own}
        assert (b["C_A_mean"], b["T_c"]) == (pytest.approx(sum(120.0 + k * k + k for k in own) / len(own)), cold.pop() if len(cold) == 1 else None)
    assert sum(b["n_present"] for b in found) == 8


@pytest.mark.parametrize("size", [0, -1, 1.0, False, "4", None])
def test_a_block_is_a_positive_number_of_ticks(spark, size):
    tables = log(spark, {NORTH: 3})
    with pytest.raises(ValueError, match="block_ticks"):
        series.block_average(series.aligned_series(tables), tables.operating_runs, size)


def test_where_inputs_move(spark):
    wide = series.aligned_series(log(spark, {SOUTH: 12}, {"C_Af": lambda k, south: 480.0 + (k >= 9), "T_c": lambda k, south: 331.0 + (k in (4, 5))}))
    assert sorted(r["sample_index"] for r in series.input_switches(wide, width=4).collect()) == [0, 4, 6, 9]
    assert sorted((r["first_tick"], r["last_tick"]) for r in series.input_segments(wide, width=5).collect()) == [(0, 3), (4, 5), (6, 8), (9, 11)]


def test_ulp_is_the_spacing_of_doubles(spark):
    rng = random.Random(5)
    values = [rng.uniform(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(500)] + [2.0**k for k in range(-60, 60)] + [0.0, 5e-324, 2.2250738585072014e-308]
    values += [math.nextafter(2.0**k, 0.0) for k in range(-60, 60)]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.ulp("x").alias("u")).collect()
    assert all(r["u"] == math.ulp(r["x"]) for r in found)


def test_identifiers(spark):
    names = ["a", "con", "con.x", "com10.x", "a.", "A", "-a", "a" * 100, "a" * 101, "a\n", "", None, "source.p3.e0.x10.n0"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    good = [r["n"] for r in df.where(S.valid_identifier("n")).collect()]
    assert good == ["a", "com10.x", "a" * 100, "source.p3.e0.x10.n0"]


def test_exact_medians_of_uneven_groups(spark):
    rng = random.Random(3)
    data = [("a", float(rng.randint(0, 50))) for _ in range(3001)] + [("b", rng.gauss(0, 1)) for _ in range(500)] + [("c", 1e308), ("c", 1.2e308), ("d", 7.0)] + [("e", 2.0)] * 900
    found = {r["k"]: r["median"] for r in grouped_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in "abde":
        assert found[k] == pytest.approx(statistics.median([v for g, v in data if g == k]), abs=1e-15)
    assert found["c"] == 1.1e308


def test_medians_are_narrowed_to_few_values_however_large_a_group(spark):
    rng = random.Random(12)
    data = [("hot", rng.gauss(0, 1e6)) for _ in range(30_000)] + [("ties", float(rng.randint(0, 3))) for _ in range(5000)] + [("even", float(k)) for k in range(1000)]
    data += [(f"g{k % 90}", rng.random()) for k in range(20_000)] + [("half", v) for v in [1.0] * 500 + [2.0 + k for k in range(500)]] + [("gone", None)]
    frame = spark.createDataFrame(data, "k string, v double")
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for most, cells in ((100, 16), (3, 4), (1 << 16, 64)):
        assert {r["k"]: r["median"] for r in medians.grouped_median(frame, ["k"], "v", most=most, cells=cells).collect()} == {k: statistics.median(v) for k, v in groups.items()}


def test_a_round_of_narrowing_leaves_a_fixed_share_of_a_group(spark):
    for n in (2000, 40_000):
        counted = spark.range(n).select(medians.F.lit("hot").alias("k"), (medians.F.col("id") * 1.5).alias("v"), medians.F.lit(1).alias("_n"))
        brackets = spark.createDataFrame([("hot", n, 0, n, 0.0, 1.5 * n)], "k string, _size long, _below long, _values long, _from double, _to double")
        one = medians.narrowed(counted, brackets, ["k"], "v", 32).first()
        assert one["_values"] <= n / 8 and one["_from"] <= 1.5 * (n - 1) / 2 <= one["_to"] and one["_below"] == one["_from"] / 1.5


def test_tasks_of_the_long_table_have_a_bounded_number_of_rows(spark, monkeypatch):
    tables = log(spark)  # 90 rows, 12 channels
    monkeypatch.setattr(dealing, "ROWS", 2)
    for made, n in ((series.aligned_series(tables), 45), (rowpass.marks(tables), 45), (integrity.pre_publish(tables), 6)):
        assert made.rdd.getNumPartitions() == n
    assert series.aligned_series(tables).agg(F.sum("n_rows")).first()[0] == 90
