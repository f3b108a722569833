import math
import random

import pytest

from tickweave.operators import diagnostics, scoring, trajectory

CASE = "case_id string, segment bigint, i bigint, time_s double, C_A double, T double, q double, C_Af double, T_f double, T_c double"


def series(spark, values, sigma=1.0, run="r"):
    return spark.createDataFrame([(run, "T", k, float(v), sigma) for k, v in enumerate(values)], "run_id string, variable_name string, sample_index bigint, error double, sigma double")


def case(spark, segments, name="c"):
    rows, i = [], 0
    for s, points in enumerate(segments):
        for t, v in points:
            rows.append((name, s, i, float(t), 1.0, float(v), 0.1, 500.0, 350.0, 337.5))
            i += 1
    return spark.createDataFrame(rows, CASE)


def test_noise_of_the_right_level_and_a_bias(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(3000)]
    (good,) = diagnostics.noise_statistics(series(spark, values), width=128).collect()
    assert all(abs(good[z]) < 4 for z in diagnostics.SCORES) and good["n"] == 3000
    lag = sum(a * b for a, b in zip(values, values[1:])) / sum(v * v for v in values)
    assert good["lag_one"] == pytest.approx(lag, rel=1e-9)
    (biased,) = diagnostics.noise_statistics(series(spark, [v + 0.3 for v in values])).collect()
    assert biased["mean_z"] > 10
    (clipped,) = diagnostics.noise_statistics(series(spark, [max(-1.5, min(1.5, v)) for v in values])).collect()
    assert clipped["beyond_two_sigma_z"] < -4
    (zero,) = diagnostics.noise_statistics(series(spark, [0.0] * 100)).collect()
    assert zero["lag_one"] == 0.0 and zero["rms"] == 0.0


def test_series_outside_the_domain(spark):
    problems = lambda v, s=1.0: {r["problem"] for r in diagnostics.series_problems(series(spark, v, s)).collect()}
    assert problems([0.0] * 100) == set() and problems([0.0] * 99) == {"too few samples"} and problems([0.0] * 100, 0.0) == {"noise level not positive"}
    assert problems([math.nan] + [0.0] * 100) == {"not finite"} and problems([2e100] + [0.0] * 100, 1e90) == {"beyond the domain"}


def test_a_constant_series_has_no_correlation(spark):
    rows = spark.createDataFrame([("a", float(k), 2.0 * k) for k in range(9)] + [("b", 1.0, float(k)) for k in range(9)], "label string, x double, y double")
    got = {r["label"]: (r["r"], r["problem"]) for r in diagnostics.correlations(rows, ["label"]).collect()}
    assert got["a"][0] == pytest.approx(1.0) and got["b"] == (None, "constant series")


def test_a_parabola_between_samples(spark):
    points = [(t, 10.0 - (t - 2.3) ** 2) for t in range(6)]
    (r,) = trajectory.refined_peaks(case(spark, [points]), "T", width=2).collect()
    assert (r["peak"], r["peak_t"]) == (pytest.approx(9.91), 2.0) and r["refined_peak"] == pytest.approx(10.0) and r["refined_t"] == pytest.approx(2.3)
    (split,) = trajectory.refined_peaks(case(spark, [points[:3], points[3:]]), "T").collect()
    assert split["refined_peak"] <= 10.0 + 1e-12
    (flat,) = trajectory.refined_peaks(case(spark, [[(t, 5.0) for t in range(5)]]), "T").collect()
    assert flat["refined_peak"] == 5.0 and flat["refined_t"] == 0.0


def test_time_above_is_a_trapezoid_of_the_indicator(spark):
    (r,) = trajectory.time_above(case(spark, [[(0, 1), (1, 3), (2, 3), (3, 1)]]), "T", 2.0, width=2).collect()
    assert r["seconds_above"] == 2.0


def test_simpson_closes_a_cubic_exactly(spark):
    rows = [("c", 0, i, 0.5 * i, (0.5 * i) ** 4 / 4.0, 300.0, 0.1, 1.0, 1.0, 1.0, (0.5 * i) ** 3, 0.0, 0.0, 0.0, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, CASE + ", feed_of_a double, rate double, feed_heat double, reaction_heat double, exchanged_heat double")
    (r,) = trajectory.balance_closure(df, 1e-9).collect()
    assert r["mass_residual"] == pytest.approx(0.0, abs=1e-12) and r["closes"] and r["odd_segments"] == 0 and r["relative_energy_residual"] == 0.0


def test_first_move_and_its_extreme(spark):
    (r,) = trajectory.first_moves(case(spark, [[(0, 5), (1, 6), (2, 9), (3, 7)]]), "T").collect()
    assert (r["direction"], r["extreme"], r["extreme_t"], r["inside"], r["value_at_end"], r["beyond_end"]) == (1, 9.0, 2.0, True, 7.0, 2.0)
    (still,) = trajectory.first_moves(case(spark, [[(0, 5), (1, 5), (2, 3), (3, 4)]]), "T").collect()
    assert (still["direction"], still["extreme"]) == (-1, 3.0)


def test_subsampling_refuses_what_it_cannot_take(spark):
    dense = case(spark, [[(0.1 * k, 1.0) for k in range(31)]])
    assert trajectory.subsampling_problems(dense, 0.3, width=4).isEmpty()
    assert [r["tick"] for r in trajectory.on_sensor_clock(dense, 0.3).orderBy("i").collect()] == list(range(11))
    assert {r["problem"] for r in trajectory.subsampling_problems(dense.where("i <> 3"), 0.3).collect()} == {"missing"}


def test_switching_instants_are_ticks(spark):
    df = spark.createDataFrame([("r", 0, 60.0), ("r", 1, 120.0), ("r", 2, 0.5)], "run_id string, position bigint, duration_s double")
    assert [(r["ends_at_s"], r["on_clock"]) for r in trajectory.switching_instants(df, ["run_id"], 6.0, width=1).orderBy("position").collect()] == [(60.0, True), (180.0, True), (180.5, False)]


def test_implied_terms_by_hand(spark):
    points = spark.createDataFrame([("p", 0.0, 0.0, 400.0, 350.0, 0.1, 500.0, 350.0, 340.0), ("p", 2000.0, 0.0, 400.0, 340.0, 0.1, 500.0, 340.0, 340.0)],
                                   "plant_id string, f_C_A double, f_T double, C_A double, T double, q double, C_Af double, T_f double, T_c double")
    constants = spark.createDataFrame([("p", 0.1, 1000.0, 250.0, -50000.0, 25000.0, 0.2)], "plant_id string, volume double, density double, heat_capacity double, reaction_enthalpy double, thermal_mass double, heat_per_mole double")
    terms = scoring.implied_terms(points, constants)
    assert [(r["rate"], r["heat_flow"], r["above_coolant"]) for r in terms.orderBy("f_C_A").collect()] == [(100.0, 500000.0, 1), (-1900.0, -9500000.0, 0)]
    (c,) = scoring.implied_counts(terms, ["plant_id"]).collect()
    assert (c["points"], c["negative_rate"], c["incompatible_heat_flow"], c["at_coolant_temperature"], c["heat_flow_within_bound"]) == (2, 1, 1, 1, 0)
