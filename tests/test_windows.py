import pytest
from plants import log
from pyspark.sql import functions as F

from tickweave.contract import INPUTS, constant
from tickweave.operators import scoring, windows

NOMINAL = (0.1 / 60, 500.0, 350.0, 337.5)
UP = (0.11 / 60, 550.0, 355.0, 342.5)


def wide(spark, runs):
    """{run: [inputs per tick]} with tick-coded readings: C_A = tick, T = 1000 + tick."""
    rows = [(r.split(".")[0], r, k, 6.0 * k, float(k), 1000.0 + k, *u) for r, inputs in runs.items() for k, u in enumerate(inputs)]
    return spark.createDataFrame(rows, "plant_id string, run_id string, sample_index bigint, time_s double, C_A double, T double, q double, C_Af double, T_f double, T_c double").withColumn("complete", F.lit(True))


def p3(corners, lead=10, tail=1):
    return [NOMINAL] * lead + sum(([UP] * 20 + [NOMINAL] * 100 for _ in range(corners)), []) + [NOMINAL] * tail


def found(spark, runs, mode="p3", width=50):
    df = wide(spark, runs)
    nominal = spark.createDataFrame([(p, *NOMINAL) for p in {r.split(".")[0] for r in runs}], "plant_id string, " + ", ".join(f"nominal_{i} double" for i in INPUTS))
    modes = spark.createDataFrame([(r, mode) for r in runs], "run_id string, operating_mode string")
    return df, nominal, windows.excursions(df, nominal, modes, width)


@pytest.mark.parametrize("width", [7, 64, 100000])
def test_windows_of_a_run_with_and_without_a_lead(spark, width):
    _, _, ex = found(spark, {"target.p3.a": p3(3), "target.p3.b": p3(3, lead=0)}, width=width)
    got = [tuple(r) for r in ex.select("run_id", "excursion", "onset", "outcome", "reason").orderBy("run_id", "excursion").collect()]
    assert got == [
        ("target.p3.a", 1, 10, "window", None), ("target.p3.a", 2, 130, "window", None), ("target.p3.a", 3, 250, "window", None),
        ("target.p3.b", 1, 0, "skipped", "no context"), ("target.p3.b", 2, 120, "window", None), ("target.p3.b", 3, 240, "window", None),
    ]


def test_what_breaks_a_layout_is_refused_and_a_short_run_is_skipped(spark):
    again, late, short, close = p3(2), p3(2), p3(2, tail=0), p3(2)
    again[25] = (*UP[:3], 340.0)
    late[60] = UP
    del short[-10:]
    close = [NOMINAL] * 10 + [UP] * 20 + [NOMINAL] * 91 + [UP] * 20 + [NOMINAL] * 100
    _, _, ex = found(spark, {"t.again": again, "t.late": late, "t.short": short, "t.close": close})
    got = {(r["run_id"], r["onset"]): (r["outcome"], r["reason"]) for r in ex.collect()}
    assert got[("t.again", 10)] == ("refused", "inputs change inside the hold")
    assert got[("t.late", 10)] == ("refused", "inputs not nominal in the rest of the window")
    assert got[("t.short", 130)] == ("skipped", "run ends before the last scored reading")
    assert got[("t.close", 121)] == ("refused", "context inside the window before")
    assert {r["run_id"] for r in windows.find_windows(ex).collect()} == {"t.short"}


def test_a_step_run_has_one_window_of_four_phases(spark):
    _, _, ex = found(spark, {"t.step": [NOMINAL] * 100 + [UP] * 100 + [NOMINAL] * 101}, mode="step")
    ticks = windows.window_ticks(windows.find_windows(ex)).where("role = 'scored'")
    assert {r["phase"]: (r["a"], r["b"]) for r in ticks.groupBy("phase").agg(F.min("offset").alias("a"), F.max("offset").alias("b")).collect()} == {
        "hold transient": (1, 50), "hold settled": (51, 100), "recovery transient": (101, 150), "recovery settled": (151, 200)}


def test_which_rows_a_window_takes(spark):
    df, _, ex = found(spark, {"target.p3.a": p3(2)})
    data = windows.window_data(windows.window_ticks(windows.find_windows(ex)), df).where("excursion = 1")
    spans = {r["role"]: (r["a"], r["b"], r["n"]) for r in data.groupBy("role").agg(F.min("C_A").alias("a"), F.max("C_A").alias("b"), F.count("*").alias("n")).collect()}
    assert spans == {"context": (1.0, 10.0, 10), "scored": (11.0, 120.0, 110), "input": (10.0, 119.0, 110)}
    (initial,) = windows.initial_states(data).collect()
    assert (initial["initial_C_A"], initial["initial_T"]) == (5.5, 1005.5)


def test_context_readings_are_added_in_the_order_of_their_ticks(spark):
    readings = [31.74, 58.14, 69.33, 53.73, 45.74, 36.81, 50.09, 69.28, 60.82, 24.32]  # 499.9999999999999 forwards, 500 backwards
    rows = [("r", 1, k, "context", v, None if k == 3 else 1e308) for k, v in enumerate(readings)]
    schema = "run_id string, excursion bigint, sample_index bigint, role string, C_A double, T double"
    for given in (rows, rows[::-1], rows[5:] + rows[:5]):
        (initial,) = windows.initial_states(spark.createDataFrame(given, schema).coalesce(1)).collect()
        assert initial["initial_C_A"] == sum_in_order(readings) / 10 < 50.0 and initial["initial_T"] == pytest.approx(1e308, rel=1e-12)
    assert windows.initial_states(spark.createDataFrame([("r", 1, 0, "context", None, float("nan"))], schema)).collect()[0][2] is None


def sum_in_order(values):
    total = 0.0  # Python's sum makes up for the rounding
    for v in values:
        total += v
    return total


def test_budgets_split_in_time_and_leave_eleven_rows_unused(spark):
    _, nominal, ex = found(spark, {"target.p3.a": p3(10)})
    w = windows.find_windows(ex)
    parts = windows.split_budgets(w, (2, 5, 10))
    sizes = {(r["budget"], r["part"]): r["count"] for r in parts.groupBy("budget", "part").count().collect()}
    assert sizes == {(2, "fitting"): 1, (2, "validation"): 1, (5, "fitting"): 4, (5, "validation"): 1, (10, "fitting"): 8, (10, "validation"): 2}
    indices = {r["budget"]: r for r in windows.part_indices(parts).collect()}
    assert [indices[b]["unused_ticks"] for b in (2, 5)] == [11, 11] and indices[5]["prefix_end"] == 10 + 120 * 5
    checks = windows.split_integrity(parts).collect()
    assert all((r["context_and_scored"], r["shared"], r["beyond_prefix"]) == (0, 0, 0) for r in checks)
    runs = spark.createDataFrame([("target.p3.a", "target")], "run_id string, plant_id string")
    ranks = windows.excitation(parts, windows.onset_signs(w, nominal, runs)).collect()
    assert {(r["distinct_corners"], r["rank"]) for r in ranks} == {(1, 1)}
    for bad in ((), (1,), (True,), (2.0,)):
        with pytest.raises(ValueError):
            windows.split_budgets(w, bad)


def test_rank_of_sign_vectors(spark):
    vectors = [(1, 1, 1, 1), (1, 1, -1, -1), (1, -1, 1, -1), (-1, -1, -1, -1), (1, -1, -1, 1)]
    signs = spark.createDataFrame([("r", i, *v, str(v)) for i, v in enumerate(vectors)], "run_id string, excursion bigint, s_q bigint, s_C_Af bigint, s_T_f bigint, s_T_c bigint, corner string")
    parts = spark.createDataFrame([("r", b, "fitting", e) for b in range(1, 6) for e in range(b)], "run_id string, budget bigint, part string, excursion bigint")
    got = {r["budget"]: (r["distinct_corners"], r["rank"]) for r in windows.excitation(parts, signs).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (4, 3), 5: (5, 4)}


def _scores(spark, pairs, role="held out", sigma=(2.0, 0.5)):
    rows = [("m", "r", 1, k, "excursion", *sigma, a, a / sigma[0], b, b / sigma[1]) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "model string, run_id string, excursion bigint, sample_index bigint, phase string, sigma_C_A double, sigma_T double, e_C_A double, z_C_A double, e_T double, z_T double")
    return scoring.evaluate(df, constant(spark, [("m", role)], "model string, role string")).where("grain = 'pooled'").collect()[0]


def test_scores_that_are_exact_in_binary(spark):
    s = _scores(spark, [(3.0, 0.5), (-1.0, -0.5), (1.0, 0.5), (-1.0, -0.5)])
    assert (s["readings"], s["mse_C_A"], s["mse_T"], s["normalised_mse_C_A"], s["normalised_mse_T"]) == (4, 3.0, 0.25, 0.75, 1.0)
    assert s["j"] == pytest.approx(0.875**0.5) and s["excess_mse_C_A"] == -1.0 and s["excess_j_squared"] == -0.125
    assert _scores(spark, [(1.0, 1.0)], role="fitting")["excess_mse_C_A"] is None


def test_scores_near_the_ends_of_the_range(spark):
    huge, tiny = _scores(spark, [(1e200, 1e200)] * 3, sigma=(1.0, 1.0)), _scores(spark, [(1e-200, 1e-200)] * 3, sigma=(1.0, 1.0))
    assert huge["rmse_C_A"] == pytest.approx(1e200, rel=1e-12) and huge["j"] == pytest.approx(1e200, rel=1e-12) and huge["mse_C_A"] == float("inf")
    assert tiny["rmse_T"] == pytest.approx(1e-200, rel=1e-12) and tiny["j"] == pytest.approx(1e-200, rel=1e-12)
    assert _scores(spark, [(0.0, 0.0)])["j"] == 0.0


def test_bounds_use_the_inputs_before_the_instant(spark):
    df, _, ex = found(spark, {"target.p3.a": p3(1)})
    data = windows.window_data(windows.window_ticks(windows.find_windows(ex)), df)
    initial = spark.createDataFrame([("target.p3.a", 1, 100.0, 400.0)], "run_id string, excursion bigint, initial_C_A double, initial_T double")
    predictions = spark.createDataFrame([("m", "target.p3.a", 1, 11, 550.0, 342.0), ("m", "target.p3.a", 1, 12, 550.1, 342.5), ("m", "target.p3.a", 1, 60, -1.0, 337.4)],
                                        "model string, run_id string, excursion bigint, sample_index bigint, C_A_hat double, T_hat double")
    enthalpy = spark.createDataFrame([("target.p3.a", -5e4)], "run_id string, reaction_enthalpy double")
    got = sorted((r["sample_index"], r["bound"][:3], r["value"], r["limit"]) for r in scoring.bound_violations(predictions, data, initial, enthalpy).collect())
    assert got == [(11, "T b", 342.0, 342.5), (12, "C_A", 550.1, 550.0), (60, "C_A", -1.0, 0.0), (60, "T b", 337.4, 337.5)]


def test_exploded_ticks_are_merged_not_broadcast(spark):
    df, _, ex = found(spark, {"target.p3.a": p3(2)})
    data = windows.window_data(windows.window_ticks(windows.find_windows(ex)), df)
    initial = windows.initial_states(data)
    made = scoring.reference_predictions(data, initial, df)
    enthalpy = spark.createDataFrame([("target.p3.a", -5e4)], "run_id string, reaction_enthalpy double")
    sigmas = spark.createDataFrame([("target.p3.a", 1.0, 1.0)], "run_id string, sigma_C_A double, sigma_T double")
    for rows, small in ((data, 0), (made, 0), (scoring.errors(made, data, sigmas), 1), (scoring.coverage(made, data), 0), (scoring.bound_violations(made, data, initial, enthalpy), 1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= small and "SortMergeJoin" in plan


def test_run_preconditions(spark):
    tables = log(spark, {"south.p3.e1": 7, "north.steady.e1": 7}, start=0.0)
    df = wide(spark, {"south.p3.e1": [NOMINAL] * 7, "north.steady.e1": [NOMINAL] * 7}).where("NOT (run_id = 'south.p3.e1' AND sample_index = 4)")
    assert {tuple(r) for r in windows.run_preconditions(tables, df).collect()} == {("south.p3.e1", "not consecutive ticks"), ("north.steady.e1", "no layout")}
