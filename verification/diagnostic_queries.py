"""Noise diagnostics and stored trajectories."""

from pyspark.sql import functions as F

from tickweave.contract import INPUTS
from tickweave.operators import diagnostics, series, trajectory
from tickweave.sources import eventlog
from tickweave.sources.eventlog import MOVED, NOMINAL, table
from verification.series_queries import aligned_rounded as rounded
from verification.tables_sql import EVENT_LOG, on


def _centred(spark, sf):
    return eventlog.wide_log(spark, sf).select("plant_id", "run_id", "sample_index", (F.col("C_A") - 100.0).alias("C_A"), (F.col("T") - 355.0).alias("T"))


def _errors(spark, sf):
    return _centred(spark, sf).unpivot(["run_id", "sample_index"], ["C_A", "T"], "variable_name", "error").withColumn(
        "sigma", F.when(F.col("variable_name") == "C_A", 70.0).otherwise(3.0))


def _run_pairs(spark, sf, kind):
    runs = eventlog.event_log(spark, sf).operating_runs
    if kind == "plants":
        return series.paired_runs(runs, "source", "target").select(F.col("definition").alias("label"), F.col("source_run").alias("first_run"), F.col("target_run").alias("second_run"))
    k = F.regexp_extract("run_id", r"\.e(\d+)\.", 1).cast("int")
    following = F.concat("plant_id", F.lit(".p3.e"), (k + 1).cast("string"), F.lit(".x4.l60.a10.n0"))
    return runs.select(F.concat("plant_id", F.lit(" e"), k.cast("string")).alias("label"), F.col("run_id").alias("first_run"), following.alias("second_run"))


def _pairs(kind, crossed):
    def run(spark, sf):
        rows = diagnostics.declared_run_pairs(_centred(spark, sf), _run_pairs(spark, sf, kind), crossed)
        return diagnostics.correlations(rows, ["label"])

    return run


def _within(spark, sf):
    return diagnostics.correlations(diagnostics.within_run_pairs(_centred(spark, sf)), ["label"])


def _sheet(spark, sf):
    return diagnostics.score_sheet(
        diagnostics.noise_statistics(_errors(spark, sf)), [_within(spark, sf), _pairs("plants", True)(spark, sf), _pairs("runs", False)(spark, sf)])


def _expected_switches(wide):
    ends = wide.groupBy("run_id").agg(F.max("sample_index").alias("last"))
    ticks = ends.select("run_id", F.explode(F.sequence(F.lit(0), "last", F.lit(10))).alias("sample_index")).where((F.col("sample_index") == 0) | ((F.col("sample_index") - 10) % 120).isin(0, 20))
    k = F.regexp_extract("run_id", r"\.e(\d+)\.", 1).cast("long")
    up = (F.col("sample_index") - 10) % 120 == 0
    corner = (3 * k + 5 * F.expr("(sample_index - 10) div 120")) % 16
    moved = (F.col("sample_index") >= 10) & up
    return ticks.select("run_id", "sample_index", *[
        F.when(moved, F.when(F.shiftright(corner.cast("int"), p).bitwiseAND(F.lit(1)) == 1, MOVED[i][0]).otherwise(MOVED[i][1])).otherwise(NOMINAL[i]).alias(i) for p, i in enumerate(INPUTS)])


def _switch_check(spark, sf, wide=None):
    clean = eventlog.wide_log(spark, sf)
    return diagnostics.switch_check(series.input_switches(clean if wide is None else wide), _expected_switches(clean))


def _stored(spark, sf):
    wide, tables = eventlog.wide_log(spark, sf), eventlog.event_log(spark, sf)
    rough = eventlog.rough_wide(wide).withColumn("time_s", F.when(F.col("event_id") % 2003 == 0, F.col("time_s") + 0.1).otherwise(F.col("time_s")))
    expected = tables.operating_runs.select("run_id", (F.col("n_samples") - F.when(F.col("run_id").contains(".e4."), 1).otherwise(0)).alias("expected_rows"))
    return diagnostics.stored_runs(rough, tables.operating_runs, expected, _switch_check(spark, sf, rough))


def _repetition(spark, sf):
    wide = eventlog.wide_log(spark, sf)
    other = wide.where("event_id % 509 <> 0").withColumn("C_A", F.col("C_A") + F.when(F.col("run_id").startswith("source"), 1.0).otherwise(0.0)).withColumn(
        "q", F.when(F.col("event_id") % 1511 == 0, 0.0025).otherwise(F.col("q")))
    return diagnostics.repetition(wide, other)


def cases(spark, sf):
    """Runs as trajectories: sixty samples to a segment."""
    wide = eventlog.wide_log(spark, sf)
    return wide.select(
        F.col("run_id").alias("case_id"), "plant_id", "event_id", F.expr("sample_index div 60").alias("segment"), F.col("sample_index").alias("i"), "time_s", "C_A", "T", *INPUTS,
        F.when((F.col("sample_index") >= 10) & ((F.col("sample_index") - 10) % 120 < 20), "excursion").otherwise("rest").alias("phase"))


def _terms(spark, sf):
    return cases(spark, sf).select("*", ((F.col("C_Af") - F.col("C_A")) / 50.0).alias("feed_of_a"), (F.col("C_A") / 100.0).alias("rate"), ((F.col("T_f") - F.col("T")) / 50.0).alias("feed_heat"),
                                   (F.col("C_A") / 400.0).alias("reaction_heat"), ((F.col("T") - F.col("T_c")) / 100.0).alias("exchanged_heat"))


def _phases(spark, sf):
    rows = cases(spark, sf).withColumn("definition", F.expr("substring(case_id, length(plant_id) + 2)"))
    return rounded(trajectory.phase_differences(rows.where("plant_id = 'source'"), rows.where("plant_id = 'target'"), ["definition"], "C_A", 5.0))


def _grid(spark, sf):
    c = cases(spark, sf)
    peaks = trajectory.refined_peaks(c, "T").join(c.select("case_id", "plant_id").distinct(), "case_id")
    return trajectory.worst_cases(peaks.withColumn("ok", F.col("refined_peak") < 360.0).drop("segment"), ["plant_id"], "refined_peak", "ok")


def _segments(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("position"), (F.lit(6.0) * (1 + F.col("o_orderkey") % 20) + F.when(F.col("o_orderkey") % 97 == 0, 0.5).otherwise(0.0)).alias("duration_s"))


def _thinned(spark, sf):
    return cases(spark, sf).where("event_id % 499 <> 0 OR i = 0").withColumn("q", F.when(F.col("i") == 33, 0.003).otherwise(F.col("q")))


def _late_clocks(spark, sf):
    """Cases whose clock starts at one second with a tenth of a second to a tick; every seventh
    sample is absent, and each case ends on a tick that a quotient of times falls short of."""
    i = F.col("event_id") % 40
    rows = eventlog.table(spark, sf, "events").select(F.expr("event_id div 40").alias("case_id"), i.alias("i"), (F.lit(1.0) + F.lit(0.1) * i).alias("time_s"), *[F.lit(1.0).alias(c) for c in INPUTS])
    return trajectory.subsampling_problems(rows.where("i % 7 <> 1 AND i <= 2 + case_id % 30"), 0.1)


QUERIES = {
    "trajectory_late_clocks": _late_clocks,
    "noise_statistics": lambda spark, sf: rounded(diagnostics.noise_statistics(_errors(spark, sf))),
    "noise_series_problems": lambda spark, sf: diagnostics.series_problems(
        _errors(spark, sf).where("NOT (run_id LIKE '%.e1.%' AND sample_index >= 99)").withColumn("error", F.when(F.col("run_id").contains(".e2.") & (F.col("sample_index") == 5), float("inf")).otherwise(F.col("error")))
        .withColumn("sigma", F.when(F.col("run_id").contains(".e3."), 0.0).otherwise(F.col("sigma")))),
    "noise_within_run_correlations": lambda spark, sf: rounded(_within(spark, sf)),
    "noise_paired_plant_correlations": lambda spark, sf: rounded(_pairs("plants", True)(spark, sf)),
    "noise_score_sheet_summary": lambda spark, sf: rounded(diagnostics.sheet_summary(_sheet(spark, sf)), 5),
    "series_switch_check": lambda spark, sf: _switch_check(spark, sf),
    "series_stored_runs": _stored,
    "series_observation_grid": lambda spark, sf: diagnostics.observation_grid(eventlog.wide_log(spark, sf)),
    "series_repetition": _repetition,
    "trajectory_ranges_and_peaks": lambda spark, sf: rounded(trajectory.ranges_and_peaks(cases(spark, sf), "C_A")),
    "trajectory_refined_peaks": lambda spark, sf: rounded(trajectory.refined_peaks(cases(spark, sf), "T")),
    "trajectory_time_above": lambda spark, sf: rounded(trajectory.time_above(cases(spark, sf), "T", 358.0)),
    "trajectory_balance_closure": lambda spark, sf: rounded(trajectory.balance_closure(_terms(spark, sf), 0.05).drop("mass_resolution", "energy_resolution"), 7),
    "trajectory_verdicts": lambda spark, sf: trajectory.verdicts(cases(spark, sf), 340.0, 359.85),
    "trajectory_subsampling": lambda spark, sf: trajectory.on_sensor_clock(cases(spark, sf), 12.0).select("case_id", "i", "tick"),
    "trajectory_subsampling_problems": lambda spark, sf: trajectory.subsampling_problems(_thinned(spark, sf), 12.0),
    "trajectory_phase_differences": _phases,
    "trajectory_first_moves": lambda spark, sf: rounded(trajectory.first_moves(cases(spark, sf), "C_A")),
    "trajectory_settle_residuals": lambda spark, sf: rounded(trajectory.settle_residuals(cases(spark, sf), {"C_A": 100.0, "T": 355.0})),
    "trajectory_worst_cases": lambda spark, sf: rounded(_grid(spark, sf)),
    "trajectory_switching_instants": lambda spark, sf: trajectory.switching_instants(_segments(spark, sf), ["o_custkey"], 6.0),
}

_ERR = """
, errs AS (SELECT run_id, sample_index, 'C_A' AS variable_name, C_A - 100 AS e, 70.0::DOUBLE AS s FROM wide UNION ALL SELECT run_id, sample_index, 'T', T - 355, 3.0::DOUBLE FROM wide),
nexts AS (SELECT *, e / s AS z, lead(e / s) OVER (PARTITION BY run_id, variable_name ORDER BY sample_index) AS z2 FROM errs),
basic AS (SELECT run_id, variable_name, count(*) AS n, any_value(s) AS sigma, avg(e) AS mean, avg(z * z) AS ms, sum(z * z2) / sum(z * z) AS lag_one, avg((abs(z) > 1)::INT) AS b1, avg((abs(z) > 2)::INT) AS b2, max(abs(z)) AS top FROM nexts GROUP BY ALL),
stats AS (SELECT *, mean * sqrt(n) / sigma AS mean_z, sigma * sqrt(ms) AS rms, (pow(ms, 1.0::DOUBLE / 3) - (1 - 2.0::DOUBLE / (9 * n))) / sqrt(2.0::DOUBLE / (9 * n)) AS spread_z, lag_one * sqrt(n) AS lag_one_z,
  (b1 - 0.31731050786291415::DOUBLE) / sqrt(0.31731050786291415::DOUBLE * (1 - 0.31731050786291415::DOUBLE) / n) AS b1_z, (b2 - 0.04550026389635839::DOUBLE) / sqrt(0.04550026389635839::DOUBLE * (1 - 0.04550026389635839::DOUBLE) / n) AS b2_z FROM basic),
inside AS (SELECT run_id || ': C_A with T' AS label, count(*) AS n, corr(C_A - 100, T - 355) AS r FROM wide GROUP BY run_id),
named AS (SELECT *, substr(run_id, length(plant_id) + 2) AS definition, regexp_extract(run_id, '\\.e(\\d+)\\.', 1)::INT AS k FROM wide),
tall AS (SELECT plant_id, definition, k, sample_index, 'C_A' AS v, C_A - 100 AS x FROM named UNION ALL SELECT plant_id, definition, k, sample_index, 'T', T - 355 FROM named),
across AS (SELECT a.definition || ': ' || a.v || ' with ' || b.v AS label, count(*) AS n, corr(a.x, b.x) AS r FROM tall a JOIN tall b USING (definition, sample_index) WHERE a.plant_id = 'source' AND b.plant_id = 'target' GROUP BY label),
along AS (SELECT a.plant_id || ' e' || a.k || ': ' || a.v || ' with ' || a.v AS label, count(*) AS n, corr(a.x, b.x) AS r FROM tall a JOIN tall b ON a.plant_id = b.plant_id AND b.k = a.k + 1 AND a.v = b.v AND a.sample_index = b.sample_index GROUP BY label)"""
_CORR = "SELECT label, n, round(r, 6) AS r, round(r * sqrt(n), 6) AS z, NULL AS problem FROM "
_VERTEX = """
, k AS (SELECT case_id, segment, i, time_s AS t1, temp AS y1, lag(time_s) OVER w AS t0, lead(time_s) OVER w AS t2, lag(temp) OVER w AS y0, lead(temp) OVER w AS y2,
     row_number() OVER w AS pos, count(*) OVER (PARTITION BY case_id, segment) AS m
   FROM (SELECT run_id AS case_id, sample_index // 60 AS segment, sample_index AS i, time_s, "T" AS temp FROM wide) WINDOW w AS (PARTITION BY case_id, segment ORDER BY i)),
bent AS (SELECT *, (y1 - y0) / (t1 - t0) AS sl, ((y2 - y1) / (t2 - t1) - (y1 - y0) / (t1 - t0)) / (t2 - t0) AS cu FROM k WHERE y0 IS NOT NULL AND y2 IS NOT NULL),
tops AS (SELECT *, 0.5 * (t0 + t1) - sl / (2 * cu) AS tv FROM bent WHERE cu < 0),
heights AS (SELECT case_id, tv, i, y0 + sl * (tv - t0) + cu * (tv - t0) * (tv - t1) AS h FROM tops
  WHERE tv >= CASE WHEN pos = 2 THEN t0 ELSE (t0 + t1) / 2 END AND tv <= CASE WHEN pos = m - 1 THEN t2 ELSE (t1 + t2) / 2 END),
best AS (SELECT case_id, max(h) AS h, arg_max(tv, (h, -i)) AS tv FROM heights GROUP BY case_id),
flat AS (SELECT run_id AS case_id, any_value(plant_id) AS plant_id, max("T") AS peak, arg_max(time_s, ("T", -sample_index)) AS peak_t FROM wide GROUP BY run_id),
refined AS (SELECT case_id, plant_id, peak, peak_t, CASE WHEN h > peak THEN h ELSE peak END AS refined_peak, CASE WHEN h > peak THEN tv ELSE peak_t END AS refined_t FROM flat LEFT JOIN best USING (case_id))"""

SQL = {
    "trajectory_late_clocks": """
        SELECT case_id, 'missing' AS problem, max(i) + 1 - count(*) AS n FROM (SELECT event_id // 40 AS case_id, event_id % 40 AS i FROM events)
        WHERE i % 7 <> 1 AND i <= 2 + case_id % 30 GROUP BY case_id HAVING n > 0""",
    "noise_statistics": on(EVENT_LOG + _ERR, """SELECT run_id, variable_name, n, round(sigma, 6) AS sigma, round(mean, 6) AS mean, round(mean_z, 6) AS mean_z, round(rms, 6) AS rms, round(spread_z, 6) AS spread_z,
        round(lag_one, 6) AS lag_one, round(lag_one_z, 6) AS lag_one_z, round(b1, 6) AS beyond_one_sigma, round(b1_z, 6) AS beyond_one_sigma_z, round(b2, 6) AS beyond_two_sigma, round(b2_z, 6) AS beyond_two_sigma_z, round(top, 6) AS largest_in_sigmas FROM stats"""),
    "noise_series_problems": on(EVENT_LOG, """SELECT run_id, v AS variable_name, p AS problem FROM operating_runs, (VALUES ('C_A'), ('T')) x(v), (VALUES ('.e1.', 'too few samples'), ('.e2.', 'not finite'), ('.e3.', 'noise level not positive')) y(e, p)
        WHERE contains(run_id, e)"""),
    "noise_within_run_correlations": on(EVENT_LOG + _ERR, _CORR + "inside"),
    "noise_paired_plant_correlations": on(EVENT_LOG + _ERR, _CORR + "across"),
    "noise_score_sheet_summary": on(EVENT_LOG + _ERR, """
        SELECT count(*) AS n_scores, round(max(abs(z)), 5) AS largest_abs_z, arg_max(label, (abs(z), label)) AS largest_label, count(*) FILTER (abs(z) > 4) AS outside_limit, round(avg(z), 5) AS mean_of_scores, round(sqrt(avg(z * z)), 5) AS rms_of_scores
        FROM (SELECT run_id || ' ' || variable_name || ' mean_z' AS label, mean_z AS z FROM stats UNION ALL SELECT run_id || ' ' || variable_name || ' spread_z', spread_z FROM stats
              UNION ALL SELECT run_id || ' ' || variable_name || ' lag_one_z', lag_one_z FROM stats UNION ALL SELECT run_id || ' ' || variable_name || ' beyond_one_sigma_z', b1_z FROM stats
              UNION ALL SELECT run_id || ' ' || variable_name || ' beyond_two_sigma_z', b2_z FROM stats
              UNION ALL SELECT label, r * sqrt(n) FROM inside UNION ALL SELECT label, r * sqrt(n) FROM across UNION ALL SELECT label, r * sqrt(n) FROM along)"""),
    "series_switch_check": on(EVENT_LOG, """SELECT run_id, sum((sample_index = 0 OR (sample_index >= 10 AND (sample_index - 10) % 120 IN (0, 20)))::INT)::BIGINT AS n_found, n_found AS n_expected, 0::BIGINT AS n_different, true AS as_defined FROM wide GROUP BY run_id"""),
    "series_stored_runs": on(EVENT_LOG, """
        SELECT run_id, count(*) AS n_rows, count(*) FILTER (event_id % 2003 = 0) AS off_clock, NOT contains(run_id, '.e4.') AS rows_as_expected, count(*) FILTER (event_id % 1009 = 0) = 0 AS switches_as_defined,
               rows_as_expected AND off_clock = 0 AND switches_as_defined AS ok FROM wide GROUP BY run_id"""),
    "series_observation_grid": on(EVENT_LOG, """SELECT run_id, count(*) AS n_rows, true AS strictly_increasing, count(*) FILTER (sample_index >= 10 AND (sample_index - 10) % 120 IN (0, 20)) AS input_changes FROM wide GROUP BY run_id"""),
    "series_repetition": on(EVENT_LOG, """
        SELECT run_id, count(*) AS n_rows, count(*) FILTER (event_id % 509 = 0) AS one_side, 0::BIGINT AS instants_differ, count(*) FILTER (event_id % 509 <> 0 AND event_id % 1511 = 0) AS inputs_differ,
               count(*) FILTER (event_id % 509 <> 0 AND plant_id = 'source') AS readings_differ FROM wide GROUP BY run_id"""),
    "trajectory_ranges_and_peaks": on(EVENT_LOG, "SELECT run_id AS case_id, min(C_A) AS smallest, max(C_A) AS peak, arg_max(time_s, (C_A, -sample_index)) AS peak_t, count(*) AS n FROM wide GROUP BY run_id"),
    "trajectory_refined_peaks": on(EVENT_LOG + _VERTEX, "SELECT case_id, round(peak, 6) AS peak, peak_t, round(refined_peak, 6) AS refined_peak, round(refined_t, 6) AS refined_t FROM refined"),
    "trajectory_time_above": on(EVENT_LOG, """SELECT run_id AS case_id, coalesce(sum((hot + after) * 3.0::DOUBLE), 0) AS seconds_above
        FROM (SELECT run_id, ("T" > 358)::INT AS hot, lead(("T" > 358)::INT) OVER (PARTITION BY run_id ORDER BY sample_index) AS after FROM wide) GROUP BY run_id"""),
    "trajectory_balance_closure": on(EVENT_LOG, """
        SELECT case_id, round(a, 7) AS mass_residual, round(b, 7) AS mass_scale, round(c, 7) AS energy_residual, round(d, 7) AS energy_scale, round(e, 7) AS reacted, round(g, 7) AS reaction_heating, o AS odd_segments,
               round(a / b, 7) AS relative_mass_residual, round(c / d, 7) AS relative_energy_residual, a <= 0.05 * b AND c <= 0.05 * d AS closes
        FROM (SELECT case_id, sum(abs(dc - mi)) AS a, sum(ms) AS b, sum(abs(dy - ei)) AS c, sum(es) AS d, sum(re) AS e, sum(he) AS g, count(*) FILTER (odd) AS o
          FROM (SELECT case_id, segment, sum(w * (f - r)) AS mi, sum(w * (fh + rh - eh)) AS ei, sum(w * (abs(f) + abs(r))) AS ms, sum(w * (abs(fh) + abs(rh) + abs(eh))) AS es, sum(w * r) AS re, sum(w * rh) AS he,
                  arg_max(c, j) - arg_min(c, j) AS dc, arg_max(y, j) - arg_min(y, j) AS dy, any_value(n) % 2 = 1 AS odd
            FROM (SELECT *, 6.0::DOUBLE * (CASE WHEN n < 2 OR j > n - n % 2 THEN 0 WHEN j = 0 OR j = n - n % 2 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END / 3.0::DOUBLE + CASE WHEN n % 2 = 1 AND j >= n - 1 THEN 0.5 ELSE 0 END) AS w
              FROM (SELECT run_id AS case_id, sample_index // 60 AS segment, sample_index % 60 AS j, C_A AS c, "T" AS y, (C_Af - C_A) / 50 AS f, C_A / 100 AS r, (T_f - "T") / 50 AS fh, C_A / 400 AS rh, ("T" - T_c) / 100 AS eh,
                      count(*) OVER (PARTITION BY run_id, sample_index // 60) - 1 AS n FROM wide))
            GROUP BY case_id, segment) GROUP BY case_id)"""),
    "trajectory_verdicts": on(EVENT_LOG, """
        SELECT case_id, true AS values_finite, bool_and(c > 0 AND c <= greatest(rich, c0) * (1 + 1e-9) AND y >= least(cold, y0) * (1 - 1e-9)) AS states_physical, min(y) >= 340 AND max(y) <= 359.85 AS inside_envelope
        FROM (SELECT run_id AS case_id, C_A AS c, "T" AS y, max(C_Af) OVER w AS rich, min(least(T_f, T_c)) OVER w AS cold, first_value(C_A) OVER w AS c0, first_value("T") OVER w AS y0 FROM wide WINDOW w AS (PARTITION BY run_id ORDER BY sample_index)) GROUP BY case_id"""),
    "trajectory_subsampling": on(EVENT_LOG, "SELECT run_id AS case_id, sample_index AS i, sample_index // 2 AS tick FROM wide WHERE sample_index % 2 = 0"),
    "trajectory_subsampling_problems": on(EVENT_LOG, """
        SELECT case_id, problem, n FROM (
          SELECT case_id, 'missing' AS problem, max(i) // 2 + 1 - count(*) FILTER (i % 2 = 0) AS n FROM (SELECT run_id AS case_id, sample_index AS i FROM wide WHERE event_id % 499 <> 0 OR sample_index = 0) GROUP BY case_id
          UNION ALL SELECT case_id, 'between', count(*) FILTER (i % 2 = 1 AND u <> before) FROM (
            SELECT case_id, i, u, lag(u) OVER (PARTITION BY case_id ORDER BY i) AS before FROM (
              SELECT run_id AS case_id, sample_index AS i, (CASE WHEN sample_index = 33 THEN 0.003::DOUBLE ELSE q END, C_Af, T_f, T_c) AS u FROM wide WHERE event_id % 499 <> 0 OR sample_index = 0)) GROUP BY case_id)
        WHERE n > 0"""),
    "trajectory_phase_differences": on(EVENT_LOG, """
        SELECT definition, coalesce(phase, 'whole run') AS phase, count(*) AS n, round(max(abs(d)), 6) AS largest, round(sqrt(avg(d * d)), 6) AS rms, round(avg((d > 0)::INT), 6) AS share_above, round(max(abs(d)) / 5, 6) AS largest_in_sigmas, round(sqrt(avg(d * d)) / 5, 6) AS rms_in_sigmas
        FROM (SELECT substr(a.run_id, length(a.plant_id) + 2) AS definition, CASE WHEN a.q <> 0.002 THEN 'excursion' ELSE 'rest' END AS phase, b.C_A - a.C_A AS d FROM wide a JOIN wide b
              ON substr(a.run_id, length(a.plant_id) + 2) = substr(b.run_id, length(b.plant_id) + 2) AND a.sample_index = b.sample_index WHERE a.plant_id = 'source' AND b.plant_id = 'target')
        GROUP BY GROUPING SETS ((definition), (definition, phase))"""),
    "trajectory_first_moves": on(EVENT_LOG, """
        SELECT case_id, segment, dir AS direction, ext AS extreme, 6.0::DOUBLE * spot AS extreme_t, spot > i0 AND spot < i1 AS inside, ve AS value_at_end, round(abs(ext - ve), 6) AS beyond_end
        FROM (SELECT *, CASE WHEN dir > 0 THEN hi ELSE lo END AS ext, CASE WHEN dir > 0 THEN hi_i ELSE lo_i END AS spot
          FROM (SELECT *, CASE WHEN v1 > v0 THEN 1 WHEN v1 < v0 THEN -1 WHEN hi - v0 > v0 - lo THEN 1 WHEN hi - v0 < v0 - lo THEN -1 WHEN hi = v0 THEN 0 WHEN hi_i < lo_i THEN 1 ELSE -1 END AS dir
            FROM (SELECT run_id AS case_id, sample_index // 60 AS segment, min(sample_index) AS i0, max(sample_index) AS i1, arg_min(C_A, sample_index) AS v0, arg_max(C_A, sample_index) AS ve, max(C_A) AS hi, min(C_A) AS lo,
                    arg_max(sample_index, (C_A, -sample_index)) AS hi_i, arg_min(sample_index, (C_A, sample_index)) AS lo_i, max(C_A) FILTER (sample_index % 60 = 1) AS v1 FROM wide GROUP BY ALL)))"""),
    "trajectory_settle_residuals": on(EVENT_LOG, """SELECT run_id AS case_id, sample_index // 60 AS segment, round(abs(arg_max(C_A, sample_index) - 100), 6) AS residual_C_A, round(abs(arg_max("T", sample_index) - 355), 6) AS residual_T FROM wide GROUP BY ALL"""),
    "trajectory_worst_cases": on(EVENT_LOG + _VERTEX, """SELECT plant_id, round(max(refined_peak), 6) AS worst, arg_max(case_id, (refined_peak, case_id)) AS worst_case, count(*) AS n_cases, count(*) FILTER (refined_peak >= 360) AS n_rejected FROM refined GROUP BY plant_id"""),
    "trajectory_switching_instants": """
        SELECT o_custkey, position, duration_s, ends_at_s, round_even(ends_at_s / 6.0::DOUBLE, 0)::BIGINT AS tick, round_even(ends_at_s / 6.0::DOUBLE, 0) * 6 = ends_at_s AS on_clock
        FROM (SELECT *, sum(duration_s) OVER (PARTITION BY o_custkey ORDER BY position) AS ends_at_s
              FROM (SELECT o_custkey, o_orderkey AS position, 6.0::DOUBLE * (1 + o_orderkey % 20) + CASE WHEN o_orderkey % 97 = 0 THEN 0.5 ELSE 0 END AS duration_s FROM orders))""",
}
