"""Event windows, budgets, scores and physical checks."""

from pyspark.sql import functions as F

from tickweave.contract import INPUTS, STATES, constant
from tickweave.operators import scoring, windows
from tickweave.plans.bands import Bands
from tickweave.sources import eventlog
from verification.series_queries import aligned_rounded as rounded
from verification.tables_sql import EVENT_LOG, on

BUDGETS = (2, 3, 4)
ROLES = [("hold", "held out"), ("lag1", "selection"), ("fail", "fitting")]


class Log:
    """The steps of the evaluation path over the event log, lazily."""

    def __init__(self, spark, sf, rough=False):
        wide = eventlog.wide_log(spark, sf)
        self.spark = spark
        self.tables = eventlog.event_log(spark, sf)
        self.aligned = (eventlog.rough_wide(wide) if rough else wide).withColumn("complete", F.lit(True))
        self.nominal = windows.nominal_inputs(self.tables.process_parameters)
        self.modes = self.tables.operating_runs.select("run_id", "operating_mode")
        self.excursions = windows.excursions(self.aligned, self.nominal, self.modes)
        self.windows = windows.find_windows(self.excursions)

    @property
    def data(self):
        return windows.window_data(windows.window_ticks(self.windows), self.aligned)

    @property
    def parts(self):
        return windows.split_budgets(self.windows, BUDGETS)

    @property
    def signs(self):
        return windows.onset_signs(self.windows, self.nominal, self.tables.operating_runs)

    @property
    def sigmas(self):
        runs = self.tables.operating_runs.select("run_id", "plant_id")
        return runs.join(scoring.noise_levels(self.tables.sensors), "plant_id").drop("plant_id")

    @property
    def enthalpy(self):
        runs = self.tables.operating_runs.select("run_id", "plant_id")
        return runs.join(scoring.plant_constants(self.tables.process_parameters), "plant_id").select("run_id", "reaction_enthalpy")

    def predictions(self):
        data = self.data
        initial = windows.initial_states(data)
        return data, initial, scoring.reference_predictions(data, initial, self.aligned)

    def errors(self):
        data, _, predictions = self.predictions()
        return scoring.errors(predictions, data, self.sigmas)


def _scores(spark, sf):
    roles = constant(spark, ROLES, "model string, role string")
    return rounded(scoring.evaluate(Log(spark, sf).errors(), roles))


def _violations(spark, sf):
    log = Log(spark, sf)
    data, initial, predictions = log.predictions()
    wild = predictions.withColumn("C_A_hat", F.col("C_A_hat") * 2 - 100).withColumn("T_hat", F.col("T_hat") - 15)
    found = scoring.bound_violations(wild, data, initial, log.enthalpy)
    # a negative value that is rounded to zero keeps its sign, as in the SQL
    signed = F.when((F.col("value") < 0.0) & (F.round("value", 6) == 0.0), F.lit(-0.0)).otherwise(F.round("value", 6))
    return found.withColumns({"value": signed, "limit": F.round("limit", 6)})


def _coverage(spark, sf):
    data, _, predictions = Log(spark, sf).predictions()
    return scoring.coverage(predictions, data)


def _implied(spark, sf):
    log = Log(spark, sf)
    stepped = Bands(("run_id",), "sample_index").scan(log.aligned, lag={f"was_{s}": s for s in STATES})
    points = stepped.where(F.col("was_T").isNotNull()).select(
        "plant_id", "run_id", "sample_index", *STATES, *INPUTS, *[((F.col(s) - F.col(f"was_{s}")) / 6.0).alias(f"f_{s}") for s in STATES]
    )
    return scoring.implied_terms(points, scoring.plant_constants(log.tables.process_parameters))


def _implied_rows(spark, sf):
    return _implied(spark, sf).select(
        "run_id", "sample_index", F.round("rate", 6).alias("rate"), F.round("heat_flow", 2).alias("heat_flow"), "above_coolant",
        (F.col("rate_bound") < 1e-12).alias("small_rate_bound"), (F.col("heat_flow_bound") < 1e-4).alias("small_heat_bound"),
    )


def _with_log(step):
    return lambda spark, sf: step(Log(spark, sf))


def _with_gaps(log):
    """Predictions of which one model lacks every third excursion."""
    data, _, predictions = log.predictions()
    return data, predictions.where("NOT (model = 'fail' AND excursion % 3 = 2)")


def _refused_models(spark, sf):
    data, predictions = _with_gaps(Log(spark, sf))
    return scoring.refused_models(scoring.coverage(predictions, data))


def _scores_complete(spark, sf):
    log = Log(spark, sf)
    data, predictions = _with_gaps(log)
    roles = constant(spark, ROLES, "model string, role string")
    return rounded(scoring.evaluate_complete(scoring.errors(predictions, data, log.sigmas), roles, scoring.coverage(predictions, data)))


def _disagreement(spark, sf):
    log = Log(spark, sf)
    data, _, predictions = log.predictions()
    hold, lag1 = predictions.where("model = 'hold'"), predictions.where("model = 'lag1'").withColumn("model", F.lit("hold"))
    return rounded(scoring.largest_disagreement(hold, lag1, log.sigmas))


QUERIES = {
    "windows_run_preconditions": lambda spark, sf: windows.run_preconditions(
        eventlog.planted(spark, sf), eventlog.wide_log(spark, sf).where("event_id % 997 <> 0").withColumn("complete", F.lit(True))),
    "windows_excursions": lambda spark, sf: Log(spark, sf).excursions.drop("hold", "position"),
    "windows_excursions_rough": lambda spark, sf: Log(spark, sf, rough=True).excursions.drop("hold", "position"),
    "windows_found": lambda spark, sf: Log(spark, sf).windows.select("run_id", "protocol", "excursion", "onset", "position", "context_start", "scored_end"),
    "windows_found_rough": lambda spark, sf: Log(spark, sf, rough=True).windows.select("run_id", "excursion", "onset", "position"),
    "windows_never_nominal": lambda spark, sf: windows.never_nominal(
        eventlog.wide_log(spark, sf).withColumn("q", F.when(F.col("run_id").contains(".e7."), F.col("q") + 1e-9).otherwise(F.col("q"))),
        windows.nominal_inputs(eventlog.event_log(spark, sf).process_parameters)),
    "windows_ticks": lambda spark, sf: windows.window_ticks(Log(spark, sf).windows),
    "windows_data": lambda spark, sf: Log(spark, sf).data.select("run_id", "excursion", "sample_index", "role", "C_A", "T", "q"),
    "windows_initial_states": lambda spark, sf: rounded(windows.initial_states(Log(spark, sf).data)),
    "windows_budgets": lambda spark, sf: Log(spark, sf).parts.select("run_id", "budget", "excursion", "position", "part"),
    "windows_refused_budgets": _with_log(lambda log: windows.refused_budgets(log.windows, log.tables.operating_runs, BUDGETS)),
    "windows_part_indices": lambda spark, sf: windows.part_indices(Log(spark, sf).parts),
    "windows_split_integrity": lambda spark, sf: windows.split_integrity(Log(spark, sf).parts),
    "windows_excitation": _with_log(lambda log: windows.excitation(log.parts, log.signs)),
    "windows_corner_counts": lambda spark, sf: windows.corner_counts(Log(spark, sf).signs),
    "windows_off_design_corners": _with_log(lambda log: windows.off_design_corners(windows.onset_signs(
        log.windows.withColumn("q", F.when(F.col("excursion") == 2, 0.002).otherwise(F.col("q"))), log.nominal, log.tables.operating_runs))),
    "score_prediction_coverage": _coverage,
    "score_evaluate": _scores,
    "score_refused_models": _refused_models,
    "score_evaluate_complete": _scores_complete,
    "score_normalised_rms": lambda spark, sf: rounded(scoring.normalised_rms(Log(spark, sf).errors(), ["model", "run_id"])),
    "score_pooling_problems": _with_log(lambda log: scoring.pooling_problems(
        log.errors().withColumn("sigma_T", F.when(F.col("excursion") == 3, 0.0).otherwise(F.col("sigma_T"))), log.windows)),
    "score_leave_one_run_out": _with_log(lambda log: scoring.leave_one_run_out(log.windows, log.tables.operating_runs)),
    "score_largest_disagreement": _disagreement,
    "physics_bound_violations": _violations,
    "physics_plant_constants": lambda spark, sf: rounded(scoring.plant_constants(eventlog.event_log(spark, sf).process_parameters), 9),
    "physics_implied_terms": _implied_rows,
    "physics_implied_counts": lambda spark, sf: scoring.implied_counts(_implied(spark, sf), ["run_id"]),
    "physics_unrepresentable_terms": lambda spark, sf: scoring.unrepresentable_terms(
        _implied(spark, sf).withColumn("rate", F.when(F.col("sample_index") % 50 == 0, float("inf")).otherwise(F.col("rate")))).select("run_id", "sample_index", "term"),
}


def _excursion_ctes(q: str) -> str:
    return f"""
, flagged AS (SELECT * REPLACE ({q} AS q) FROM wide),
moved AS (SELECT *, (q, C_Af, T_f, T_c) <> (0.002::DOUBLE, 500::DOUBLE, 350::DOUBLE, 337.5::DOUBLE) AS off FROM flagged),
looked AS (
  SELECT *, off AND NOT coalesce(lag(off) OVER w, false) AS onset, count(*) FILTER (NOT off) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS calm,
         min((q, C_Af, T_f, T_c)) OVER (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS lowest,
         max((q, C_Af, T_f, T_c)) OVER (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS highest,
         count(*) FILTER (off) OVER (w ROWS BETWEEN 20 FOLLOWING AND 109 FOLLOWING) AS late, max(sample_index) OVER (PARTITION BY run_id) AS last_tick
  FROM moved WINDOW w AS (PARTITION BY run_id ORDER BY sample_index)),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sample_index) AS excursion, lead(sample_index) OVER (PARTITION BY run_id ORDER BY sample_index) AS next_onset,
         CASE WHEN calm < 10 THEN 'no context' WHEN sample_index + 110 > last_tick THEN 'run ends before the last scored reading'
              WHEN lowest <> highest THEN 'inputs change inside the hold' WHEN late > 0 THEN 'inputs not nominal in the rest of the window' END AS first_reason
  FROM looked WHERE onset),
overlapped AS (
  SELECT *, max(CASE WHEN first_reason IS NULL THEN sample_index + 110 END) OVER (PARTITION BY run_id ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scored_before FROM judged),
excursions AS (
  SELECT run_id, 'p3' AS protocol, excursion, sample_index AS onset, 110 AS scored_readings, last_tick, next_onset, q, C_Af, T_f, T_c,
         CASE WHEN first_reason IS NULL AND sample_index - 9 <= scored_before THEN 'context inside the window before' ELSE first_reason END AS reason,
         CASE WHEN reason IS NULL THEN 'window' WHEN reason IN ('no context', 'run ends before the last scored reading') THEN 'skipped' ELSE 'refused' END AS outcome
  FROM overlapped),
windows AS (
  SELECT *, onset - 9 AS context_start, onset + 110 AS scored_end, row_number() OVER (PARTITION BY run_id ORDER BY onset) AS position
  FROM excursions WHERE outcome = 'window' AND run_id NOT IN (SELECT run_id FROM excursions WHERE outcome = 'refused'))"""


CLEAN = EVENT_LOG + _excursion_ctes("q")
ROUGH = EVENT_LOG + _excursion_ctes("CASE WHEN event_id % 1009 = 0 THEN 0.0019::DOUBLE ELSE q END")
_TICKS = """
, ticks AS (
  SELECT run_id, excursion, 'context' AS role, unnest(range(onset - 9, onset + 1)) AS sample_index, onset FROM windows
  UNION ALL SELECT run_id, excursion, 'scored', unnest(range(onset + 1, onset + 111)), onset FROM windows
  UNION ALL SELECT run_id, excursion, 'input', unnest(range(onset, onset + 110)), onset FROM windows),
placed_ticks AS (
  SELECT run_id, excursion, sample_index, role, sample_index - onset AS "offset",
         CASE WHEN role = 'scored' THEN CASE WHEN sample_index - onset <= 20 THEN 'excursion' WHEN sample_index - onset <= 70 THEN 'return' ELSE 'settled' END END AS phase FROM ticks),
initial AS (SELECT run_id, excursion, avg(C_A) AS ic, avg(T) AS it FROM ticks JOIN wide USING (run_id, sample_index) WHERE role = 'context' GROUP BY ALL)"""
_PREDICTED = _TICKS + """
, scored AS (SELECT run_id, excursion, sample_index, phase, C_A, T FROM placed_ticks JOIN wide USING (run_id, sample_index) WHERE role = 'scored'),
predictions AS (
  SELECT 'hold' AS model, run_id, excursion, sample_index, ic AS c_hat, it AS t_hat FROM scored JOIN initial USING (run_id, excursion)
  UNION ALL SELECT 'fail', run_id, excursion, sample_index, ic, it FROM scored JOIN initial USING (run_id, excursion) WHERE excursion % 7 <> 0
  UNION ALL SELECT 'lag1', s.run_id, s.excursion, s.sample_index, w.C_A, w.T FROM scored s JOIN wide w ON w.run_id = s.run_id AND w.sample_index + 1 = s.sample_index),
errs AS (SELECT model, run_id, excursion, sample_index, phase, c_hat - C_A AS ec, t_hat - T AS et FROM predictions JOIN scored USING (run_id, excursion, sample_index))"""
_SPLIT = """
, parts AS (
  SELECT w.*, b AS budget, CASE WHEN position <= b - greatest(1, b // 5) THEN 'fitting' ELSE 'validation' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n_windows FROM windows) w, (VALUES (2), (3), (4)) v(b) WHERE n_windows >= b AND position <= b),
prefix AS (SELECT run_id, budget, arg_max(coalesce(next_onset, last_tick), onset) AS prefix_end FROM parts GROUP BY ALL)"""
_PART_TICKS = _SPLIT + """
, pt AS (SELECT run_id, budget, part, 'context' AS role, unnest(range(onset - 9, onset + 1)) AS tick FROM parts
  UNION ALL SELECT run_id, budget, part, 'scored', unnest(range(onset + 1, onset + 111)) FROM parts
  UNION ALL SELECT run_id, budget, part, 'input', unnest(range(onset, onset + 110)) FROM parts)"""
_SIGNS = """
, signs AS (SELECT run_id, excursion, CASE WHEN q > 0.002 THEN 1 WHEN q < 0.002 THEN -1 ELSE 0 END AS a, sign(C_Af - 500)::INT AS b, sign(T_f - 350)::INT AS c, sign(T_c - 337.5)::INT AS d FROM windows),
cornered AS (SELECT *, list_aggregate(list_transform([a, b, c, d], lambda x: CASE x WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END), 'string_agg', '') AS corner FROM signs)"""
_ROUNDS = ", ".join(
    f"round({e}, 6) AS {n}" for e, n in (
        ("avg(ec * ec)", "mse_C_A"), ("avg(et * et)", "mse_T"), ("sqrt(avg(ec * ec))", "rmse_C_A"), ("sqrt(avg(et * et))", "rmse_T"),
        ("avg(ec * ec) / 25", "normalised_mse_C_A"), ("avg(et * et) * 4", "normalised_mse_T"), ("sqrt((avg(ec * ec) / 25 + avg(et * et) * 4) / 2)", "j"),
    )
)
_EXCESS = ", ".join(
    f"CASE WHEN model = 'hold' THEN round({e}, 6) END AS {n}" for e, n in (
        ("avg(ec * ec) - 25", "excess_mse_C_A"), ("avg(et * et) - 0.25", "excess_mse_T"), ("(avg(ec * ec) / 25 + avg(et * et) * 4) / 2 - 1", "excess_j_squared"))
)
_IMPLIED = """
, stepped AS (SELECT *, (C_A - lag(C_A) OVER w) / 6 AS fc, (T - lag(T) OVER w) / 6 AS ft FROM wide WINDOW w AS (PARTITION BY run_id ORDER BY sample_index)),
rated AS (SELECT *, q / 0.1::DOUBLE * (C_Af - C_A) AS supply, q / 0.1::DOUBLE * (T_f - T) AS sensible, supply - fc AS rate,
   50000.0::DOUBLE / 239000.0::DOUBLE AS per_mole, 23900.0::DOUBLE AS mass FROM stepped WHERE fc IS NOT NULL),
implied AS (SELECT *, mass * (sensible + per_mole * rate - ft) AS heat, 4 * pow(2.0::DOUBLE, -53) * (abs(supply) + abs(fc)) AS rate_bound,
   12 * pow(2.0::DOUBLE, -53) * mass * (abs(sensible) + per_mole * (abs(supply) + abs(fc)) + abs(ft)) AS heat_bound, sign(T - T_c)::INT AS above FROM rated)"""

SQL = {
    "windows_run_preconditions": on(EVENT_LOG, """
        SELECT run_id, 'not consecutive ticks' AS problem FROM wide WHERE event_id % 997 <> 0 GROUP BY run_id HAVING count(*) <> max(sample_index) + 1 OR min(sample_index) > 0
        UNION ALL SELECT 'empty.' || run_id, 'never' FROM operating_runs WHERE false"""),
    "windows_excursions": on(CLEAN, "SELECT * FROM excursions"),
    "windows_excursions_rough": on(ROUGH, "SELECT * FROM excursions"),
    "windows_found": on(CLEAN, "SELECT run_id, protocol, excursion, onset, position, context_start, scored_end FROM windows"),
    "windows_found_rough": on(ROUGH, "SELECT run_id, excursion, onset, position FROM windows"),
    "windows_never_nominal": on(EVENT_LOG, "SELECT run_id, 'never nominal' AS problem FROM operating_runs WHERE contains(run_id, '.e7.')"),
    "windows_ticks": on(CLEAN + _TICKS, "SELECT * FROM placed_ticks"),
    "windows_data": on(CLEAN + _TICKS, "SELECT run_id, excursion, sample_index, role, C_A, T, q FROM ticks JOIN wide USING (run_id, sample_index)"),
    "windows_initial_states": on(CLEAN + _TICKS, "SELECT run_id, excursion, round(ic, 6) AS initial_C_A, round(it, 6) AS initial_T FROM initial"),
    "windows_budgets": on(CLEAN + _SPLIT, "SELECT run_id, budget, excursion, position, part FROM parts"),
    "windows_refused_budgets": on(CLEAN, """SELECT run_id, b AS budget, coalesce(n, 0) AS n_windows FROM operating_runs LEFT JOIN (SELECT run_id, count(*) AS n FROM windows GROUP BY ALL) USING (run_id),
        (VALUES (2), (3), (4)) v(b) WHERE coalesce(n, 0) < b"""),
    "windows_part_indices": on(CLEAN + _PART_TICKS, "SELECT run_id, budget, " + ", ".join(
        f"count(DISTINCT tick) FILTER (part = '{p}' AND role = '{r}') AS {p}_{r}_ticks" for p in ("fitting", "validation") for r in ("context", "scored", "input"))
        + ", prefix_end, prefix_end + 1 - count(DISTINCT tick) FILTER (role <> 'input') AS unused_ticks FROM pt JOIN prefix USING (run_id, budget) GROUP BY run_id, budget, prefix_end"),
    "windows_split_integrity": on(CLEAN + _PART_TICKS, """
        SELECT run_id, budget, count(*) FILTER (cs) AS context_and_scored, count(*) FILTER (fv) AS shared, count(*) FILTER (tick > prefix_end) AS beyond_prefix,
               any_value(nf) AS n_fitting, any_value(nv) AS n_validation
        FROM (SELECT run_id, budget, tick, bool_or(role = 'context') AND bool_or(role = 'scored') AS cs, count(DISTINCT part) = 2 AS fv FROM pt GROUP BY ALL)
        JOIN prefix USING (run_id, budget) JOIN (SELECT run_id, budget, count(*) FILTER (part = 'fitting') AS nf, count(*) FILTER (part = 'validation') AS nv FROM parts GROUP BY ALL) USING (run_id, budget)
        GROUP BY run_id, budget"""),
    "windows_excitation": on(CLEAN + _SPLIT + _SIGNS + """
        , vectors AS (SELECT DISTINCT run_id, budget, part, a, b, c, d, corner FROM parts JOIN cornered USING (run_id, excursion)),
        sizes AS (SELECT run_id, budget, part, count(*) AS n FROM vectors GROUP BY ALL),
        v AS (SELECT *, row_number() OVER (PARTITION BY run_id, budget, part ORDER BY corner) AS i FROM vectors),
        two AS (SELECT x.run_id, x.budget, x.part, x.i AS i, y.i AS j, x.a * y.b - x.b * y.a AS ab, x.a * y.c - x.c * y.a AS ac, x.a * y.d - x.d * y.a AS ad,
                       x.b * y.c - x.c * y.b AS bc, x.b * y.d - x.d * y.b AS bd, x.c * y.d - x.d * y.c AS cd
                FROM v x JOIN v y ON (x.run_id, x.budget, x.part) = (y.run_id, y.budget, y.part) AND x.i < y.i),
        three AS (SELECT DISTINCT t.run_id, t.budget, t.part FROM two t JOIN v z ON (t.run_id, t.budget, t.part) = (z.run_id, z.budget, z.part) AND z.i > t.j
                  WHERE ab * z.c - ac * z.b + bc * z.a <> 0 OR ab * z.d - ad * z.b + bd * z.a <> 0 OR ac * z.d - ad * z.c + cd * z.a <> 0 OR bc * z.d - bd * z.c + cd * z.b <> 0),
        four AS (SELECT DISTINCT s.run_id, s.budget, s.part FROM two s JOIN two t ON (s.run_id, s.budget, s.part) = (t.run_id, t.budget, t.part) AND s.j < t.i
                 WHERE s.ab * t.cd - s.ac * t.bd + s.ad * t.bc + s.bc * t.ad - s.bd * t.ac + s.cd * t.ab <> 0)""", """
        SELECT s.run_id, s.budget, s.part, s.n AS distinct_corners,
               CASE WHEN (s.run_id, s.budget, s.part) IN (SELECT (run_id, budget, part) FROM four) THEN 4
                    WHEN (s.run_id, s.budget, s.part) IN (SELECT (run_id, budget, part) FROM three) THEN 3
                    WHEN (s.run_id, s.budget, s.part) IN (SELECT (run_id, budget, part) FROM two WHERE (ab, ac, ad, bc, bd, cd) <> (0, 0, 0, 0, 0, 0)) THEN 2 ELSE 1 END AS rank FROM sizes s"""),
    "windows_corner_counts": on(CLEAN + _SIGNS, "SELECT corner, count(*) AS n_windows FROM cornered GROUP BY corner"),
    "windows_off_design_corners": on(CLEAN + _SIGNS, "SELECT run_id, excursion, '0' || corner[2:] AS corner FROM cornered WHERE excursion = 2"),
    "score_prediction_coverage": on(CLEAN + _PREDICTED, """SELECT model, (SELECT count(*) FROM scored) AS n_readings, count(*) AS n_predictions,
        (SELECT count(*) FROM scored) - count(*) AS n_missing, 0 AS n_unexpected FROM predictions GROUP BY model"""),
    "score_evaluate": on(CLEAN + _PREDICTED, "\nUNION ALL\n".join(
        f"SELECT model, {r} AS run_id, {x} AS excursion, {p} AS phase, count(*) AS readings, {_ROUNDS}, {_EXCESS}, '{g}' AS grain, "
        f"CASE model WHEN 'hold' THEN 'held out' WHEN 'lag1' THEN 'selection' ELSE 'fitting' END AS role FROM errs GROUP BY {k}"
        for g, r, x, p, k in (("pooled", "NULL", "NULL", "NULL", "model"), ("phase", "NULL", "NULL", "phase", "model, phase"),
                              ("window", "run_id", "excursion", "NULL", "model, run_id, excursion")))),
    "score_refused_models": on(CLEAN + _PREDICTED, "SELECT 'fail' AS model, 'readings without a prediction' AS problem, count(*) AS n FROM scored WHERE excursion % 3 = 2 OR excursion % 7 = 0 HAVING n > 0"),
    "score_normalised_rms": on(CLEAN + _PREDICTED, "SELECT model, run_id, round(sqrt(avg((ec * ec / 25 + et * et * 4) / 2)), 6) AS j FROM errs GROUP BY ALL"),
    "score_pooling_problems": on(CLEAN + _PREDICTED, """SELECT model, problem FROM (SELECT DISTINCT model FROM errs WHERE excursion = 3),
        (VALUES ('noise level not positive and finite'), ('unequal noise levels')) v(problem)"""),
    "score_leave_one_run_out": on(CLEAN, """SELECT r.run_id, count(w.run_id) AS n_windows, count(DISTINCT w.run_id) AS n_runs FROM operating_runs r
        LEFT JOIN (SELECT w.run_id, o.plant_id FROM windows w JOIN operating_runs o USING (run_id)) w ON w.plant_id = r.plant_id AND w.run_id <> r.run_id GROUP BY r.run_id"""),
    "score_largest_disagreement": on(CLEAN + _PREDICTED, """SELECT 'hold' AS model, count(*) AS n, 0::BIGINT AS only_first, 0::BIGINT AS only_second, round(max(abs(a.c_hat - b.c_hat)) / 5, 6) AS largest_C_A, round(max(abs(a.t_hat - b.t_hat)) * 2, 6) AS largest_T
        FROM predictions a JOIN predictions b USING (run_id, excursion, sample_index) WHERE a.model = 'hold' AND b.model = 'lag1' HAVING count(*) > 0"""),
    "physics_bound_violations": on(CLEAN + _PREDICTED + """
        , so_far AS (SELECT run_id, excursion, sample_index + 1 AS sample_index, max(C_Af) OVER w AS rich, min(least(T_f, T_c)) OVER w AS cold
            FROM ticks JOIN wide USING (run_id, sample_index) WHERE role = 'input' WINDOW w AS (PARTITION BY run_id, excursion ORDER BY sample_index)),
        limits AS (SELECT p.* REPLACE (c_hat * 2 - 100 AS c_hat, t_hat - 15 AS t_hat), greatest(ic, rich) AS top, least(it, cold) AS low FROM predictions p JOIN so_far USING (run_id, excursion, sample_index) JOIN initial USING (run_id, excursion))""", """
        SELECT model, run_id, excursion, sample_index, 'C_A below zero' AS bound, round(c_hat, 6) AS value, 0.0::DOUBLE AS "limit" FROM limits WHERE c_hat < 0
        UNION ALL SELECT model, run_id, excursion, sample_index, 'C_A above its initial value and every feed applied', round(c_hat, 6), round(top, 6) FROM limits WHERE c_hat > top
        UNION ALL SELECT model, run_id, excursion, sample_index, 'T below its initial value and every feed and coolant applied', round(t_hat, 6), round(low, 6) FROM limits WHERE t_hat < low"""),
    "physics_plant_constants": on(EVENT_LOG, """SELECT plant_id, 0.1::DOUBLE AS volume, 1000.0::DOUBLE AS density, 239.0::DOUBLE AS heat_capacity, -50000.0::DOUBLE AS reaction_enthalpy,
        23900.0::DOUBLE AS thermal_mass, round(50000.0::DOUBLE / 239000, 9) AS heat_per_mole FROM plants"""),
    "physics_implied_terms": on(EVENT_LOG + _IMPLIED, """SELECT run_id, sample_index, round(rate, 6) AS rate, round(heat, 2) AS heat_flow, above AS above_coolant,
        rate_bound < 1e-12 AS small_rate_bound, heat_bound < 1e-4 AS small_heat_bound FROM implied"""),
    "physics_implied_counts": on(EVENT_LOG + _IMPLIED, """SELECT run_id, count(*) AS points, count(*) FILTER (rate < -rate_bound) AS negative_rate,
        count(*) FILTER (abs(heat) > heat_bound AND sign(heat) <> above) AS incompatible_heat_flow, count(*) FILTER (above = 0) AS at_coolant_temperature,
        count(*) FILTER (abs(heat) <= heat_bound) AS heat_flow_within_bound FROM implied GROUP BY run_id"""),
    "physics_unrepresentable_terms": on(EVENT_LOG, "SELECT run_id, sample_index, 'rate' AS term FROM wide WHERE sample_index > 0 AND sample_index % 50 = 0"),
}
SQL["score_evaluate_complete"] = f"SELECT * FROM ({SQL['score_evaluate']}) WHERE model <> 'fail'"
