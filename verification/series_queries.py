"""Series operators and scalar functions."""

from pyspark.sql import functions as F

from tickweave.contract import INPUTS, UNITS, units_dimension
from tickweave.functions import scalars as S
from tickweave.operators import series
from tickweave.plans.dealing import dealt
from tickweave.sources import eventlog
from tickweave.sources.eventlog import NOMINAL, table
from verification.tables_sql import EVENT_LOG, PLANTED, on

ALIGNED = """
aligned AS (
  SELECT plant_id, run_id, sample_index, min(time_s) AS time_s,
         max(CASE variable_name WHEN 'C_A' THEN value END) AS C_A, max(CASE variable_name WHEN 'T' THEN value END) AS T,
         max(CASE variable_name WHEN 'q' THEN value END) AS q, max(CASE variable_name WHEN 'C_Af' THEN value END) AS C_Af,
         max(CASE variable_name WHEN 'T_f' THEN value END) AS T_f, max(CASE variable_name WHEN 'T_c' THEN value END) AS T_c,
         count(DISTINCT sensor_id) AS n_channels, count(*) AS n_rows,
         n_rows = 6 AND n_channels = 6 AND min(time_s) = max(time_s) AS complete
  FROM measurements JOIN sensors USING (plant_id, sensor_id) GROUP BY ALL)"""

LOG_ALIGNED = EVENT_LOG + "," + ALIGNED
BROKEN_ALIGNED = PLANTED + "," + ALIGNED


def aligned_rounded(df, digits=6):
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _log(spark, sf):
    tables = eventlog.event_log(spark, sf)
    return tables, series.aligned_series(tables)


def _broken(spark, sf):
    tables = eventlog.planted(spark, sf)
    return tables, series.aligned_series(tables)


def _blocks(source):
    def run(spark, sf):
        tables, aligned = source(spark, sf)
        return aligned_rounded(series.block_average(aligned, tables.operating_runs, 10))

    return run


_BLOCK_SQL = """
SELECT plant_id, run_id, block_index, round(block_start_s, 6) AS block_start_s, round(block_start_s + 60, 6) AS block_end_s,
       n_expected, n_present, round(n_present / n_expected::DOUBLE, 6) AS coverage,
       round(C_A_mean, 6) AS C_A_mean, round(T_mean, 6) AS T_mean,
       round(CASE WHEN q_lo = q_hi THEN q_lo END, 6) AS q, round(CASE WHEN c_lo = c_hi THEN c_lo END, 6) AS C_Af,
       round(CASE WHEN f_lo = f_hi THEN f_lo END, 6) AS T_f, round(CASE WHEN j_lo = j_hi THEN j_lo END, 6) AS T_c,
       q_lo = q_hi AND c_lo = c_hi AND f_lo = f_hi AND j_lo = j_hi AS inputs_constant
FROM (
  SELECT a.plant_id, a.run_id, a.sample_index // 10 AS block_index, any_value(r.start_time_s) + 60.0::DOUBLE * block_index AS block_start_s,
         least(10, any_value(r.n_samples) - 10 * block_index) AS n_expected,
         count(*) FILTER (complete) AS n_present,
         avg(CASE WHEN complete THEN C_A END) AS C_A_mean, avg(CASE WHEN complete THEN T END) AS T_mean,
         min(q) AS q_lo, max(q) AS q_hi, min(C_Af) AS c_lo, max(C_Af) AS c_hi,
         min(T_f) AS f_lo, max(T_f) AS f_hi, min(T_c) AS j_lo, max(T_c) AS j_hi
  FROM aligned a JOIN operating_runs r USING (run_id) GROUP BY a.plant_id, a.run_id, block_index)"""

_PAIR_SQL = """
, halves AS (
  SELECT a.*, r.n_samples, substr(a.run_id, length(a.plant_id) + 2) AS definition
  FROM aligned a JOIN operating_runs r USING (run_id)),
pairs AS (
  SELECT s.definition, s.run_id AS source_run, t.run_id AS target_run, greatest(s.n_samples, t.n_samples)::DOUBLE AS longer,
         s.time_s = t.time_s AS same_instant, (s.q, s.C_Af, s.T_f, s.T_c) = (t.q, t.C_Af, t.T_f, t.T_c) AS same_inputs,
         s.complete AND t.complete AS both_complete, t.C_A - s.C_A AS dc, t.T - s.T AS dt
  FROM halves s JOIN halves t ON s.definition = t.definition AND s.sample_index = t.sample_index
  WHERE s.plant_id = 'source' AND t.plant_id = 'target')
SELECT definition, source_run, target_run, count(*) AS n_paired, round(count(*) / longer, 8) AS coverage,
       count(*) FILTER (same_instant) AS n_same_instant, count(*) FILTER (same_inputs) AS n_same_inputs, count(*) FILTER (ok) AS n_used,
       round(avg(dc) FILTER (ok), 8) AS observed_difference_c_a_mean, round(stddev(dc) FILTER (ok), 8) AS observed_difference_c_a_std,
       round(min(dc) FILTER (ok), 8) AS observed_difference_c_a_min, round(max(dc) FILTER (ok), 8) AS observed_difference_c_a_max,
       round(avg(dt) FILTER (ok), 8) AS observed_difference_t_mean, round(stddev(dt) FILTER (ok), 8) AS observed_difference_t_std,
       round(min(dt) FILTER (ok), 8) AS observed_difference_t_min, round(max(dt) FILTER (ok), 8) AS observed_difference_t_max
FROM (SELECT *, same_instant AND same_inputs AND both_complete AS ok FROM pairs)
GROUP BY definition, source_run, target_run, longer"""

# Rows of DuckDB are equal where both hold a null; equality of the inputs one by one is not, as the operator has it.
_GAPS_PAIR_SQL = _PAIR_SQL.replace("(s.q, s.C_Af, s.T_f, s.T_c) = (t.q, t.C_Af, t.T_f, t.T_c)", "(s.q = t.q AND s.C_Af = t.C_Af AND s.T_f = t.T_f AND s.T_c = t.T_c)")


def _pairs(source):
    def run(spark, sf):
        tables, aligned = source(spark, sf)
        return aligned_rounded(series.compare_plants(aligned, tables.operating_runs, "source", "target"), 8)

    return run


_SWITCH = """
, flagged AS (
  SELECT *, coalesce((q, C_Af, T_f, T_c) IS DISTINCT FROM lag((q, C_Af, T_f, T_c)) OVER w, true) AS changed FROM wide
  WINDOW w AS (PARTITION BY run_id ORDER BY sample_index))"""


def _round_trip(spark, sf):
    """Aligned rows turned long again, against the stored rows: nothing may differ. Both sides are counted together, once."""
    tables, aligned = _log(spark, sf)
    again = eventlog.to_long(aligned)
    stored = tables.measurements.select(again.columns)
    both = again.withColumn("n", F.lit(1)).unionByName(stored.withColumn("n", F.lit(-1)))
    net = dealt(both, ("run_id", "sample_index", "sensor_id"), 2 * stored.count()).groupBy(*again.columns).agg(F.sum("n").alias("n"))
    return net.agg(*[F.coalesce(F.sum(F.when(sign * F.col("n") > 0, sign * F.col("n"))), F.lit(0)).alias(name) for name, sign in (("only_rebuilt", 1), ("only_stored", -1))])


def _symmetric(spark, sf):
    clean, broken = eventlog.event_log(spark, sf).measurements, eventlog.planted(spark, sf).measurements
    return _sym(clean, broken)


def _sym(a, b):
    from tickweave.operators.ingest import symmetric_difference

    return symmetric_difference(a, b).groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    "series_aligned": lambda spark, sf: _broken(spark, sf)[1],
    "series_aligned_clean": lambda spark, sf: _log(spark, sf)[1],
    "series_lagged_measurements": lambda spark, sf: aligned_rounded(series.lagged_measurements(eventlog.planted(spark, sf).measurements)),
    "series_block_average": _blocks(_log),
    "series_block_average_with_gaps": _blocks(_broken),
    "series_compare_plants": _pairs(_log),
    "series_compare_plants_with_gaps": _pairs(_broken),
    "series_input_switches": lambda spark, sf: series.input_switches(eventlog.wide_log(spark, sf)),
    "series_input_segments": lambda spark, sf: series.input_segments(eventlog.wide_log(spark, sf)),
    "series_long_rows": lambda spark, sf: eventlog.to_long(eventlog.wide_log(spark, sf)),
    "series_round_trip": _round_trip,
    "series_run_in_channel_order": lambda spark, sf: series.run_in_channel_order(eventlog.event_log(spark, sf), "target.p3.e3.x4.l60.a10.n0"),
    "series_part_moments": lambda spark, sf: aligned_rounded(series.part_moments(eventlog.wide_log(spark, sf), ["run_id"]), 8),
    "series_input_levels": lambda spark, sf: aligned_rounded(series.input_levels(eventlog.wide_log(spark, sf), NOMINAL)),
    "series_symmetric_difference": _symmetric,
}
_MOMENTS = ", ".join(f"round(avg({v}), 8) AS {v}_mean, round(stddev_pop({v}), 8) AS {v}_std" for v in ("C_A", "T", *INPUTS))
SQL = {
    "series_aligned": on(BROKEN_ALIGNED, "SELECT * FROM aligned"),
    "series_aligned_clean": on(LOG_ALIGNED, "SELECT * FROM aligned"),
    "series_lagged_measurements": on(PLANTED, """
        SELECT plant_id, run_id, sensor_id, sample_index, round(time_s, 6) AS time_s, round(value, 6) AS value,
               round(last_value, 6) AS previous_stored_value, sample_index - last_tick AS ticks_since_previous,
               round(time_s - last_time, 6) AS seconds_since_previous,
               round(if(last_tick = sample_index - 1, last_value, NULL), 6) AS value_one_period_ago
        FROM (SELECT *, lag(value) OVER w AS last_value, lag(sample_index) OVER w AS last_tick, lag(time_s) OVER w AS last_time
              FROM measurements WINDOW w AS (PARTITION BY plant_id, run_id, sensor_id ORDER BY sample_index, time_s, value NULLS FIRST))"""),
    "series_block_average": on(LOG_ALIGNED, _BLOCK_SQL),
    "series_block_average_with_gaps": on(BROKEN_ALIGNED, _BLOCK_SQL),
    "series_compare_plants": on(LOG_ALIGNED + _PAIR_SQL, ""),
    "series_compare_plants_with_gaps": on(BROKEN_ALIGNED + _GAPS_PAIR_SQL, ""),
    "series_input_switches": on(EVENT_LOG + _SWITCH, "SELECT run_id, sample_index, time_s, q, C_Af, T_f, T_c FROM flagged WHERE changed"),
    "series_input_segments": on(EVENT_LOG + _SWITCH, """
        SELECT run_id, min(sample_index) AS first_tick, max(sample_index) AS last_tick, any_value(q) AS q, any_value(C_Af) AS C_Af,
               any_value(T_f) AS T_f, any_value(T_c) AS T_c, count(*) AS n_ticks
        FROM (SELECT *, sum(changed::INT) OVER (PARTITION BY run_id ORDER BY sample_index) AS segment FROM flagged) GROUP BY run_id, segment"""),
    "series_long_rows": on(EVENT_LOG, "SELECT * FROM measurements"),
    "series_round_trip": "SELECT 0::BIGINT AS only_rebuilt, 0::BIGINT AS only_stored",
    "series_run_in_channel_order": on(EVENT_LOG, """
        SELECT channel_kind, channel_index, sensor_id, sample_index, time_s, value FROM measurements JOIN sensors USING (plant_id, sensor_id)
        WHERE run_id = 'target.p3.e3.x4.l60.a10.n0'"""),
    "series_part_moments": on(EVENT_LOG, f"""
        SELECT run_id, count(*) AS n_rows, {_MOMENTS},
               least(stddev_pop(C_A), stddev_pop(T), stddev_pop(q), stddev_pop(C_Af), stddev_pop(T_f), stddev_pop(T_c)) > 0 AS usable
        FROM wide GROUP BY run_id"""),
    "series_input_levels": on(EVENT_LOG, """
        SELECT run_id, round(coalesce(nullif(max(abs(q - 0.002)), 0), 1), 6) AS q_amplitude, round(coalesce(nullif(max(abs(C_Af - 500)), 0), 1), 6) AS C_Af_amplitude,
               round(coalesce(nullif(max(abs(T_f - 350)), 0), 1), 6) AS T_f_amplitude, round(coalesce(nullif(max(abs(T_c - 337.5)), 0), 1), 6) AS T_c_amplitude
        FROM wide GROUP BY run_id"""),
    "series_symmetric_difference": on(
        PLANTED + ", clean AS (SELECT plant_id, run_id, sensor_id, sample_index, time_s, value, 0::SMALLINT AS quality_flag FROM long)", """
        SELECT 'first' AS side, count(*) AS n_rows FROM (SELECT * FROM clean EXCEPT ALL SELECT * FROM measurements)
        UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM measurements EXCEPT ALL SELECT * FROM clean)"""),
}

# --- scalar functions ------------------------------------------------------------------

_NAMES = [u[0] for u in UNITS] + ["furlong", "bar"]


def _with_unit(spark, sf):
    names = F.array(*[F.lit(u) for u in _NAMES])
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("value"),
        F.element_at(names, (F.col("p_partkey") % len(_NAMES) + 1).cast("int")).alias("unit"),
    )


def _to_si(spark, sf):
    from tickweave.operators.integrity import to_si

    return to_si(_with_unit(spark, sf), units_dimension(spark)).select(
        "p_partkey", "unit", F.round("si_value", 9).alias("si_value"), "si_unit", "dimension", "is_si"
    )


def _unknown_units(spark, sf):
    from tickweave.operators.integrity import unknown_units

    return unknown_units(_with_unit(spark, sf), units_dimension(spark)).select("p_partkey", "unit")


_UNIT_SQL = (
    "units AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{u}', {f!r}::DOUBLE, '{si}', '{d}')" for i, (u, f, si, d) in enumerate(UNITS))
    + ", (24, 'furlong', NULL, NULL, NULL), (25, 'bar', NULL, NULL, NULL)) v(i, unit, factor, si_unit, dimension))"
)


def _names(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("com"), (F.col("o_orderkey") % 10).cast("string"), F.lit(".x")))
        .when(F.col("o_orderkey") % 5 == 0, F.concat(F.lower("o_orderpriority"), F.lit(".")))
        .when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "-"))
        .when(F.col("o_orderkey") % 11 == 0, F.repeat(F.lit("a"), 95 + (F.col("o_orderkey") % 13).cast("int")))
        .otherwise(F.col("o_orderpriority")).alias("name"),
    )


def _identities(spark, sf):
    o = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("plant"), (o % 50 - 1).alias("seed"),
        (o % 9).alias("count"), (o % 4).alias("n"), F.when(o % 3 > 0, o % 70).alias("lead"),
        F.when(o % 3 > 1, F.when(o % 2 == 0, "a10").otherwise("a5")).when(o % 3 == 1, "a7").alias("amplitude"),
        F.when(o % 6 == 0, "sideways").when(o % 2 == 0, "up").otherwise("down").alias("direction"),
    )
    p3 = S.p3_run_id("plant", "seed", "count", "n", "lead", "amplitude")
    return base.select(
        "o_orderkey", p3.alias("p3"), S.p3_run_id("plant", "seed", "count", "n").alias("p3_short"),
        S.steady_run_id("plant", "count", "n").alias("steady"),
        S.step_run_id("plant", F.lit("tc"), "direction", "count", F.lit(600), F.lit(60), "n").alias("step"),
        S.run_definition(p3, "plant").alias("definition"), S.sensor_id("plant", F.lit("T_c")).alias("sensor_id"),
    )


def _clock(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, e * F.lit(0.3)).when(e % 3 == 1, e * F.lit(0.3) + 1e-9).otherwise(F.col("value")).alias("t")
    )
    tick = S.nearest_tick("t", F.lit(0.0), F.lit(0.1))
    return rows.select("event_id", tick.alias("tick"), S.on_clock("t", S.clock_instant(tick, F.lit(0.0), F.lit(0.1))).alias("on_clock"))


def _signs(spark, sf):
    wide = eventlog.wide_log(spark, sf)
    signs = wide.select("run_id", "sample_index", *[S.sign_of(i, F.lit(NOMINAL[i])).alias(f"s_{i}") for i in INPUTS])
    return signs.select("run_id", "sample_index", S.corner_label([f"s_{i}" for i in INPUTS]).alias("corner"))


QUERIES |= {
    "scalar_unit_conversion": _to_si,
    "scalar_unknown_units": _unknown_units,
    "scalar_valid_identifiers": lambda spark, sf: _names(spark, sf).select("o_orderkey", S.valid_identifier("name").alias("valid")),
    "scalar_run_identities": _identities,
    "scalar_identity_words": lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey", *S.identity_words(F.concat(F.lit("c.p3.e"), F.col("o_orderkey").cast("string")))),
    "scalar_ulp": lambda spark, sf: table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.ulp(F.col("l_extendedprice") / F.lit(7.0)).alias("price_ulp"), S.ulp("l_discount").alias("discount_ulp"),
        S.ulp(F.pow(F.lit(2.0), F.col("l_quantity"))).alias("power_ulp")),
    "scalar_sampling_clock": _clock,
    "scalar_corner_labels": _signs,
    "scalar_within_limit": lambda spark, sf: table(spark, sf, "customer").select(
        "c_custkey", S.within_limit(F.when(F.col("c_custkey") % 17 == 0, None).when(F.col("c_custkey") % 13 == 0, F.lit(float("nan")))
                                    .otherwise(F.col("c_acctbal")), 5000.0).alias("within")),
}
SQL |= {
    "scalar_unit_conversion": f"""WITH {_UNIT_SQL} SELECT p_partkey, unit, round(p_retailprice * factor, 9) AS si_value, si_unit, dimension,
        unit = si_unit AS is_si FROM part JOIN units ON i = p_partkey % 26 WHERE factor IS NOT NULL""",
    "scalar_unknown_units": f"WITH {_UNIT_SQL} SELECT p_partkey, unit FROM part JOIN units ON i = p_partkey % 26 WHERE factor IS NULL",
    "scalar_valid_identifiers": """
        WITH named AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'com' || (o_orderkey % 10) || '.x'
            WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) || '.'
            WHEN o_orderkey % 3 = 0 THEN regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g')
            WHEN o_orderkey % 11 = 0 THEN repeat('a', (95 + o_orderkey % 13)::INT) ELSE o_orderpriority END AS name FROM orders)
        SELECT o_orderkey, regexp_full_match(name, '[a-z0-9]([a-z0-9._-]{0,98}[a-z0-9_-])?')
            AND NOT regexp_matches(name, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.|$)') AS valid FROM named""",
    "scalar_run_identities": """
        WITH b AS (SELECT o_orderkey, 'c' || o_custkey AS plant, o_orderkey % 50 - 1 AS seed, o_orderkey % 9 AS cnt, o_orderkey % 4 AS n,
                   CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 70 END AS lead,
                   CASE WHEN o_orderkey % 3 = 1 THEN 'a7' WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN 'a10' WHEN o_orderkey % 3 = 2 THEN 'a5' END AS amp,
                   CASE WHEN o_orderkey % 6 = 0 THEN 'sideways' WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS dir FROM orders),
        c AS (SELECT *, CASE WHEN seed >= 0 AND cnt > 0 THEN
                 CASE WHEN lead IS NULL AND amp IS NULL THEN format('{}.p3.e{}.x{}.n{}', plant, seed, cnt, n)
                      WHEN lead > 0 AND amp IN ('a5', 'a10') THEN format('{}.p3.e{}.x{}.l{}.{}.n{}', plant, seed, cnt, lead, amp, n) END END AS p3 FROM b)
        SELECT o_orderkey, p3, CASE WHEN seed >= 0 AND cnt > 0 THEN format('{}.p3.e{}.x{}.n{}', plant, seed, cnt, n) END AS p3_short,
               CASE WHEN cnt > 0 THEN format('{}.steady.d{}.n{}', plant, cnt, n) END AS steady,
               CASE WHEN cnt > 0 AND dir <> 'sideways' THEN format('{}.step.tc-{}.l{}.h600.r60.n{}', plant, dir, cnt, n) END AS step,
               substr(p3, length(plant) + 2) AS definition, plant || '.T_c' AS sensor_id FROM c""",
    "scalar_identity_words": "WITH h AS (SELECT o_orderkey, sha256('c.p3.e' || o_orderkey) AS d FROM orders) SELECT o_orderkey, "
        + ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT AS word_{i}" for i in range(4)) + " FROM h",
    "scalar_ulp": """
        SELECT l_orderkey, l_linenumber, nextafter(a, 'Infinity'::DOUBLE) - a AS price_ulp, nextafter(l_discount, 'Infinity'::DOUBLE) - l_discount AS discount_ulp,
               nextafter(p, 'Infinity'::DOUBLE) - p AS power_ulp
        FROM (SELECT *, l_extendedprice / 7.0::DOUBLE AS a, pow(2.0::DOUBLE, l_quantity) AS p FROM lineitem)""",
    "scalar_sampling_clock": """
        WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 0.3::DOUBLE WHEN 1 THEN event_id * 0.3::DOUBLE + 1e-9 ELSE value END AS t FROM events),
        n AS (SELECT *, round_even(t / 0.1::DOUBLE, 0)::BIGINT AS tick FROM t),
        p AS (SELECT *, tick * 0.1::DOUBLE AS near, greatest(t, tick * 0.1::DOUBLE) AS top FROM n)
        SELECT event_id, tick, abs(t - near) <= 4 * (nextafter(top, 'Infinity'::DOUBLE) - top) AS on_clock FROM p""",
    "scalar_corner_labels": on(EVENT_LOG, """
        SELECT run_id, sample_index, CASE sign(q - 0.002::DOUBLE) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END || CASE sign(C_Af - 500) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END
            || CASE sign(T_f - 350) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END || CASE sign(T_c - 337.5) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '0' END AS corner FROM wide"""),
    "scalar_within_limit": """SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 13 = 0 THEN false
        ELSE c_acctbal BETWEEN 0 AND 5000 END AS within FROM customer""",
}
