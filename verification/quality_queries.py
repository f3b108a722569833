"""Quality checks: measurement-level branches on the planted sensor log, dimension-level
branches on the registry."""

from tickweave.operators import quality
from tickweave.sources import eventlog
from verification.tables_sql import PLANTED, REGISTRY, on

_DIMENSION = {
    "duplicate_runs": "SELECT run_id, count(*) AS occurrences FROM operating_runs GROUP BY ALL HAVING count(*) > 1",
    "duplicate_channels": "SELECT sensor_id, count(*) AS occurrences FROM sensors GROUP BY ALL HAVING count(*) > 1",
    "duplicate_variables": "SELECT plant_id, variable_name, count(*) AS occurrences FROM sensors GROUP BY ALL HAVING count(*) > 1",
    "duplicate_positions": "SELECT plant_id, channel_kind, channel_index, count(*) AS occurrences FROM sensors GROUP BY ALL HAVING count(*) > 1",
    "duplicate_plants": "SELECT plant_id, count(*) AS occurrences FROM plants GROUP BY ALL HAVING count(*) > 1",
    "duplicate_parameters": "SELECT plant_id, parameter, count(*) AS occurrences FROM process_parameters GROUP BY ALL HAVING count(*) > 1",
    "runs_without_plant": "SELECT r.run_id, r.plant_id, count(*) AS n_rows FROM operating_runs r ANTI JOIN plants p USING (plant_id) GROUP BY ALL",
    "channels_without_plant": "SELECT s.sensor_id, s.plant_id, count(*) AS n_rows FROM sensors s ANTI JOIN plants p USING (plant_id) GROUP BY ALL",
    "parameters_without_plant": "SELECT q.parameter, q.plant_id, count(*) AS n_rows FROM process_parameters q ANTI JOIN plants p USING (plant_id) GROUP BY ALL",
    "infinite_parameters": "SELECT plant_id, parameter, count(*) AS n_rows FROM process_parameters WHERE isnan(value) OR isinf(value) GROUP BY ALL",
    "infinite_periods": "SELECT sensor_id, count(*) AS n_rows FROM sensors WHERE isnan(sampling_period_s) OR isinf(sampling_period_s) GROUP BY ALL",
    "infinite_noise": "SELECT sensor_id, count(*) AS n_rows FROM sensors WHERE isnan(noise_std) OR isinf(noise_std) GROUP BY ALL",
    "infinite_run_times": """SELECT run_id, count(*) AS n_rows FROM operating_runs
        WHERE NOT (isfinite(start_time_s) AND isfinite(end_time_s) AND isfinite(coalesce(sampling_period_s, 1))) GROUP BY ALL""",
    "channel_kinds": "SELECT sensor_id, channel_kind FROM sensors WHERE coalesce(channel_kind, '') NOT IN ('input', 'measured')",
    "measured_without_noise": """SELECT sensor_id, noise_model, noise_std FROM sensors WHERE channel_kind = 'measured'
        AND NOT (coalesce(noise_model, '') = 'additive_gaussian' AND coalesce(noise_std, -1) >= 0)""",
    "inputs_with_noise": "SELECT sensor_id, noise_model, noise_std FROM sensors WHERE channel_kind = 'input' AND coalesce(noise_model, noise_std::VARCHAR) IS NOT NULL",
    "channel_periods": "SELECT sensor_id, sampling_period_s FROM sensors WHERE sampling_period_s <= 0",
    "mixed_units": """SELECT variable_name, string_agg(unit, ' against ' ORDER BY unit) AS units
        FROM (SELECT DISTINCT variable_name, unit FROM sensors) GROUP BY variable_name HAVING count(*) > 1""",
    "run_extents": """SELECT run_id, start_time_s, end_time_s, n_samples FROM operating_runs
        WHERE end_time_s < start_time_s OR n_samples < 1 OR sampling_period_s <= 0""",
    "content_hashes": """SELECT run_id, content_sha256 FROM operating_runs
        WHERE NOT coalesce(regexp_full_match(content_sha256, '[0-9a-f]{64}'), false)""",
}

_MEASURED = {
    "duplicate_measurements": "SELECT run_id, sensor_id, sample_index, count(*) AS occurrences FROM measurements GROUP BY ALL HAVING count(*) > 1",
    "unknown_runs": "SELECT m.run_id, count(*) AS n_rows FROM measurements m ANTI JOIN operating_runs r USING (run_id) GROUP BY ALL",
    "unknown_channels": "SELECT m.sensor_id, count(*) AS n_rows FROM measurements m ANTI JOIN sensors s USING (sensor_id) GROUP BY ALL",
    "foreign_run_rows": """SELECT m.run_id, m.plant_id, r.plant_id AS owner, count(*) AS n_rows FROM measurements m, operating_runs r
        WHERE m.run_id = r.run_id AND m.plant_id <> r.plant_id GROUP BY ALL""",
    "foreign_channel_rows": """SELECT m.run_id, m.sensor_id, m.plant_id, s.plant_id AS owner, count(*) AS n_rows FROM measurements m, sensors s
        WHERE m.sensor_id = s.sensor_id AND m.plant_id <> s.plant_id GROUP BY ALL""",
    "infinite_values": "SELECT run_id, sensor_id, count(*) AS n_rows FROM measurements WHERE isnan(value) OR isinf(value) GROUP BY ALL",
    "infinite_times": "SELECT run_id, sensor_id, count(*) AS n_rows FROM measurements WHERE isnan(time_s) OR isinf(time_s) GROUP BY ALL",
    "run_channel_periods": """SELECT DISTINCT m.run_id, m.sensor_id, r.sampling_period_s AS run_period_s, s.sampling_period_s AS channel_period_s
        FROM measurements m JOIN operating_runs r USING (run_id) JOIN sensors s USING (sensor_id)
        WHERE r.sampling_period_s <> s.sampling_period_s""",
    "quality_flags": "SELECT run_id, sensor_id, quality_flag, count(*) AS n_rows FROM measurements WHERE coalesce(quality_flag, -1) <> 0 GROUP BY ALL",
    "row_counts": """SELECT run_id, sensor_id, c.n AS n_rows, n_samples
        FROM (SELECT run_id, sensor_id, count(*) AS n FROM measurements GROUP BY ALL) c JOIN operating_runs USING (run_id) WHERE c.n <> n_samples""",
    "tick_ranges": """SELECT run_id, sensor_id, first_tick, last_tick
        FROM (SELECT run_id, sensor_id, min(sample_index) AS first_tick, max(sample_index) AS last_tick FROM measurements GROUP BY ALL)
        JOIN operating_runs USING (run_id) WHERE first_tick > 0 OR last_tick + 1 <> n_samples""",
    "gaps": """SELECT run_id, sensor_id, before AS previous_tick, sample_index - before - 1 AS missing FROM (
        SELECT *, lag(sample_index) OVER (PARTITION BY run_id, sensor_id ORDER BY sample_index, time_s, value NULLS FIRST) AS before FROM measurements)
        WHERE sample_index > before + 1""",
    "time_not_increasing": """SELECT run_id, sensor_id, sample_index, time_s, before AS previous_time_s FROM (
        SELECT *, lag(time_s) OVER (PARTITION BY run_id, sensor_id ORDER BY sample_index, time_s, value NULLS FIRST) AS before FROM measurements)
        WHERE time_s <= before""",
    "off_clock": """SELECT run_id, sensor_id, sample_index, time_s, expected_time_s FROM (
        SELECT *, greatest(abs(time_s), abs(expected_time_s)) AS top FROM (
          SELECT m.*, r.start_time_s + m.sample_index * r.sampling_period_s AS expected_time_s
          FROM measurements m JOIN operating_runs r USING (run_id)))
        WHERE NOT isinf(top) AND abs(time_s - expected_time_s) > 4 * (nextafter(top, 'Infinity'::DOUBLE) - top)""",
    "last_instants": """SELECT run_id, end_time_s, last_time_s FROM (SELECT run_id, max(time_s) AS last_time_s FROM measurements GROUP BY ALL)
        JOIN operating_runs USING (run_id) WHERE last_time_s <> end_time_s""",
    "empty_runs": "SELECT r.run_id, r.n_samples FROM operating_runs r ANTI JOIN measurements m USING (run_id)",
    "missing_channels": """SELECT t.run_id, t.sample_index, s.sensor_id
        FROM (SELECT DISTINCT plant_id, run_id, sample_index FROM measurements) t JOIN sensors s USING (plant_id)
        ANTI JOIN measurements m ON m.run_id = t.run_id AND m.sample_index = t.sample_index AND m.sensor_id = s.sensor_id""",
}


def _absent_sql(table: str) -> str:
    blanks = [f"count(*) FILTER (coalesce(trim({c}), '') = '') AS {c}" for c in quality.TEXT_FIELDS[table]]
    nulls = [f"count(*) - count({c}) AS {c}" for c in quality.OTHER_FIELDS[table]]
    return (
        f"SELECT '{table}' AS table_name, field, n_rows FROM (UNPIVOT (SELECT {', '.join(blanks + nulls)} FROM {table}) "
        "ON COLUMNS(*) INTO NAME field VALUE n_rows) WHERE n_rows > 0"
    )


for _table in quality.TEXT_FIELDS:
    (_MEASURED if _table == "measurements" else _DIMENSION)[f"absent_{_table}"] = _absent_sql(_table)


def _query(name: str, source):
    return lambda spark, sf: quality.findings(source(spark, sf), name)


QUERIES, SQL = {}, {}
for _name in quality.BY_NAME:
    _source, _prelude, _body = (
        (eventlog.planted, PLANTED, _MEASURED[_name]) if _name in _MEASURED else (eventlog.registry, REGISTRY, _DIMENSION[_name])
    )
    QUERIES[f"quality_{_name}"] = _query(_name, _source)
    SQL[f"quality_{_name}"] = on(_prelude, _body)


def _counts_sql(names, bodies) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{quality.BY_NAME[n].family}' AS \"check\", '{quality.BY_NAME[n].problem}' AS problem, "
        f"count(*) AS n_findings FROM ({bodies[n]})"
        for n in names
    )


_LONG_CHECKS = [c for c in quality.CHECKS if c.name in _MEASURED]
_DIM_CHECKS = [c for c in quality.CHECKS if c.name in _DIMENSION]
QUERIES["quality_report_measurements"] = lambda spark, sf: quality.report_counts(eventlog.planted(spark, sf), _LONG_CHECKS)
SQL["quality_report_measurements"] = on(PLANTED, _counts_sql([c.name for c in _LONG_CHECKS], _MEASURED))
QUERIES["quality_report_dimensions"] = lambda spark, sf: quality.report_counts(eventlog.registry(spark, sf), _DIM_CHECKS)
SQL["quality_report_dimensions"] = on(REGISTRY, _counts_sql([c.name for c in _DIM_CHECKS], _DIMENSION))
QUERIES["quality_clean_log_failed_checks"] = lambda spark, sf: quality.failed_checks(eventlog.event_log(spark, sf))
SQL["quality_clean_log_failed_checks"] = "SELECT ''::VARCHAR AS \"check\", ''::VARCHAR AS problem, 0::BIGINT AS n_findings WHERE false"
