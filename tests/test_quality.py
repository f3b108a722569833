"""Each check against a log with one thing wrong, and against logs that only look wrong."""

import pytest
from plants import NORTH, SOUTH, altered, doubled, log, without

from tickweave.operators import quality, rowpass

COLD = "sensor_id = 'south.T_c'"
FIFTH = f"run_id = '{SOUTH}' AND sample_index = 5"
#: What is done to the log, by the check that has to notice it.
WRONG = {
    "duplicate_measurements": doubled("measurements", f"{FIFTH} AND {COLD}"),
    "duplicate_runs": doubled("operating_runs", "n_samples > 7"),
    "duplicate_channels": doubled("sensors", "sensor_id = 'north.C_Af'"),
    "duplicate_variables": altered("sensors", "sensor_id = 'north.q'", variable_name="'C_Af'"),
    "duplicate_positions": altered("sensors", "sensor_id = 'north.T'", channel_index="0"),
    "duplicate_plants": doubled("plants", "plant_id = 'north'"),
    "duplicate_parameters": doubled("process_parameters", "plant_id = 'south' AND parameter = 'reactor_volume'"),
    "unknown_runs": altered("measurements", "sample_index = 0 AND plant_id = 'north'", run_id="'north.p3.e77.x2.n0'"),
    "unknown_channels": altered("measurements", f"{FIFTH} AND {COLD}", sensor_id="'south.level'"),
    "foreign_channel_rows": altered("measurements", f"{FIFTH} AND {COLD}", sensor_id="'north.T_c'"),
    "foreign_run_rows": altered("measurements", "sample_index = 4 AND plant_id = 'north'", plant_id="'south'"),
    "runs_without_plant": altered("operating_runs", "n_samples < 7", plant_id="'attic'"),
    "channels_without_plant": altered("sensors", "sensor_id = 'south.q'", plant_id="'attic'"),
    "parameters_without_plant": altered("process_parameters", "plant_id = 'north' AND unit = 'kg/m^3'", plant_id="'attic'"),
    "absent_measurements": altered("measurements", "sample_index = 1", quality_flag="NULL"),
    "absent_operating_runs": altered("operating_runs", "true", dataset_id="' '"),
    "absent_sensors": altered("sensors", COLD, variable_name="NULL"),
    "absent_plants": altered("plants", "plant_id = 'south'", process_type="''"),
    "absent_process_parameters": altered("process_parameters", "plant_id = 'north'", value="NULL"),
    "infinite_values": altered("measurements", FIFTH, value="double('-Infinity')"),
    "infinite_times": altered("measurements", "sample_index = 2", time_s="double('NaN')"),
    "infinite_parameters": altered("process_parameters", "parameter = 'reactor_volume'", value="double('NaN')"),
    "infinite_periods": altered("sensors", "sensor_id = 'north.C_A'", sampling_period_s="double('Infinity')"),
    "infinite_noise": altered("sensors", "sensor_id = 'north.C_A'", noise_std="double('Infinity')"),
    "infinite_run_times": altered("operating_runs", "n_samples < 7", start_time_s="double('-Infinity')"),
    "channel_kinds": altered("sensors", "sensor_id = 'south.C_Af'", channel_kind="'output'"),
    "measured_without_noise": altered("sensors", "sensor_id = 'south.C_A'", noise_model="NULL"),
    "inputs_with_noise": altered("sensors", "sensor_id = 'north.q'", noise_std="0.25"),
    "channel_periods": altered("sensors", "sensor_id = 'north.T_f'", sampling_period_s="-6.0"),
    "mixed_units": altered("sensors", "sensor_id = 'south.T_f'", unit="'degF'"),
    "run_channel_periods": altered("sensors", "sensor_id = 'south.T_f'", sampling_period_s="12.0"),
    "run_extents": altered("operating_runs", "n_samples > 7", end_time_s="start_time_s - 6.0"),
    "content_hashes": altered("operating_runs", "n_samples > 7", content_sha256="repeat('AB', 32)"),
    "quality_flags": altered("measurements", "sample_index = 3 AND plant_id = 'south'", quality_flag="1"),
    "row_counts": altered("operating_runs", "n_samples > 7", n_samples="n_samples + 2"),
    "tick_ranges": without("measurements", f"run_id = '{SOUTH}' AND sample_index = 8"),
    "gaps": without("measurements", f"run_id = '{SOUTH}' AND sample_index BETWEEN 3 AND 4"),
    "off_clock": altered("measurements", "sample_index = 4", time_s="time_s + 0.5"),
    "time_not_increasing": altered("measurements", "sample_index = 4", time_s="time_s - 6.0"),
    "last_instants": altered("operating_runs", "n_samples > 7", end_time_s="end_time_s - 6.0"),
    "empty_runs": without("measurements", f"run_id = '{NORTH}'"),
    "missing_channels": without("measurements", f"{FIFTH} AND sensor_id IN ('south.q', 'south.T')"),
}


def test_every_check_is_tried():
    assert {c.name for c in quality.CHECKS} == set(WRONG)


@pytest.mark.parametrize("name", list(WRONG))
def test_a_wrong_log_is_noticed(spark, name):
    assert quality.findings(WRONG[name](log(spark)), name, width=3).count() > 0


@pytest.mark.parametrize("harmless", [
    altered("measurements", "sensor_id = 'south.T'", value="value - 700.0"),
    altered("measurements", "sensor_id = 'north.q'", value="9.9e12"),
    altered("process_parameters", "true", value="-value"),
    altered("sensors", "noise_std IS NOT NULL", noise_std="0.0"),
    altered("operating_runs", "true", description="'a, b'"),
])
def test_a_log_that_only_looks_wrong_passes(spark, harmless):
    assert quality.failed_checks(harmless(log(spark)), width=4).collect() == []


def test_where_the_ticks_are_missing_is_told(spark):
    tables = without("measurements", "sensor_id = 'south.C_A' AND sample_index IN (2, 3, 6)")(log(spark))
    found = quality.report(tables, [quality.BY_NAME["gaps"]], width=2).orderBy("detail").collect()
    assert [(r["item"], r["detail"]) for r in found] == [(f"{SOUTH} / south.C_A", "1 missing after tick 5"), (f"{SOUTH} / south.C_A", "2 missing after tick 1")]


def test_the_long_table_is_exchanged_once_for_all_checks_of_rows(spark, tmp_path):
    tables = log(spark)
    tables.measurements.write.parquet(str(tmp_path / "m"))
    tables = tables.with_(measurements=spark.read.parquet(str(tmp_path / "m")))
    plan = rowpass.marks(tables)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("band" in line for line in dealt) == 1 and plan.count("Scan parquet") == 1
    assert all("Broadcast" in line or "band" in line or "SinglePartition" in line or not any(c in line for c in ("sample_index", "time_s")) for line in dealt)
    assert plan.count("Window ") == 3 and sum("Sort [" in line and "band" in line for line in plan.splitlines()) == 2


def test_marks_agree_whatever_the_bands_and_kinds(spark):
    tables = log(spark)
    for change in (doubled("measurements", "sample_index % 3 = 0"), without("measurements", "sample_index = 2"), without("measurements", "sensor_id = 'south.q' AND sample_index > 1"),
                   altered("measurements", "sample_index = 4", time_s="time_s - 20.0"), altered("measurements", "sample_index = 3 AND sensor_id LIKE '%.T'", plant_id="'north'"),
                   doubled("operating_runs", "true"), altered("sensors", "sensor_id = 'north.q'", sensor_id="'south.q'")):
        tables = change(tables)
    both = [{n: sorted(map(str, quality.findings(tables, n, width=w).collect())) for n in rowpass.KINDS} for w in (2, 1000)]
    assert both[0] == both[1]
    assert all(both[0][n] for n in rowpass.KINDS)
