"""The contract tables as common table expressions for the checking engine."""

from __future__ import annotations

WIDE = """
numbered AS (
  SELECT event_id, user_id % 20 AS r, value,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS tick
  FROM events),
placed AS (
  SELECT *, r // 2 AS k, CASE WHEN r % 2 = 0 THEN 'source' ELSE 'target' END AS plant_id,
         tick >= 10 AND (tick - 10) % 120 < 20 AS moved,
         CASE WHEN tick >= 10 THEN (3 * (r // 2) + 5 * ((tick - 10) // 120)) % 16 END AS corner
  FROM numbered),
wide AS (
  SELECT event_id, plant_id, plant_id || '.p3.e' || k || '.x4.l60.a10.n0' AS run_id,
         tick AS sample_index, 6.0::DOUBLE * tick AS time_s, value AS C_A,
         350.0::DOUBLE + (event_id % 100) / 10.0::DOUBLE AS T,
         CASE WHEN moved AND corner & 1 = 1 THEN 0.0022::DOUBLE WHEN moved THEN 0.0018::DOUBLE ELSE 0.002::DOUBLE END AS q,
         CASE WHEN moved AND (corner >> 1) & 1 = 1 THEN 550.0::DOUBLE WHEN moved THEN 450.0::DOUBLE ELSE 500.0::DOUBLE END AS C_Af,
         CASE WHEN moved AND (corner >> 2) & 1 = 1 THEN 355.0::DOUBLE WHEN moved THEN 345.0::DOUBLE ELSE 350.0::DOUBLE END AS T_f,
         CASE WHEN moved AND (corner >> 3) & 1 = 1 THEN 342.5::DOUBLE WHEN moved THEN 332.5::DOUBLE ELSE 337.5::DOUBLE END AS T_c
  FROM placed)"""

LONG = """
long AS (
  SELECT event_id, plant_id, run_id, plant_id || '.' || variable_name AS sensor_id, variable_name,
         sample_index, time_s, value
  FROM (UNPIVOT (SELECT * FROM wide) ON C_A, T, q, C_Af, T_f, T_c INTO NAME variable_name VALUE value))"""

_PLANTS = """
plants AS (SELECT DISTINCT plant_id, plant_id AS name, 'cstr' AS process_type FROM wide),
process_parameters AS (
  SELECT plant_id, parameter, value, unit FROM (SELECT DISTINCT plant_id FROM wide),
  (VALUES ('reactor_volume', 0.1::DOUBLE, 'm^3'), ('density', 1000::DOUBLE, 'kg/m^3'),
          ('heat_capacity', 239::DOUBLE, 'J/(kg*K)'), ('reaction_enthalpy', -50000::DOUBLE, 'J/mol'),
          ('nominal_feed_flow', 0.002::DOUBLE, 'm^3/s'), ('nominal_feed_concentration', 500::DOUBLE, 'mol/m^3'),
          ('nominal_feed_temperature', 350::DOUBLE, 'K'), ('nominal_coolant_temperature', 337.5::DOUBLE, 'K')
  ) v(parameter, value, unit))"""

_SENSORS = """
{name} AS (
  SELECT plant_id || '.' || variable_name AS sensor_id, plant_id, variable_name, channel_kind, channel_index, unit,
         6.0::DOUBLE AS sampling_period_s, CASE WHEN noise_std IS NOT NULL THEN 'additive_gaussian' END AS noise_model, noise_std
  FROM (SELECT DISTINCT plant_id FROM wide),
  (VALUES ('C_A', 'measured', 0, 'mol/m^3', 5.0::DOUBLE), ('T', 'measured', 1, 'K', 0.5::DOUBLE),
          ('q', 'input', 0, 'm^3/s', NULL), ('C_Af', 'input', 1, 'mol/m^3', NULL),
          ('T_f', 'input', 2, 'K', NULL), ('T_c', 'input', 3, 'K', NULL)
  ) v(variable_name, channel_kind, channel_index, unit, noise_std))"""

_RUNS = """
{name} AS (
  SELECT run_id, plant_id, 'events' AS dataset_id, 'p3' AS operating_mode, 'events as excursions' AS description,
         0.0::DOUBLE AS start_time_s, max(time_s) AS end_time_s, 6.0::DOUBLE AS sampling_period_s,
         count(*) AS n_samples, sha256(run_id) AS content_sha256
  FROM wide GROUP BY run_id, plant_id)"""

EVENT_LOG = ",".join(
    [WIDE, LONG,
     "\nmeasurements AS (SELECT plant_id, run_id, sensor_id, sample_index, time_s, value, 0::SMALLINT AS quality_flag FROM long)",
     _PLANTS, _SENSORS.format(name="sensors"), _RUNS.format(name="operating_runs")]
)

PLANTED = ",".join(
    [WIDE, LONG, _PLANTS, _SENSORS.format(name="sensors_0"), _RUNS.format(name="runs_0"), """
sensors AS (SELECT * REPLACE (CASE WHEN sensor_id = 'source.T_c' THEN 5.0::DOUBLE ELSE sampling_period_s END AS sampling_period_s) FROM sensors_0),
operating_runs AS (
  SELECT * REPLACE (CASE WHEN contains(run_id, '.e2.') THEN end_time_s + 6 ELSE end_time_s END AS end_time_s) FROM runs_0
  UNION ALL SELECT * REPLACE ('empty.' || run_id AS run_id) FROM runs_0 WHERE regexp_matches(run_id, '\\.e[01]\\.')),
measurements AS (
  SELECT CASE WHEN event_id % 59 = 0 AND variable_name = 'T_c' THEN 'target' ELSE plant_id END AS plant_id,
         CASE WHEN event_id % 991 = 0 AND variable_name = 'C_A' THEN 'source.p3.orphan.n0' ELSE run_id END AS run_id,
         CASE WHEN event_id % 61 = 0 AND variable_name = 'T' THEN plant_id || '.X'
              WHEN event_id % 499 = 0 AND variable_name = 'T' THEN ' ' ELSE sensor_id END AS sensor_id,
         sample_index,
         CASE WHEN event_id % 83 = 0 THEN time_s + 0.25 WHEN event_id % 103 = 0 THEN time_s - 12
              WHEN event_id % 787 = 0 AND variable_name = 'T_c' THEN 'Infinity'::DOUBLE ELSE time_s END AS time_s,
         CASE WHEN event_id % 79 = 0 AND variable_name = 'C_A' THEN 'NaN'::DOUBLE
              WHEN event_id % 73 = 0 AND variable_name = 'T' THEN NULL ELSE value END AS value,
         (CASE WHEN event_id % 71 = 0 THEN 3 WHEN event_id % 701 = 0 AND variable_name = 'T' THEN NULL ELSE 0 END)::SMALLINT AS quality_flag
  FROM long, (VALUES (1), (2)) copies(copy)
  WHERE (copy = 1 OR event_id % 101 = 0) AND event_id % 97 <> 0
    AND NOT (event_id % 89 = 0 AND variable_name = 'T_f'))"""]
)

REGISTRY = """
twice AS (SELECT * FROM (VALUES (1), (2)) v(copy)),
plants AS (
  SELECT 'c' || c_custkey AS plant_id, CASE WHEN c_custkey % 41 = 0 THEN '  ' ELSE c_name END AS name,
         CASE WHEN c_custkey % 43 <> 0 THEN c_mktsegment END AS process_type
  FROM customer, twice WHERE copy = 1 OR c_custkey % 37 = 0),
process_parameters AS (
  SELECT CASE WHEN p_partkey % 193 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN 'x' || p_partkey
              ELSE 'c' || (p_partkey % 101 + 1) END AS plant_id,
         CASE WHEN p_partkey % 67 = 0 THEN ' ' ELSE p_brand END AS parameter,
         CASE WHEN p_partkey % 31 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 29 = 0 THEN 'Infinity'::DOUBLE
              WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice END AS value,
         CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS unit
  FROM part),
keyed AS (
  SELECT *, c_custkey * 6 + position AS key, 'c' || c_custkey AS plant FROM customer,
  (VALUES (0, 'C_A', 'measured', 0, 'mol/m^3', 5.0::DOUBLE), (1, 'T', 'measured', 1, 'K', 0.5::DOUBLE),
          (2, 'q', 'input', 0, 'm^3/s', NULL), (3, 'C_Af', 'input', 1, 'mol/m^3', NULL),
          (4, 'T_f', 'input', 2, 'K', NULL), (5, 'T_c', 'input', 3, 'K', NULL)
  ) v(position, v, kind, i, u, std)),
sensors AS (
  SELECT plant || '.' || v AS sensor_id, CASE WHEN key % 97 = 0 THEN 'x' || plant ELSE plant END AS plant_id,
         CASE WHEN key % 89 = 0 THEN 'T' ELSE v END AS variable_name,
         CASE WHEN key % 47 = 0 THEN 'other' WHEN key % 53 = 0 THEN NULL ELSE kind END AS channel_kind,
         CASE WHEN key % 83 = 0 THEN 0 WHEN key % 107 = 0 THEN NULL ELSE i END AS channel_index,
         CASE WHEN key % 79 = 0 THEN 'K*' ELSE u END AS unit,
         CASE WHEN key % 67 = 0 THEN 0.0::DOUBLE WHEN key % 71 = 0 THEN 'NaN'::DOUBLE WHEN key % 113 = 0 THEN NULL
              ELSE 6.0::DOUBLE END AS sampling_period_s,
         CASE WHEN kind = 'measured' AND key % 59 = 0 THEN NULL WHEN kind = 'measured' OR key % 61 = 0
              THEN 'additive_gaussian' END AS noise_model,
         CASE WHEN kind = 'measured' AND key % 101 = 0 THEN 'Infinity'::DOUBLE
              WHEN kind = 'measured' AND key % 103 = 0 THEN -1.0::DOUBLE ELSE std END AS noise_std
  FROM keyed, twice WHERE copy = 1 OR key % 73 = 0),
operating_runs AS (
  SELECT 'c' || o_custkey || '.p3.e' || o_orderkey || '.x4.n0' AS run_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'xc' || o_custkey ELSE 'c' || o_custkey END AS plant_id,
         o_orderpriority AS dataset_id, CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE o_orderstatus END AS operating_mode,
         CASE WHEN o_orderkey % 79 <> 0 THEN 'an order' END AS description,
         CASE WHEN o_orderkey % 73 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 71 = 0 THEN 1.0e9::DOUBLE ELSE 0.0::DOUBLE END AS start_time_s,
         6.0::DOUBLE * (o_orderkey % 500) AS end_time_s,
         CASE WHEN o_orderkey % 67 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 109 = 0 THEN NULL ELSE 6.0::DOUBLE END AS sampling_period_s,
         CASE WHEN o_orderkey % 61 = 0 THEN 0 ELSE 1 + o_orderkey % 500 END AS n_samples,
         CASE WHEN o_orderkey % 59 = 0 THEN sha256('c' || o_custkey || '.p3.e' || o_orderkey || '.x4.n0') || chr(10)
              WHEN o_orderkey % 53 = 0 THEN NULL
              ELSE sha256('c' || o_custkey || '.p3.e' || o_orderkey || '.x4.n0') END AS content_sha256
  FROM orders, twice WHERE copy = 1 OR o_orderkey % 101 = 0)"""


def on(prelude: str, body: str) -> str:
    return f"WITH {prelude.strip()}\n{body.strip()}"
