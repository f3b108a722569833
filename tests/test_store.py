import datetime
import json
import math
import random
import struct
import uuid

import pytest
from plants import NORTH, SOUTH, altered, doubled, log, without
from pyspark.sql import functions as F

from tickweave.contract import SCHEMAS, Tables, units_dimension
from tickweave.functions import encoding
from tickweave.operators import digests, ingest, integrity, leakscan, report
from tickweave.plans import dealing
from tickweave.session import shared_folder
from tickweave.sources import eventlog, store

HOT = "sensor_id = 'south.T' AND sample_index = 7"
SHORT = "south.p3.e8.x2.n0"


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def offered(spark, change=lambda tables: tables, lengths=None):
    return digests.recorded_runs(ingest.staged(change(log(spark, lengths))))


def status(frame):
    return {r["run_id"]: (r["status"], r["refused_by"]) for r in frame.collect()}


def digest(tables):
    return {r["run_id"]: r["content_sha256"] for r in digests.run_digests(tables).collect()}


@pytest.mark.parametrize("change", [
    altered("measurements", HOT, value="value + 1e-12"), altered("measurements", HOT, time_s="time_s + 1e-9"), altered("sensors", "sensor_id = 'south.C_A'", noise_std="noise_std * 2"),
    doubled("measurements", HOT), without("measurements", HOT),
])
def test_a_digest_sees_what_changed_and_in_which_run(spark, change):
    tables = log(spark)
    before, after = digest(tables), digest(change(tables))
    assert after[NORTH] == before[NORTH] and after[SOUTH] != before[SOUTH]


def test_a_digest_is_blind_to_order_but_not_to_the_sign_of_zero(spark):
    tables = log(spark)
    turned = tables.with_(measurements=tables.measurements.orderBy("value", "sensor_id").repartition(3))
    assert digest(turned) == digest(tables)
    zeros = [digest(altered("measurements", HOT, value=text)(tables))[SOUTH] for text in ("0.0D", "-0.0D * 1")]
    assert zeros[0] != digest(tables)[SOUTH]


def test_a_store_takes_runs_once_and_keeps_what_it_has(spark):
    root = folder(spark)
    first, rows = ingest.ingest(offered(spark), store.read_store(spark, root))
    assert status(first) == {NORTH: ("ingested", None), SOUTH: ("ingested", None)}
    store.append(rows, root, "first")
    held = store.read_store(spark, root)
    assert {n: df.count() for n, df in held.items()} == {"plants": 2, "process_parameters": 16, "sensors": 12, "operating_runs": 2, "measurements": 6 * (6 + 9)}
    again, nothing = ingest.ingest(offered(spark), held)
    assert set(status(again).values()) == {("already_present", None)} and nothing.operating_runs.isEmpty()
    refusals = {
        "run_conflict": altered("measurements", HOT, value="value + 0.5"), "plant_conflict": altered("sensors", "sensor_id = 'south.T'", noise_std="noise_std + 1"),
        "dataset_conflict": altered("operating_runs", "plant_id = 'south'", dataset_id="'revised'"),
    }
    for word, change in refusals.items():
        assert status(ingest.gate(offered(spark, change), held)) == {NORTH: ("already_present", None), SOUTH: ("refused", word)}


def test_what_the_offer_itself_gets_wrong(spark):
    empty = Tables(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
    holed = offered(spark, without("measurements", f"run_id = '{SHORT}' AND sample_index = 2"), {NORTH: 6, SOUTH: 9, SHORT: 4})
    found = ingest.gate(holed, empty)
    assert status(found) == {NORTH: ("ingested", None), SOUTH: ("ingested", None), SHORT: ("refused", "quality")}
    ahead = ingest.stop_at_first_refusal(found.replace(NORTH, "west.p3.e4.x2.n0"))
    assert {r["run_id"]: r["status"] for r in ahead.collect()} == {SOUTH: "ingested", SHORT: "refused", "west.p3.e4.x2.n0": "not_reached"}
    assert status(ingest.gate(offered(spark, altered("sensors", "sensor_id = 'south.C_A'", unit="'g/L'")), empty))[SOUTH] == ("refused", "unit_conflict")
    recorded = offered(spark)
    assert status(ingest.gate(altered("measurements", HOT, value="value - 1")(recorded), empty)) == {NORTH: ("ingested", None), SOUTH: ("refused", "content_changed")}


def test_a_claimed_channel_and_an_unlisted_run_are_refused(spark):
    stored = Tables(**{n: df.where("plant_id = 'north'") for n, df in log(spark).items()})
    claim = lambda t: Tables(**{n: df.where("plant_id = 'south'") for n, df in altered("measurements", "sensor_id = 'south.q'", sensor_id="'north.q'")(altered("sensors", "sensor_id = 'south.q'", sensor_id="'north.q'")(t)).items()})
    offer = without("operating_runs", f"run_id = '{SHORT}'")(offered(spark, claim, {NORTH: 6, SOUTH: 9, SHORT: 4}))
    assert status(ingest.gate(offer, stored)) == {SOUTH: ("refused", "plant_conflict"), SHORT: ("refused", "run_not_listed")}
    assert [tuple(r) for r in ingest.unlisted_runs(offer).collect()] == [(SHORT, 24)]


def test_a_published_set_stays_as_it_was(spark):
    root, tables = folder(spark), ingest.staged(log(spark))
    assert [store.publish(tables, root, "formulas")[0] for _ in range(2)] == ["created", "already_present"]
    state, differences = store.publish(ingest.staged(altered("measurements", HOT, value="0.5")(log(spark))), root, "formulas")
    assert state == "conflict" and (SOUTH, "hash differs") in {tuple(r) for r in differences.collect()}
    back = store.read_published(spark, root, "formulas")
    assert ingest.symmetric_difference(back.measurements, tables.measurements).isEmpty()
    listed = store.manifest_files(spark, root, "formulas")
    there = store.list_files(spark, f"{root}/formulas").where("path NOT LIKE '%/manifest/%'")
    assert store.file_agreement(listed, there).isEmpty()
    assert [r["problem"] for r in store.file_agreement(listed.limit(3), there).select("problem").distinct().collect()] == ["unexpected"]
    runs, _ = store.read_manifest(spark, root, "formulas")
    assert digests.changed_runs(runs, digests.run_digests(back)).isEmpty()
    with pytest.raises(ValueError, match="schema"):
        store.read_contract_table(spark, "operating_runs", [r["path"] for r in listed.where("table_name = 'plants'").collect()])


def test_an_export_leaves_incomplete_runs_out(spark):
    tables, path = without("measurements", f"run_id = '{SHORT}' AND sensor_id = 'south.T_f' AND sample_index = 2")(log(spark, {NORTH: 6, SOUTH: 9, SHORT: 4})), folder(spark)
    store.write_export(tables, path)
    exported = spark.read.parquet(path)
    assert exported.columns == list(store.EXPORT_COLUMNS) and {r["run_id"] for r in exported.select("run_id").distinct().collect()} == {NORTH, SOUTH}
    listed = tables.operating_runs.where(f"run_id <> '{SHORT}'").selectExpr("run_id", "n_samples as rows", "start_time_s", "end_time_s")
    assert integrity.exported_runs(exported, listed).isEmpty()
    assert {r["problem"] for r in integrity.exported_runs(exported.where("sample_index > 0"), listed).collect()} == {"number of rows", "ticks do not run from 0", "end points"}


def test_units(spark):
    df = spark.createDataFrame([(2.0, "L/min"), (2.0, "kJ/mol"), (2.0, "K"), (2.0, "furlong")], "value double, unit string")
    units = units_dimension(spark)
    assert {(r["unit"], r["si_value"], r["si_unit"], r["is_si"]) for r in integrity.to_si(df, units).collect()} == {
        ("L/min", 2.0 * (1e-3 / 60.0), "m^3/s", False), ("kJ/mol", 2000.0, "J/mol", False), ("K", 2.0, "K", True)}
    assert [r["unit"] for r in integrity.unknown_units(df, units).collect()] == ["furlong"]


def test_parameters_that_are_not_as_known(spark):
    tables = altered("process_parameters", "plant_id = 'north' AND parameter = 'density'", parameter="'viscosity'")(log(spark))
    tables = altered("process_parameters", "plant_id = 'south' AND parameter = 'reactor_volume'", unit="'L'")(tables)
    assert {tuple(r) for r in integrity.known_parameters(tables.process_parameters, tables.plants).collect()} == {
        ("south", "reactor_volume", "not in its SI unit"), ("north", "density", "missing"), ("north", "viscosity", "unknown")}


def test_what_stands_against_publishing(spark):
    tables = log(spark)
    assert integrity.pre_publish(tables).isEmpty()
    again = tables.sensors.where("sensor_id = 'north.T'").withColumn("noise_std", F.lit(9.0))
    broken = without("operating_runs", "n_samples > 7")(altered("sensors", "sensor_id = 'south.q'", unit="'l/s'")(tables))
    broken = broken.with_(sensors=broken.sensors.unionByName(again))
    found = integrity.pre_publish(broken)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 4  # rows of channels, plants, runs and findings are dealt
    assert {tuple(r) for r in found.collect()} == {("description varies", "north", "T", 2), ("more than one unit", None, "q", 2), ("plant without run", "south", None, 0)}


def test_secrets_are_found_in_tables_and_documents(spark):
    secrets, integers, states = {"the slope": 0.0037}, {"the draw": 8191}, spark.createDataFrame([(123.456789012345,)], "value double")
    rows = log(spark).measurements
    assert leakscan.table_findings(rows, secrets, integers, states).isEmpty()
    for text, finding in (("123.456789012345D", "equals a hidden state"), ("0.0037D", "holds the slope")):
        hidden = rows.selectExpr("plant_id", "run_id", "sensor_id", "sample_index", "time_s", f"IF({HOT}, {text}, value) AS value", "quality_flag")
        assert {r["finding"] for r in leakscan.table_findings(hidden, secrets, integers, states).collect()} == {finding}
    made = {"log": [{"draws": 8191, "gain": 0.0037}, {"Seed": 1}], "remark": "from ua_REF", "deep": None}
    documents = [("sound", json.dumps(made)), ("cut", '{"remark": "UA_ref'), ("huge", "9" * 5000), ("deep", "[" * 200_000)]
    leaves = leakscan.walk_documents(spark.createDataFrame(documents, "document string, json string"))
    found = {(r["document"], r["trail"], r["finding"]) for r in leakscan.document_findings(leaves, secrets, integers, states).collect()}
    assert found == {("sound", "/log[0]/draws", "holds the draw"), ("sound", "/log[0]/gain", "holds the slope"), ("sound", "/log[1]", "name Seed contains seed"),
                     ("sound", "/remark", "text mentions UA_ref"), ("cut", "", "text mentions UA_ref")}
    assert {"cut", "deep"} <= {r["document"] for r in leaves.where("kind = 'invalid'").collect()}


def test_parquet_metadata_and_fingerprints(spark):
    import hashlib
    import pyarrow as pa
    import pyarrow.parquet as pq
    root = folder(spark).replace("file:", "", 1)
    import os
    os.makedirs(root)
    schema = pa.schema([pa.field("x", pa.int64(), metadata={"unit": "K"})], metadata={"sensor_seed": "3"})
    pq.write_table(pa.table({"x": [1]}, schema=schema), f"{root}/a.parquet")
    meta = leakscan.parquet_metadata(spark, [f"{root}/a.parquet"])
    assert {("sensor_seed", "seed")} <= {(r["name"], r["word"]) for r in leakscan.forbidden_names(meta).collect()}
    (row,) = store.fingerprints(store.list_files(spark, root)).collect()
    assert row["sha256"] == hashlib.sha256(open(f"{root}/a.parquet", "rb").read()).hexdigest()


def test_a_verdict_needs_every_check(spark):
    empty, one = spark.range(0), spark.range(1)
    assert report.verdict(report.checks({"a": empty, "b": empty}), 2).collect()[0]["ok"]
    assert not report.verdict(report.checks({"a": empty, "b": one}), 2).collect()[0]["ok"]
    assert not report.verdict(report.checks({"a": empty}), 2).collect()[0]["ok"]


def test_text_of_doubles_is_their_mantissa_and_exponent(spark):
    rng = random.Random(8)
    values = [1.0, -1.5, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 0.1, 2.0**52, 2.0**53, 2.0**53 - 1, 1 - 2.0**-53, 1 + 2.0**-52, 3e-310]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(2000)] + [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1022, 1024, 7)]
    values = [v for v in values if v and math.isfinite(v)]

    def texts(rows):
        frame = spark.createDataFrame([(v,) for v in rows], "x double")
        x, guess = F.col("x"), F.col("_guess_x")
        staged = frame.withColumn("_guess_x", encoding._guess(x)).withColumn("_scaled_x", encoding._scaled(x, guess))
        return staged.select("x", encoding.encoded(frame.schema["x"]).alias("t")).collect()

    for r in texts(values):
        m, e = math.frexp(r.x)
        assert r.t == f"F{int(m * 2**53)}p{e - 53}"
    assert [r.t for r in texts([0.0, -0.0, math.inf, -math.inf, math.nan, None])] == ["F0.0", "F-0.0", "Finf", "F-inf", "Fnan", "N"]


def test_a_batch_whose_stored_rows_are_not_those_written_is_not_listed(spark, monkeypatch):
    tables, root = log(spark), folder(spark)
    assert store.write_counted(tables.sensors, f"{root}/counted") == tables.sensors.count() and not store.write_counted(tables.sensors.limit(0), f"{root}/none")
    real = store.Observation

    class OneMore(real):
        @property
        def get(self):
            return {"n_rows": super().get["n_rows"] + 1}

    monkeypatch.setattr(store, "Observation", OneMore)
    with pytest.raises(ValueError, match="were written and"):
        store.append(tables, root, "first")
    assert not store.exists(spark, f"{root}/batches/first")


def test_runs_with_other_rows_than_staged_are_told(spark):
    tables = log(spark)
    lost = tables.with_(measurements=tables.measurements.where("NOT (sample_index = 2 AND plant_id = 'south')"))
    assert {r.staged - r.stored for r in ingest.stored_counts(tables, lost).collect()} == {6} and not ingest.stored_counts(tables, tables).count()


def test_nothing_in_the_gate_is_checkpointed_and_columns_are_pruned(spark):
    offered = ingest.staged(log(spark))
    plan = offered.measurements.groupBy("run_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ReadSchema: struct<run_id:string>" in plan and "ExistingRDD" not in plan


def test_the_first_findings_of_a_check_are_limited_before_the_exchange(spark):
    one = [("duplicates", f"item {i:05d}", "p") for i in range(3000)] + [("gaps", "only", "p")]
    found = ingest.first_per_check(spark.createDataFrame([(b, p, i, None) for b, i, p in one], "branch string, problem string, item string, detail string"), 3)
    assert sorted(r.item for r in found.collect()) == ["item 00000", "item 00001", "item 00002", "only"]
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    limits = [i for i, line in enumerate(plan) if "WindowGroupLimit" in line]
    assert limits[0] < next(i for i, line in enumerate(plan) if "Exchange" in line) < limits[-1]


def test_an_offer_is_copied_and_examined_once_for_several_gates(spark, monkeypatch):
    seen = []
    found = ingest.quality_findings_by_run
    monkeypatch.setattr(ingest, "quality_findings_by_run", lambda *a: seen.append(a) or found(*a))
    root, copy = folder(spark), ingest.staged(log(spark))
    offer = ingest.examined(digests.recorded_runs(copy))
    assert offer.tables.measurements is copy.measurements and offer.tables.operating_runs is not copy.operating_runs
    first, rows = ingest.ingest(offer, store.read_store(spark, root))
    store.append(rows, root, "one")
    again, _ = ingest.ingest(offer, store.read_store(spark, root))
    assert status(first) == {NORTH: ("ingested", None), SOUTH: ("ingested", None)}
    assert status(again) == {NORTH: ("already_present", None), SOUTH: ("already_present", None)} and len(seen) == 1


def test_the_digits_of_row_hashes_are_read_three_words_at_once(spark):
    draw = random.Random(4)
    texts = ["0" * 15, "f" * 15, "a9" * 7 + "a", "0123456789abcde"] + ["".join(draw.choice("0123456789abcdef") for _ in range(15)) for _ in range(200)]
    three = digests._three_words(digests._decimal_digits(F.col("x")))
    rows = spark.createDataFrame([(t, int(t, 16)) for t in texts], "t string, x long").select("t", three.alias("x")).collect()
    for t, x in rows:
        digits = t.translate(str.maketrans("abcdef", "012345"))
        assert [x >> 40, x >> 20 & 0xFFFFF, x & 0xFFFFF] == [int(digits[i:i + 5]) for i in (0, 5, 10)]


def test_nothing_is_ordered_to_describe_the_runs_of_the_event_log(spark, tmp_path):
    events = [(k, datetime.datetime(2024, 1, 1, 0, k % 60), k % 3, 1.0) for k in range(50)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    tables = eventlog.event_log(spark, str(tmp_path))
    assert "Window" not in tables.operating_runs._jdf.queryExecution().optimizedPlan().toString()
    last = tables.measurements.groupBy("run_id").agg(F.max("time_s"), F.countDistinct("sample_index"))
    assert {tuple(r) for r in last.collect()} == {(r["run_id"], r["end_time_s"], r["n_samples"]) for r in tables.operating_runs.collect()}


def test_published_rows_are_sorted_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS", 9)
    root, tables = folder(spark), log(spark)  # 6 channels of 6 and of 9 ticks
    assert store.publish(tables, root, "set")[0] == "created"
    held = store.read_published(spark, root, "set").measurements
    sizes = held.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 90 and len(sizes) >= 9 and max(r["count"] for r in sizes) <= 18
    store.write_export(tables, f"{root}/export")
    assert spark.read.parquet(f"{root}/export").groupBy(F.input_file_name()).count().count() == 4
