"""Digests, integrity, the ingestion gate, published data sets, leak scan, report."""

import os
import uuid

from pyspark.sql import functions as F

from tickweave.contract import SCHEMAS, Tables, units_dimension
from tickweave.operators import digests, ingest, integrity, leakscan, quality, report, series
from tickweave.session import shared_folder
from tickweave.sources import eventlog, store
from tickweave.sources.eventlog import table
from verification.diagnostic_queries import _expected_switches
from verification.quality_queries import _MEASURED
from verification.tables_sql import EVENT_LOG, PLANTED, REGISTRY, on


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def empty(spark):
    return Tables(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def log(spark, sf):
    return eventlog.event_log(spark, sf)


def _touched(spark, sf):
    """The event log with one reading in 997 raised by the smallest step of its text."""
    tables = log(spark, sf)
    tick = F.col("sample_index")
    moved = (tick % 97 == 3) & F.col("run_id").rlike(r"\.e[1-4]\.") & F.col("sensor_id").endswith(".C_A")
    return tables.with_(measurements=tables.measurements.withColumn("value", F.when(moved, F.col("value") + 0.01).otherwise(F.col("value"))))


def _changed_content(spark, sf):
    return report.content_differs(digests.run_digests(log(spark, sf)), digests.run_digests(_touched(spark, sf)))


def _gate(spark, sf):
    """Five fates at once: a broken run, changed content, a run known from another data set, a run already there, and new runs."""
    offered = digests.recorded_runs(ingest.staged(log(spark, sf)))
    pick = F.col("run_id")
    held = offered.operating_runs.where(pick.contains(".e5.") | pick.contains(".e6."))
    stored = Tables(
        plants=offered.plants.where("plant_id = 'source'"), process_parameters=offered.process_parameters.where("plant_id = 'source'"),
        sensors=offered.sensors.where("plant_id = 'source'"),
        operating_runs=held.where("plant_id = 'source'").withColumn("dataset_id", F.when(pick.contains(".e6."), "elsewhere").otherwise(F.col("dataset_id"))),
        measurements=offered.measurements.where((pick.contains(".e5.") | pick.contains(".e6.")) & (F.col("plant_id") == "source")),
    )
    rows = offered.measurements.where(~(pick.contains(".e1.") & (F.col("sample_index") == 7) & F.col("sensor_id").endswith(".T")))
    rows = rows.withColumn("value", F.when(pick.contains(".e2.") & (F.col("sample_index") == 5) & F.col("sensor_id").endswith(".T"), F.col("value") + 1.0).otherwise(F.col("value")))
    return offered.with_(measurements=rows), stored


def _gate_report(spark, sf):
    offered, stored = _gate(spark, sf)
    return ingest.gate(ingest.staged(offered), ingest.staged(stored))


def _gate_conflicts(spark, sf):
    """A new plant whose channel another plant of the store owns, and measurements of a run
    that the offer doesn't list."""
    tables = ingest.staged(log(spark, sf))
    of = lambda df, plant: df.where(F.col("plant_id") == plant)
    claimed = lambda df: df.withColumn("sensor_id", F.when(F.col("sensor_id") == "target.T", "source.T").otherwise(F.col("sensor_id")))
    target = Tables(**{name: of(df, "target") for name, df in tables.items()})
    offered = digests.recorded_runs(target.with_(sensors=claimed(target.sensors), measurements=claimed(target.measurements)))
    offered = offered.with_(operating_runs=offered.operating_runs.where(~F.col("run_id").contains(".e3.")))
    stored = Tables(**{name: of(df, "source") for name, df in tables.items()})
    return offered, stored


def _conflicts_report(spark, sf):
    return ingest.gate(*_gate_conflicts(spark, sf))


def _first_refusal(spark, sf):
    """The gate that stops at the first refusal."""
    offered, stored = _gate(spark, sf)
    return ingest.ingest(ingest.staged(offered), ingest.staged(stored), fail_fast=True)[0]


def _broken_documents(spark, sf):
    """Documents that no walk ends well on: an integer of 400 digits, a text cut short, and nesting
    deeper than the parser goes; beside them sound ones."""
    k = F.expr("event_id div 500 % 4")
    rows = table(spark, sf, "events").where("event_id % 500 = 0")
    text = (
        F.when(k == 0, F.concat(F.lit('{"k": '), F.repeat(F.lit("9"), 400), F.lit("}"))).when(k == 1, '{"note": "UA_ref')
        .when(k == 2, F.repeat(F.lit("["), 100_000)).otherwise('{"a": [1, {"b": true}]}')
    )
    return rows.select(F.col("event_id").cast("string").alias("document"), text.alias("json"))


def _ingest_twice(spark, sf):
    """Ingest into an empty store, ingest again: everything is already there, nothing grows."""
    root = folder(spark, "store")
    offered = ingest.examined(digests.recorded_runs(ingest.staged(log(spark, sf))))
    first, rows = ingest.ingest(offered, store.read_store(spark, root))
    store.append(rows, root, "one")
    held = store.read_store(spark, root)
    again, _ = ingest.ingest(offered, held)
    a = first.groupBy(F.lit("first").alias("pass"), "status").agg(F.count(F.lit(1)).alias("n_runs"))
    b = again.groupBy(F.lit("again").alias("pass"), "status").agg(F.count(F.lit(1)).alias("n_runs"))
    return a.unionByName(b)


def _stored_rows(spark, sf):
    root = folder(spark, "store")
    offered = digests.recorded_runs(ingest.staged(log(spark, sf)))
    _, rows = ingest.ingest(offered, store.read_store(spark, root))
    store.append(rows, root, "one")
    return ingest.row_counts(store.read_store(spark, root))


def _publish(spark, sf):
    root = folder(spark, "published")
    tables = ingest.staged(log(spark, sf))
    statuses = [store.publish(tables, root, "events")[0], store.publish(tables, root, "events")[0], store.publish(_touched(spark, sf), root, "events")[0]]
    return spark.createDataFrame(list(enumerate(statuses)), "attempt bigint, status string")


def _published(spark, sf):
    root = folder(spark, "published")
    store.publish(ingest.staged(log(spark, sf)), root, "events")
    return root, store.read_published(spark, root, "events")


def _read_published(spark, sf):
    return _published(spark, sf)[1].measurements


def _published_files(spark, sf):
    """One listed file is gone from the listing and one file is not listed."""
    root, _ = _published(spark, sf)
    listed = store.manifest_files(spark, root, "events")
    files = store.list_files(spark, f"{root}/events").where(~F.col("path").contains(f"/{store.MANIFEST}/"))
    found = files.where(F.element_at(F.split("path", "/"), -2) != "plants")
    return store.file_agreement(listed.where("table_name <> 'sensors'"), found).groupBy("problem").agg((F.count(F.lit(1)) > 0).alias("present"))


def _export(spark, sf):
    path = folder(spark, "export")
    tables = log(spark, sf)
    store.write_export(tables, path)
    return tables, spark.read.parquet(path)


def _export_problems(spark, sf):
    tables, exported = _export(spark, sf)
    e = F.col("sample_index")
    broken = exported.where(~(F.col("run_id").contains(".e1.") & (e == 9))).withColumn("T", F.when(F.col("run_id").contains(".e2.") & (e == 4), None).otherwise(F.col("T")))
    listed = tables.operating_runs.select("run_id", F.col("n_samples").alias("rows"), "start_time_s", F.when(F.col("run_id").contains(".e3."), F.col("end_time_s") + 6.0).otherwise(F.col("end_time_s")).alias("end_time_s"))
    return integrity.exported_runs(broken, listed)


def _incomplete(spark, sf):
    tables = eventlog.planted(spark, sf)
    return store.incomplete_runs(series.aligned_series(tables), tables.operating_runs)


def _fingerprints(spark, sf):
    files = store.list_files(spark, sf).where(F.col("path").endswith(".parquet"))
    return store.fingerprints(files).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


def _ledger(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    d = F.col("doc_id")
    lines = docs.where(d % 41 != 0).withColumn("copy", F.explode(F.when(d % 37 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    ledger = lines.select("file", F.lit("record").alias("kind"), F.concat(F.lit("k"), F.when(d % 43 == 0, d + 1).otherwise(d).cast("string")).alias("key"), F.when(d % 31 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return store.ledger_problems(ledger, docs.where(d % 29 != 0))


def _manifest(spark, sf):
    runs = log(spark, sf).operating_runs
    listed = runs.where("run_id NOT LIKE '%.e0.%'").withColumn("n_samples", F.when(F.col("run_id").contains(".e1."), 0).otherwise(F.col("n_samples"))).withColumn(
        "content_sha256", F.when(F.col("run_id").contains(".e2."), "x").otherwise(F.col("content_sha256"))).withColumn("plant_id", F.when(F.col("run_id").contains(".e3."), "x").otherwise(F.col("plant_id")))
    return integrity.manifest_agreement(listed, runs.where("run_id NOT LIKE '%.e4.%'"))


def _parameters(spark, sf):
    t = eventlog.registry(spark, sf)
    return integrity.known_parameters(t.process_parameters.where("plant_id IS NOT NULL"), t.plants).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _names(spark, sf):
    parts = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("place"), F.concat_ws(
        "_", "source", "lang", F.when(F.col("doc_id") % 17 == 0, "Seed").when(F.col("doc_id") % 19 == 0, "Exact_State").otherwise("value")).alias("name"))
    return leakscan.forbidden_names(parts)


def _text(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit(" UA_REF and True_Physics"))).otherwise(F.col("text")).alias("text"))
    return leakscan.forbidden_text(docs)


def _numbers(spark, sf):
    rows = table(spark, sf, "lineitem")
    states = table(spark, sf, "orders").select((F.floor(F.col("o_totalprice") / 100) / 100.0).alias("value"))
    return leakscan.table_findings(rows.select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag"), {"a discount": 0.07 * (1 + 3e-13), "a price": 44473.56}, {"a seed": 17}, states)


def _documents(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.cast("string").alias("document"), F.when(e % 50 == 0, F.concat(F.lit('{"run": {"Seed": 3, "rows": 42, "list": [{"value": 0.125}, "uses UA_ref"], "props": '), "props", F.lit("}}"))).otherwise(F.col("props")).alias("json"))


def _document_findings(spark, sf):
    return leakscan.document_findings(leakscan.walk_documents(_documents(spark, sf)), {"alpha": 0.125}, {"the answer": 42})


def _mandatory(spark, sf):
    """The mandatory checks over the event log, end to end."""
    root, back = _published(spark, sf)
    tables = ingest.staged(log(spark, sf))
    recorded = digests.recorded_runs(tables)
    aligned = series.aligned_series(back)
    exported = store.export_rows(back)
    rebuilt = digests.run_digests(back)
    results = report.checks({
        "parquet_round_trip_equal": report.content_differs(digests.run_digests(tables), rebuilt),
        "stored_content_equal": digests.changed_runs(recorded.operating_runs, rebuilt),
        "quality_checks_pass": quality.failed_checks(back),
        "switches_preserved": report.switches_differ(series.input_switches(aligned), _expected_switches(eventlog.wide_log(spark, sf))),
        "export_equals_stored_content": report.exported_differs(aligned, exported),
        "no_forbidden_names": leakscan.forbidden_names(leakscan.column_names(spark, dict(back.items()))),
    })
    return report.verdict(results, 6)


#: Checks of the long table whose item is told by the SQL of the check: run and channel, or what the text says.
_ITEMS = {name: "run_id || ' / ' || sensor_id" for name in ("infinite_values", "quality_flags", "row_counts", "tick_ranges", "gaps", "time_not_increasing", "off_clock", "missing_channels")} | {
    "duplicate_measurements": "run_id || ' / ' || sensor_id || ' / tick ' || sample_index", "unknown_channels": "sensor_id", "empty_runs": "run_id",
    "foreign_run_rows": "run_id || ': ' || plant_id || ' against ' || owner", "foreign_channel_rows": "run_id || ' / ' || sensor_id || ': ' || plant_id || ' against ' || owner",
}


def _first_findings(spark, sf):
    found = quality.report(eventlog.planted(spark, sf), [quality.BY_NAME[n] for n in _ITEMS])
    return ingest.first_per_check(found, 7).select("branch", "item")


def _encoded_sql(name, kind):
    if kind == "double":
        guess = f"floor(log2(abs({name})))"
        first = f"floor((52 - {guess}) / 2)"
        scaled = f"(abs({name}) * pow(2::DOUBLE, {first}) * pow(2::DOUBLE, 52 - {guess} - {first}))"
        shift = f"(CASE WHEN {scaled} >= 9007199254740992 THEN 1 WHEN {scaled} < 4503599627370496 THEN -1 ELSE 0 END)"
        return (f"CASE WHEN {name} IS NULL THEN 'N' WHEN isnan({name}) THEN 'Fnan' WHEN isinf({name}) THEN CASE WHEN {name} > 0 THEN 'Finf' ELSE 'F-inf' END WHEN {name} = 0 THEN 'F' || {name}::VARCHAR "
                f"ELSE 'F' || CASE WHEN {name} < 0 THEN '-' ELSE '' END || ({scaled} * pow(2::DOUBLE, -{shift}))::BIGINT || 'p' || ({guess} + {shift} - 52)::BIGINT END")  # fmt: skip
    return f"coalesce('S' || length({name}) || ':' || {name}, 'N')" if kind == "string" else f"coalesce('I' || {name}::VARCHAR, 'N')"


def _digest_sql(source, columns, header, keys=()):
    """The digest of the rows of ``source`` by ``keys``, from its definition."""
    text = " || ',' || ".join(_encoded_sql(n, k) for n, k in columns)
    words = [f"coalesce(sum(substr(h, {digests.DIGITS * i + 1}, {digests.DIGITS})::BIGINT), 0)::VARCHAR" for i in range(digests.WORDS)]
    by = "".join(f"{k}, " for k in keys)
    return f"SELECT {by}count(*) AS n_rows, sha256(concat_ws(chr(10), '{header}', count(*)::VARCHAR, {', '.join(words)})) AS content_sha256 FROM (SELECT {by}translate(sha256({text}), 'abcdef', '012345') AS h FROM {source})" + (f" GROUP BY {', '.join(keys)}" if keys else "")


_KIND_OF = {f.name: f.dataType.simpleString() for name in ("sensors", "measurements") for f in SCHEMAS[name].fields}
_RUN_COLUMNS = digests.ROW_COLUMNS + digests.CHANNEL_COLUMNS
_RUN_ROWS = "(SELECT m.*, s.* EXCLUDE (sensor_id, plant_id) FROM measurements m LEFT JOIN sensors s USING (sensor_id))"
_RUN_DIGESTS = _digest_sql(_RUN_ROWS, [(c, _KIND_OF[c]) for c in _RUN_COLUMNS], digests.RUN_ENCODING, ("run_id",))
_PROFILED = ("unknown_runs", "foreign_run_rows", "foreign_channel_rows", "infinite_values", "infinite_times", "run_channel_periods", "quality_flags", "row_counts", "tick_ranges", "gaps",
             "time_not_increasing", "off_clock", "last_instants", "empty_runs", "missing_channels", "duplicate_measurements")

QUERIES = {
    "digest_changed_runs": _changed_content,
    "digest_of_tables": lambda spark, sf: digests.table_digests(eventlog.registry(spark, sf)),
    "digest_of_runs": lambda spark, sf: digests.run_digests(log(spark, sf)),
    "integrity_units_not_si": lambda spark, sf: integrity.not_in_si(eventlog.registry(spark, sf).sensors, units_dimension(spark)).select("sensor_id", "unit"),
    "integrity_misnamed_channels": lambda spark, sf: integrity.misnamed_channels(eventlog.registry(spark, sf).sensors),
    "integrity_broken_positions": lambda spark, sf: integrity.broken_positions(eventlog.registry(spark, sf).sensors),
    "integrity_plants_without_run": lambda spark, sf: integrity.plants_without(eventlog.registry(spark, sf).plants, eventlog.registry(spark, sf).operating_runs),
    "integrity_foreign_dataset_runs": lambda spark, sf: integrity.foreign_dataset_runs(eventlog.registry(spark, sf).operating_runs, "1-URGENT"),
    "integrity_broken_run_rows": lambda spark, sf: integrity.broken_run_rows(eventlog.registry(spark, sf).operating_runs),
    "integrity_row_agreement": lambda spark, sf: integrity.row_agreement(eventlog.planted(spark, sf), quality.profile(eventlog.planted(spark, sf).measurements)),
    "integrity_tick_agreement": lambda spark, sf: integrity.tick_agreement(eventlog.planted(spark, sf)),
    "integrity_end_points": lambda spark, sf: integrity.end_points(eventlog.planted(spark, sf)),
    "integrity_known_parameters": _parameters,
    "integrity_manifest_agreement": _manifest,
    "integrity_export_problems": _export_problems,
    "integrity_null_counts": lambda spark, sf: integrity.null_counts(eventlog.planted(spark, sf).measurements, "measurements"),
    "integrity_pre_publish": lambda spark, sf: integrity.pre_publish(eventlog.registry(spark, sf)),
    "ingest_gate": _gate_report,
    "ingest_gate_conflicts": _conflicts_report,
    "ingest_first_refusal": _first_refusal,
    "ingest_unlisted_runs": lambda spark, sf: ingest.unlisted_runs(_gate_conflicts(spark, sf)[0]),
    "leak_broken_document_walk": lambda spark, sf: leakscan.walk_documents(_broken_documents(spark, sf)).select("document", "trail", "field", "kind", F.left("text", F.lit(20)).alias("start"), "integer"),
    "leak_broken_document_findings": lambda spark, sf: leakscan.document_findings(leakscan.walk_documents(_broken_documents(spark, sf)), {}, {"one": 1}),
    "ingest_twice": _ingest_twice,
    "ingest_stored_rows": _stored_rows,
    "ingest_quality_by_run": lambda spark, sf: ingest.quality_findings_by_run(eventlog.planted(spark, sf)),
    "ingest_stored_counts": lambda spark, sf: ingest.stored_counts(log(spark, sf), eventlog.planted(spark, sf)),
    "store_manifest_runs": lambda spark, sf: store.manifest_runs(log(spark, sf)),
    "report_first_per_check": _first_findings,
    "store_publish": _publish,
    "store_read_published": _read_published,
    "store_published_files": _published_files,
    "store_export": lambda spark, sf: _export(spark, sf)[1],
    "store_incomplete_runs": _incomplete,
    "store_file_fingerprints": _fingerprints,
    "store_ledger_problems": _ledger,
    "store_key_filtered_scan": lambda spark, sf: store.read_columns(spark, os.path.join(sf, "lineitem.parquet"), ["l_orderkey", "l_quantity"], "l_returnflag", "R"),
    "leak_forbidden_names": _names,
    "leak_forbidden_text": _text,
    "leak_hidden_numbers": _numbers,
    "leak_document_walk": lambda spark, sf: leakscan.walk_documents(_documents(spark, sf)).select("document", "trail", "field", "kind"),
    "leak_document_findings": _document_findings,
    "leak_parquet_metadata": lambda spark, sf: leakscan.parquet_metadata(spark, [r["path"] for r in store.list_files(spark, sf).toLocalIterator()]).select("place", "name"),
    "report_verdict": _mandatory,
}
_ALL = "SELECT run_id FROM operating_runs"
SQL = {
    "digest_changed_runs": on(EVENT_LOG, "SELECT DISTINCT run_id FROM wide WHERE sample_index % 97 = 3 AND regexp_matches(run_id, '\\.e[1-4]\\.')"),
    "integrity_units_not_si": on(REGISTRY, "SELECT sensor_id, unit FROM sensors WHERE unit = 'K*'"),
    "integrity_misnamed_channels": on(REGISTRY, "SELECT sensor_id, plant_id, variable_name FROM sensors WHERE sensor_id <> plant_id || '.' || variable_name"),
    "integrity_broken_positions": on(REGISTRY, """SELECT plant_id, channel_kind, count(*) AS n_channels, count(DISTINCT channel_index) AS n_positions, min(channel_index) AS first, max(channel_index) AS last
        FROM sensors GROUP BY ALL HAVING list_sort(list(channel_index)) IS DISTINCT FROM range(count(*))::INT[] OR count(channel_index) < count(*)"""),
    "integrity_plants_without_run": on(REGISTRY, "SELECT DISTINCT p.plant_id FROM plants p ANTI JOIN operating_runs r USING (plant_id)"),
    "integrity_foreign_dataset_runs": on(REGISTRY, "SELECT run_id, dataset_id FROM operating_runs WHERE dataset_id <> '1-URGENT'"),
    "integrity_broken_run_rows": on(REGISTRY, """
        SELECT * FROM (SELECT run_id, NOT coalesce(isfinite(start_time_s) AND end_time_s >= start_time_s AND sampling_period_s > 0 AND n_samples > 0, false) AS impossible_extent,
               trim(operating_mode) = '' OR description IS NULL AS blank_text, false AS bad_identifier FROM operating_runs) WHERE impossible_extent OR blank_text"""),
    "integrity_row_agreement": on(PLANTED, """
        SELECT * FROM (SELECT m.run_id, count(*) FILTER (m.plant_id <> r.plant_id) AS other_plant, count(*) FILTER (s.sensor_id IS NULL) AS unknown_channel, count(*) FILTER (s.plant_id <> r.plant_id) AS foreign_channel,
            count(*) FILTER (coalesce(quality_flag, 9) <> 0) AS flagged, count(*) FILTER (s.sampling_period_s <> r.sampling_period_s) AS other_period
          FROM measurements m JOIN operating_runs r USING (run_id) LEFT JOIN sensors s USING (sensor_id) GROUP BY m.run_id)
        WHERE other_plant + unknown_channel + foreign_channel + flagged + other_period > 0"""),
    "integrity_tick_agreement": on(PLANTED, """
        SELECT run_id, unequal_instants, repeated, incomplete_channels FROM
          (SELECT run_id, count(*) FILTER (a <> b) AS unequal_instants FROM (SELECT run_id, sample_index, min(time_s) AS a, max(time_s) AS b FROM measurements GROUP BY ALL) GROUP BY run_id)
          JOIN (SELECT run_id, count(*) FILTER (n > 1) AS repeated FROM (SELECT run_id, sample_index, sensor_id, count(*) AS n FROM measurements GROUP BY ALL) GROUP BY run_id) USING (run_id)
          JOIN (SELECT run_id, count(*) FILTER (n <> n_samples OR lo <> 0 OR hi <> n_samples - 1) AS incomplete_channels
                FROM (SELECT run_id, sensor_id, count(DISTINCT sample_index) AS n, min(sample_index) AS lo, max(sample_index) AS hi FROM measurements GROUP BY ALL) JOIN operating_runs USING (run_id) GROUP BY run_id) USING (run_id)
        WHERE unequal_instants + repeated + incomplete_channels > 0"""),
    "integrity_end_points": on(PLANTED, """SELECT run_id, first_s, last_s, start_time_s, end_time_s FROM (SELECT run_id, min(time_s) AS first_s, max(time_s) AS last_s FROM measurements GROUP BY ALL)
        JOIN operating_runs USING (run_id) WHERE first_s <> start_time_s OR last_s <> end_time_s"""),
    "integrity_known_parameters": on(REGISTRY, """
        SELECT problem, count(*) AS n FROM (
          SELECT 'missing' AS problem, plant_id, parameter FROM (SELECT DISTINCT plant_id FROM plants), (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) v(parameter)
          UNION ALL SELECT DISTINCT 'unknown', plant_id, hash(parameter)::VARCHAR FROM process_parameters WHERE plant_id IS NOT NULL) GROUP BY problem"""),
    "integrity_manifest_agreement": on(EVENT_LOG, """
        SELECT run_id, problem FROM operating_runs, (VALUES ('.e0.', 'not in the manifest'), ('.e1.', 'samples differ'), ('.e2.', 'hash differs'), ('.e3.', 'plant differs'), ('.e4.', 'not stored')) v(e, problem) WHERE contains(run_id, e)"""),
    "integrity_export_problems": on(EVENT_LOG, """
        SELECT run_id, problem FROM operating_runs, (VALUES ('.e1.', 'number of rows'), ('.e2.', 'nulls'), ('.e3.', 'end points')) v(e, problem) WHERE contains(run_id, e)"""),
    "integrity_null_counts": on(PLANTED, "SELECT column_name, n_nulls FROM (UNPIVOT (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in SCHEMAS["measurements"].names) + " FROM measurements) ON COLUMNS(*) INTO NAME column_name VALUE n_nulls)"),
    "integrity_pre_publish": on(REGISTRY, """
        SELECT 'description varies' AS problem, plant_id, variable_name, count(*) AS n
        FROM (SELECT DISTINCT plant_id, variable_name, channel_kind, channel_index, unit, sampling_period_s, noise_model, noise_std FROM sensors) GROUP BY plant_id, variable_name HAVING count(*) > 1
        UNION ALL SELECT 'more than one unit', NULL, variable_name, count(*) FROM (SELECT DISTINCT variable_name, unit FROM sensors) GROUP BY variable_name HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'plant without run', p.plant_id, NULL, 0::BIGINT FROM plants p ANTI JOIN operating_runs r USING (plant_id)"""),
    "ingest_gate": on(EVENT_LOG, """
        SELECT run_id, plant_id, CASE WHEN contains(run_id, '.e1.') THEN 'quality' WHEN contains(run_id, '.e2.') THEN 'content_changed' WHEN run_id LIKE 'source%.e6.%' THEN 'dataset_conflict' END AS refused_by,
               CASE WHEN refused_by IS NOT NULL THEN 'refused' WHEN run_id LIKE 'source%.e5.%' THEN 'already_present' ELSE 'ingested' END AS status FROM operating_runs"""),
    "ingest_gate_conflicts": on(EVENT_LOG, """
        SELECT run_id, CASE WHEN NOT contains(run_id, '.e3.') THEN plant_id END AS plant_id, CASE WHEN contains(run_id, '.e3.') THEN 'run_not_listed' ELSE 'plant_conflict' END AS refused_by, 'refused' AS status
        FROM operating_runs WHERE plant_id = 'target'"""),
    "ingest_unlisted_runs": on(EVENT_LOG, "SELECT run_id, count(*) AS n_rows FROM measurements WHERE run_id LIKE 'target%.e3.%' GROUP BY run_id"),
    "leak_broken_document_walk": """
        SELECT event_id::VARCHAR AS document, trail, field, kind, start, "integer" FROM events, (VALUES
            (0, '', 'k', 'key', 'k', NULL), (0, '/k', 'k', 'integer', repeat('9', 20), NULL), (1, '', '', 'invalid', '{"note": "UA_ref', NULL), (2, '', '', 'invalid', repeat('[', 20), NULL),
            (3, '', 'a', 'key', 'a', NULL), (3, '/a[0]', 'a', 'integer', '1', 1::BIGINT), (3, '/a[1]', 'b', 'key', 'b', NULL)) v(k, trail, field, kind, start, "integer")
        WHERE event_id % 500 = 0 AND event_id // 500 % 4 = k""",
    "leak_broken_document_findings": """SELECT event_id::VARCHAR AS document, trail, finding FROM events, (VALUES (1, '', 'text mentions UA_ref'), (3, '/a[0]', 'holds one')) v(k, trail, finding)
        WHERE event_id % 500 = 0 AND event_id // 500 % 4 = k""",
    "ingest_twice": on(EVENT_LOG, "SELECT 'first' AS pass, 'ingested' AS status, count(*) AS n_runs FROM operating_runs UNION ALL SELECT 'again', 'already_present', count(*) FROM operating_runs"),
    "ingest_stored_rows": on(EVENT_LOG, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in SCHEMAS)),
    "ingest_quality_by_run": on(PLANTED, " UNION ALL ".join(f"SELECT run_id, '{n}' AS branch, count(*) AS n_findings FROM ({_MEASURED[n]}) GROUP BY run_id" for n in _PROFILED) + """
        UNION ALL SELECT run_id, 'unknown_channels', count(DISTINCT sensor_id) FROM measurements ANTI JOIN sensors USING (sensor_id) GROUP BY run_id
        UNION ALL SELECT run_id, 'absent_measurements', count(*) FROM (SELECT plant_id, run_id, sensor_id, quality_flag, bool_or(value IS NULL OR quality_flag IS NULL OR trim(sensor_id) = '') AS lacks
          FROM measurements GROUP BY ALL) WHERE lacks GROUP BY run_id"""),
    "digest_of_runs": on(EVENT_LOG, _RUN_DIGESTS),
    "digest_of_tables": on(REGISTRY, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, * FROM ({_digest_sql(t, [(f.name, f.dataType.simpleString()) for f in SCHEMAS[t].fields], f'{digests.TABLE_ENCODING} {t}')})" for t in SCHEMAS if t != "measurements")),
    "store_manifest_runs": on(EVENT_LOG, f"""SELECT run_id, plant_id, d.n_rows AS "rows", n_samples, start_time_s, end_time_s, sampling_period_s, d.content_sha256 FROM operating_runs r JOIN ({_RUN_DIGESTS}) d USING (run_id)"""),
    "ingest_stored_counts": on(PLANTED, "SELECT run_id, staged, stored FROM (SELECT run_id, count(*) AS staged FROM long GROUP BY run_id) LEFT JOIN (SELECT run_id, count(*) AS stored FROM measurements GROUP BY run_id) USING (run_id) WHERE staged IS DISTINCT FROM stored"),
    "report_first_per_check": on(PLANTED, "SELECT branch, item FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY item NULLS FIRST) AS k FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS branch, {item} AS item FROM ({_MEASURED[n]})" for n, item in _ITEMS.items()) + ")) WHERE k <= 7"),
    "store_publish": "SELECT * FROM (VALUES (0::BIGINT, 'created'), (1, 'already_present'), (2, 'conflict')) v(attempt, status)",
    "store_read_published": on(EVENT_LOG, "SELECT * FROM measurements"),
    "store_published_files": "SELECT * FROM (VALUES ('missing', true), ('unexpected', true)) v(problem, present)",
    "store_export": on(EVENT_LOG, "SELECT 'events' AS dataset_id, plant_id, run_id, sample_index, time_s, C_A, T, q, C_Af, T_f, T_c FROM wide"),
    "store_incomplete_runs": on(PLANTED, _ALL),
    "store_ledger_problems": """
        WITH d AS (SELECT doc_id, 'd' || doc_id AS file, text FROM documents), l AS (SELECT * FROM d WHERE doc_id % 41 <> 0)
        SELECT file, 'missing' AS problem FROM l WHERE doc_id % 29 = 0 UNION ALL SELECT file, 'not in the ledger' FROM d WHERE doc_id % 41 = 0 AND doc_id % 29 <> 0
        UNION ALL SELECT file, 'entered twice' FROM l WHERE doc_id % 37 = 0 UNION ALL SELECT file, 'altered' FROM l WHERE doc_id % 29 <> 0 AND doc_id % 31 = 0
        UNION ALL SELECT min(file), 'key entered twice' FROM (SELECT file, CASE WHEN doc_id % 43 = 0 THEN doc_id + 1 ELSE doc_id END AS k FROM l, (VALUES (1), (2)) v(c) WHERE c = 1 OR doc_id % 37 = 0) GROUP BY k HAVING count(*) > 1""",
    "store_key_filtered_scan": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
    "leak_forbidden_names": "WITH n AS (SELECT 'd' || doc_id AS place, source || '_' || lang || '_' || CASE WHEN doc_id % 17 = 0 THEN 'Seed' WHEN doc_id % 19 = 0 THEN 'Exact_State' ELSE 'value' END AS name FROM documents) "
        "SELECT place, name, word FROM n, (VALUES " + ", ".join(f"('{w}')" for w in leakscan.FORBIDDEN_IN_NAMES) + ") v(word) WHERE contains(lower(name), word)",
    "leak_forbidden_text": """
        SELECT 'text' AS "column", word, count(*) AS n FROM (SELECT CASE WHEN doc_id % 23 = 0 THEN text || ' UA_REF and True_Physics' ELSE text END AS t FROM documents),
        (VALUES ('true_physics'), ('sensor_master_seed'), ('saturation_constant'), ('UA_ref')) v(word) WHERE contains(lower(t), lower(word)) GROUP BY ALL""",
    "leak_hidden_numbers": """
        WITH s AS (SELECT DISTINCT floor(o_totalprice / 100) / 100.0::DOUBLE AS value FROM orders),
        f AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
        i AS (SELECT 'l_orderkey' AS "column", l_orderkey AS v FROM lineitem UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem)
        SELECT "column", 'holds a discount' AS finding, count(*) AS n FROM f WHERE abs(v - 0.07) < 1e-12 GROUP BY ALL UNION ALL SELECT "column", 'holds a price', count(*) FROM f WHERE v = 44473.56::DOUBLE GROUP BY ALL
        UNION ALL SELECT "column", 'equals a hidden state', count(*) FROM f SEMI JOIN s ON s.value = f.v GROUP BY ALL UNION ALL SELECT "column", 'holds a seed', count(*) FROM i WHERE v = 17 GROUP BY ALL""",
    "leak_document_walk": """
        SELECT event_id::VARCHAR AS document, trail, field, kind FROM events, (VALUES (false, '', 'k', 'key'), (false, '/k', 'k', 'integer'),
            (true, '', 'run', 'key'), (true, '/run', 'Seed', 'key'), (true, '/run/Seed', 'Seed', 'integer'), (true, '/run', 'rows', 'key'), (true, '/run/rows', 'rows', 'integer'),
            (true, '/run', 'list', 'key'), (true, '/run/list[0]', 'value', 'key'), (true, '/run/list[0]/value', 'value', 'float'), (true, '/run/list[1]', 'list', 'text'),
            (true, '/run', 'props', 'key'), (true, '/run/props', 'k', 'key'), (true, '/run/props/k', 'k', 'integer')) v(wrapped, trail, field, kind)
        WHERE (event_id % 50 = 0) = wrapped""",
    "leak_document_findings": """
        SELECT event_id::VARCHAR AS document, trail, finding FROM events, (VALUES ('/run', 'name Seed contains seed'), ('/run/list[0]/value', 'holds alpha'), ('/run/list[1]', 'text mentions UA_ref')) v(trail, finding) WHERE event_id % 50 = 0
        UNION ALL SELECT event_id::VARCHAR, CASE WHEN event_id % 50 = 0 THEN '/run/props/k' ELSE '/k' END, 'holds the answer' FROM events WHERE props = '{"k": 42}'""",
    "report_verdict": "SELECT 6::BIGINT AS n_checks, 6::BIGINT AS n_passed, true AS ok",
}
SQL["ingest_first_refusal"] = SQL["ingest_gate"].rstrip().replace("SELECT run_id, plant_id, CASE", """SELECT run_id, plant_id, refused_by, CASE WHEN run_id <= min(run_id) FILTER (status = 'refused') OVER () THEN status ELSE 'not_reached' END AS status
        FROM (SELECT run_id, plant_id, CASE""", 1) + ")"
