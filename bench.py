"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink, so every row is computed and nothing is collected.
The event log is staged once as the contract tables in Parquet, which is what the operators
read in use; the time of staging is a query of its own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from tickweave.contract import SCHEMAS, Tables, constant
    from tickweave.operators import digests, ingest, leakscan, outcomes, quality, scoring, series, windows
    from tickweave.session import local_session, staged
    from tickweave.sources import eventlog, store
    from verification import comparison_queries as cq

    spark = local_session(cpus, "tickweave-bench")
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    seconds: dict[str, float] = {}

    def timed(name, step):
        started = time.perf_counter()
        out = step()
        if hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        return out

    def stage():
        tables = eventlog.event_log(spark, sf_dir)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{scratch}/stage/{name}")
        eventlog.wide_log(spark, sf_dir).withColumn("complete", F.lit(True)).write.parquet(f"{scratch}/stage/wide")

    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    timed("stage_contract_tables", stage)
    t = Tables(**{n: spark.read.parquet(f"{scratch}/stage/{n}") for n in SCHEMAS})
    wide = spark.read.parquet(f"{scratch}/stage/wide")
    rows = t.measurements.count()

    timed("aligned_series", lambda: series.aligned_series(t))
    timed("lagged_measurements", lambda: series.lagged_measurements(t.measurements))
    timed("block_average", lambda: series.block_average(series.aligned_series(t), t.operating_runs, 10))
    timed("compare_plants", lambda: series.compare_plants(series.aligned_series(t), t.operating_runs, "source", "target"))
    timed("quality_report", lambda: quality.report(t))
    timed("run_digests", lambda: digests.run_digests(t))
    offered = digests.recorded_runs(t)
    offered = offered.with_(operating_runs=staged(offered.operating_runs, "offer"))

    def admit():
        _, taken = ingest.ingest(offered, store.read_store(spark, f"{scratch}/store"))
        store.append(taken, f"{scratch}/store", "one")

    timed("ingest", admit)
    timed("export_aligned", lambda: store.write_export(t, f"{scratch}/export"))
    timed("read_back_and_verify", lambda: digests.changed_runs(offered.operating_runs, digests.run_digests(store.read_store(spark, f"{scratch}/store"))))
    states = spark.createDataFrame([(355.1686663655008,)], "value double")
    timed("leak_scan", lambda: leakscan.table_findings(t.measurements, {"alpha": 0.123456789}, {"seed": 987654321}, states))
    nominal = windows.nominal_inputs(t.process_parameters)
    modes = t.operating_runs.select("run_id", "operating_mode")

    def evaluate():
        found = windows.find_windows(windows.excursions(wide, nominal, modes))
        data = windows.window_data(windows.window_ticks(found), wide)
        sigmas = t.operating_runs.select("run_id", "plant_id").join(scoring.noise_levels(t.sensors), "plant_id").drop("plant_id")
        predictions = scoring.reference_predictions(data, windows.initial_states(data), wide)
        return scoring.evaluate(scoring.errors(predictions, data, sigmas), constant(spark, [("hold", "held out")], "model string, role string"))

    timed("windows_and_scores", evaluate)
    timed("paired_comparison", lambda: outcomes.ordered_verdicts(cq.ordered(spark, sf_dir)))
    print(json.dumps({
        "metric": "total wall clock of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "measurements": rows, "ingest_measurements_per_s": round(rows / seconds["ingest"]),
    }))


if __name__ == "__main__":
    main()
