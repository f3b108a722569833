"""Published data sets, exports and ledgers as Parquet and JSON.

A data set becomes visible by its manifest, which is written last: readers take files from
the manifest only, never from a wildcard. Writing the same content again changes nothing;
other content under the same name is a conflict, and nothing is overwritten.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickweave.contract import INPUTS, SCHEMAS, STATES, Tables, conform
from tickweave.functions.scalars import differs
from tickweave.operators import integrity, quality
from tickweave.operators.digests import recorded_runs, run_digests, table_digests
from tickweave.operators.series import aligned_series
from tickweave.plans.dealing import tasks
from tickweave.session import cut_lineage

MANIFEST = "manifest"
CREATED, PRESENT, CONFLICT = "created", "already_present", "conflict"
EXPORT_COLUMNS = ("dataset_id", "plant_id", "run_id", "sample_index", "time_s", *STATES, *INPUTS)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, hadoop = _path(spark, path)
    return filesystem.exists(hadoop)


def read_contract_table(spark: SparkSession, name: str, paths: Sequence[str]) -> DataFrame:
    """A contract table from listed files; another schema is refused."""
    found = spark.read.parquet(*paths)
    problems = integrity.schema_problems(found, name)
    if problems:
        raise ValueError(f"{name}: the files do not have the schema of the contract: {problems}")
    return found


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], key: str, value) -> DataFrame:
    """Listed columns of the rows with one key: pruned and pushed down to the scan."""
    return spark.read.parquet(path).where(F.col(key) == value).select(*columns)


def manifest_tables(tables: Tables) -> DataFrame:
    """One row per table: rows and digest. The long table is identified run by run."""
    rows = tables.measurements.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("measurements").alias("table_name"), "n_rows", F.lit("by run").alias("content_sha256"))
    return table_digests(tables).unionByName(rows)


def manifest_runs(tables: Tables) -> DataFrame:
    runs = tables.operating_runs.select("run_id", "plant_id", "n_samples", "start_time_s", "end_time_s", "sampling_period_s")
    return run_digests(tables).join(runs, "run_id").select(
        "run_id", "plant_id", F.col("n_rows").alias("rows"), "n_samples", "start_time_s", "end_time_s", "sampling_period_s", "content_sha256"
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the data files under a directory; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return found.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))


def file_agreement(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files missing from disk, not listed, or of another size."""
    a = listed.select("path", F.col("length").alias("listed"))
    b = found.select("path", F.col("length").alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").when(differs("listed", "found"), "other size")
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of every file of a list. A file is streamed in pieces by the task that holds
    its path, so its size is bounded by nothing and its content is never a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for batch in batches:
            out = []
            for path in batch["path"]:
                uri = path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                filesystem, inner = pafs.FileSystem.from_uri(uri)
                digest, length = hashlib.sha256(), 0
                with filesystem.open_input_stream(inner) as stream:
                    while piece := stream.read(8 << 20):
                        digest.update(piece)
                        length += len(piece)
                out.append((path, length, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "length", "sha256"])

    return files.select("path").mapInPandas(run, "path string, length bigint, sha256 string")


def ledger_problems(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem) between ledger lines (file, kind, key, sha256) and fingerprints (file,
    sha256): missing, not in the ledger, altered, entered twice, key entered twice."""
    per_file = ledger.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("listed"), F.max("sha256").alias("_other"))
    both = per_file.join(found.select("file", F.col("sha256").alias("found")), "file", "full_outer")
    problems = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), "missing"), F.when(F.col("n").isNull(), "not in the ledger"), F.when(F.col("n") > 1, "entered twice"),
            F.when(F.col("found").isNotNull() & F.col("n").isNotNull() & (differs("listed", "found") | differs("_other", "found")), "altered"),
        )
    )
    keys = ledger.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).where(F.col("n") > 1)
    return both.select("file", F.explode(problems).alias("problem")).unionByName(keys.select("file", F.lit("key entered twice").alias("problem")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, kind string, key string, sha256 string").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def publish(tables: Tables, root: str, dataset_id: str) -> tuple[str, DataFrame]:
    """Publish a data set under ``root``. Returns the status and the comparison of its content
    with what is there. The manifest is the commit: written last, after the files were read
    back and their digests compared."""
    spark = tables.plants.sparkSession
    target = f"{root}/{dataset_id}"
    offered = recorded_runs(tables)
    offered = offered.with_(operating_runs=cut_lineage(offered.operating_runs))
    runs = cut_lineage(manifest_runs(offered))
    if exists(spark, f"{target}/{MANIFEST}/runs/_SUCCESS"):
        stored_runs, stored_tables = read_manifest(spark, root, dataset_id)
        differences = integrity.manifest_agreement(stored_runs, runs).select(F.col("run_id").alias("item"), "problem").unionByName(
            integrity.table_agreement(stored_tables, manifest_tables(offered)).select(F.col("table_name").alias("item"), F.lit("table differs").alias("problem"))
        )
        differences = cut_lineage(differences)
        return (PRESENT if differences.isEmpty() else CONFLICT), differences
    staging = f"{target}/data-{uuid.uuid4().hex}"
    for name, df in offered.items():
        written = conform(df, name)
        if name == "measurements":  # many files of many runs, rows of a run close together; a long run is many files
            written = written.repartitionByRange(tasks(spark, df.count()), "run_id", "sample_index").sortWithinPartitions("run_id", "sensor_id", "sample_index")
        written.write.mode("errorifexists").parquet(f"{staging}/{name}")
    back = Tables(**{name: spark.read.parquet(f"{staging}/{name}") for name in SCHEMAS})
    differences = integrity.manifest_agreement(runs, back.operating_runs).select(F.col("run_id").alias("item"), "problem").unionByName(
        run_digests(back).select("run_id", F.col("content_sha256").alias("found")).join(runs, "run_id", "full_outer")
        .where(differs("found", "content_sha256")).select(F.col("run_id").alias("item"), F.lit("read back differs").alias("problem"))
    )
    differences = cut_lineage(differences)
    if not differences.isEmpty():
        return CONFLICT, differences
    manifest_tables(offered).coalesce(1).write.mode("errorifexists").json(f"{target}/{MANIFEST}/tables")
    files = list_files(spark, staging).withColumn("table_name", F.element_at(F.split("path", "/"), -2))
    files.coalesce(1).write.mode("errorifexists").json(f"{target}/{MANIFEST}/files")
    runs.coalesce(1).write.mode("errorifexists").json(f"{target}/{MANIFEST}/runs")
    return CREATED, differences


def read_manifest(spark: SparkSession, root: str, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(runs, tables) of a published data set."""
    base = f"{root}/{dataset_id}/{MANIFEST}"
    runs = spark.read.schema(
        "run_id string, plant_id string, rows bigint, n_samples bigint, start_time_s double, end_time_s double, sampling_period_s double, content_sha256 string"
    ).json(f"{base}/runs")
    tables = spark.read.schema("table_name string, n_rows bigint, content_sha256 string").json(f"{base}/tables")
    return runs, tables


def manifest_files(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    return spark.read.schema("path string, length bigint, table_name string").json(f"{root}/{dataset_id}/{MANIFEST}/files")


def read_published(spark: SparkSession, root: str, dataset_id: str) -> Tables:
    """The tables of a data set, from the files its manifest lists. Only file names pass
    through the driver, as they do for any scan."""
    listed = manifest_files(spark, root, dataset_id)
    paths: dict[str, list[str]] = {}
    for row in listed.select("table_name", "path").toLocalIterator():
        paths.setdefault(row["table_name"], []).append(row["path"])
    return Tables(**{name: read_contract_table(spark, name, paths[name]) for name in SCHEMAS})


def incomplete_runs(aligned: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that may not be exported: a tick that is absent or not complete."""
    found = aligned.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("complete")).alias("broken"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi")
    )
    whole = (F.col("n") == F.col("n_samples")) & (F.col("broken") == 0) & (F.col("lo") == 0) & (F.col("hi") == F.col("n_samples") - 1)
    return runs.select("run_id", "n_samples").join(found, "run_id", "left").where(~F.coalesce(whole, F.lit(False))).select("run_id")


def export_rows(tables: Tables) -> DataFrame:
    """Aligned rows of the complete runs in export order of columns."""
    aligned = aligned_series(tables)
    runs = tables.operating_runs
    refused = incomplete_runs(aligned, runs)
    kept = runs.join(refused, "run_id", "left_anti").select("run_id", "dataset_id")
    return aligned.join(kept, "run_id").select(*EXPORT_COLUMNS)


def write_export(tables: Tables, path: str) -> None:
    """Rows ordered by (plant, run, tick), ranges of ticks to a file: a long run is several
    files in order, a short run shares one."""
    rows = export_rows(tables)
    ticks = tables.measurements.count() // len(STATES + INPUTS)  # an exported row has a reading of each channel
    rows.repartitionByRange(tasks(rows.sparkSession, ticks), "plant_id", "run_id", "sample_index").sortWithinPartitions("plant_id", "run_id", "sample_index").write.mode("errorifexists").parquet(path)


def sizes(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """Files and bytes on disk per artefact."""
    parts = [list_files(spark, p).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")).select(F.lit(n).alias("place"), "n_files", "bytes") for n, p in places.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def append(accepted: Tables, root: str, batch: str) -> None:
    """Accepted rows of one gate as a batch of the store: parents before children, and the
    batch listed last, which makes it visible. A batch that is listed is not written again. The rows of each table are
    counted while they are written and again from the written files; a batch whose counts differ is not listed."""
    spark = accepted.plants.sparkSession
    if exists(spark, f"{root}/batches/{batch}/_SUCCESS"):
        return
    counts = {}
    for name in ("plants", "process_parameters", "sensors", "operating_runs", "measurements"):
        counts[name] = write_counted(conform(getattr(accepted, name), name), f"{root}/{name}/{batch}")
    listed = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(counts["measurements"]).cast("long").alias("n_rows"))
    listed.write.mode("overwrite").json(f"{root}/batches/{batch}")


def write_counted(df: DataFrame, path: str) -> int:
    """Number of rows written as Parquet to ``path``, counted in the tasks that write them. The files are read back, where a count
    needs their footers only, and another number is an error."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(path)
    n, stored = seen.get.get("n_rows", 0), df.sparkSession.read.schema(df.schema).parquet(path).count()
    if n != stored:
        raise ValueError(f"{path}: {n} rows were written and {stored} are stored")
    return n


def read_store(spark: SparkSession, root: str) -> Tables:
    """The visible batches of a store; an empty store has empty tables."""
    if not exists(spark, f"{root}/batches"):
        return Tables(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})
    batches = [r["batch"] for r in spark.read.schema("batch string").option("recursiveFileLookup", True).json(f"{root}/batches").distinct().toLocalIterator()]
    return Tables(**{n: spark.read.parquet(*[f"{root}/{n}/{b}" for b in batches]) for n in SCHEMAS})
