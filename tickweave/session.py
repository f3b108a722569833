"""Session defaults for local use, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: What ``staged`` returned, as long as someone holds it.
_STAGED: WeakSet[DataFrame] = WeakSet()


def local_session(cpus: int = 8, app: str = "tickweave") -> SparkSession:
    """A session for tests and the local bench. On a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where none is set, as in a
    local test, a local master gets a temporary folder; a cluster has to name one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"{CHECKPOINT_KEY} is not set, and executors of {spark.sparkContext.master} do not share a local folder")
    made = tempfile.mkdtemp(prefix="spark-tickweave-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir() or made


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends there, later reads fetch only the columns they
    need, and its size is known to the planner. What is staged already is not copied again."""
    if df in _STAGED:
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    _STAGED.add(held)
    return held
