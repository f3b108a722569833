"""Small helpers: lineage cut in the shared folder, texts compressed for a shuffle."""

from __future__ import annotations

import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tickweave.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col(quoted(column))


def quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def shape(*fields: StructField | str) -> StructType:
    """A schema of fields and of lists of fields in Spark's notation."""
    return StructType([f for some in fields for f in ([some] if isinstance(some, StructField) else StructType.fromDDL(some).fields)])


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its text, the last column, compressed into ``packed``; half of what the shuffle's own codec leaves."""
    def squeeze(batches):
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            packed = [None if t is None else press(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*batch.schema.names[:-1], "packed"])

    return df.mapInArrow(squeeze, shape(*df.schema.fields[:-1], "packed binary"))


def unsqueezed(packed: bytes | None) -> bytes | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed)
