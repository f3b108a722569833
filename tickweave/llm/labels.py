"""Labelled documents to learn from, the same for the classifiers here.

A document is held out of learning where crc32 of its doc_id as text is divisible by ``FOLDS``. Learning takes at most
``SAMPLE`` documents, those of the least hash of doc_id, so what the driver holds is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, SAMPLE = 5, 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """False for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, name: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label 0 or 1) of at most ``sample`` labelled documents that are not held out. Null labels and ids and
    null texts take no part; of several labels of a document the mean counts. The ids are few enough to broadcast."""
    means = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(name) >= 0.5).cast("int").alias("label"))
    few = means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
