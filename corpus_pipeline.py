"""A corpus pipeline of five stages over the table of documents; each works on all that its predecessor kept.

The quality classifier is learned from the labels of the documents it judges. The last stage returns the columns of documents
with ``n_tokens``, ``ids`` and ``decoded``, which stand in place of columns of these names (in any case) that documents bring.
Other columns may have any name and go through all stages unchanged. Nulls, empty texts and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import bpe, decontamination, jaccard, quality, substrings
from tickweave.llm.registered import table
from tickweave.llm.spark_tools import named, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.kept(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return jaccard.first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a document of a smaller doc_id has, too; one that loses all its words stays with an empty text."""
    return substrings.clean(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding_and_decoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens, their ids and what the ids decode to."""
    own = [named(c) for c in docs.columns if c.lower() not in ("n_tokens", "ids", "decoded")]
    made = bpe.transcoded(docs.select(F.struct(*own).alias("doc"), "text"))
    return made.select("row.doc.*", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding_and_decoding),
]
#: No SQL expresses the classifier or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
