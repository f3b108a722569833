"""Queries of the operators in this subpackage and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, divergence, jaccard, lexical, packing, quality, substrings, suffixarrays, topk, toxicity, urlfilter, warc
from .oracles import SQL as SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.nearest(vectors.where("id % 50 = 0"), vectors)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.transcoded(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), joined=True))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarrays.digest(suffixarrays.repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.digest(packing.packed(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
