"""Columns of any name beside doc_id and text, through every operator that keeps them and through the pipeline's stages."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickweave.llm import bpe, decontamination, jaccard, quality, substrings, suffixarrays, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402

NAMES = ["a b", "a-b", "a:b", "a.b", "tick`", "row", "_own", "tag", "block", "part", "label", "component_id", "score", "packed", "doc", "n_words"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text + " more"), (3, "other words"), (4, None), (5, "")]
    return spark.createDataFrame([(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in rows], ", ".join(["doc_id long", "text string", *(f"`{n.replace('`', '``')}` string" for n in NAMES)]))


@pytest.fixture(scope="module")
def learned(spark):
    given, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fitted(given, labels), toxicity.fitted(given, labels)


def cells(df, prefix=""):
    return sorted((r[0], *r[1:]) for r in df.select(f"{prefix}doc_id", *(F.col(f"{prefix}`{n.replace('`', '``')}`") for n in NAMES)).collect())


def rows(*ids):
    return [(i, *(f"{n}{i}" for n in NAMES)) for i in ids]


def test_scores(docs, learned):
    assert cells(quality.scored(docs, learned[0]), "row.") == cells(toxicity.scored(docs, learned[1]), "row.") == rows(1, 2, 3, 4, 5)
    kept = quality.kept(docs, learned[0])
    assert kept.columns == docs.columns and set(cells(kept)) <= set(rows(1, 2, 3, 4, 5))


def test_texts(spark, docs):
    assert cells(bpe.transcoded(docs), "row.") == cells(bpe.decoded(bpe.encoded(docs)), "row.") == rows(1, 2, 3, 4, 5)
    assert cells(suffixarrays.repeats_removed(docs), "row.") == rows(1, 2, 3, 4, 5)
    assert cells(substrings.clean(docs)) == rows(1, 2, 3, 4, 5) and substrings.clean(docs).columns == docs.columns
    one = jaccard.first_of_groups(docs)
    assert cells(one) == rows(1, 3, 4, 5) and one.columns == docs.columns
    benchmark = spark.createDataFrame([("i", "other words"), ("j", "nothing of this")], "item_id string, text string")
    for most in (1 << 20, 10):
        assert sorted(r.doc_id for r in decontamination.occurrences(docs, benchmark, pass_bytes=most).where(F.size("items") > 0).collect()) == [3]
    clean = decontamination.clean(docs, benchmark)
    assert cells(clean) == rows(1, 2, 4, 5) and clean.columns == docs.columns


def test_stages(spark, docs):
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100")
    own = given.select(*given.columns, *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES), F.lit(7).alias("n_tokens"), F.lit("x").alias("IDS"))
    at = own
    for k, (_, stage) in enumerate(pipeline.STAGES):
        at = pipeline.written(stage(spark, at, SF), f"columns-{k}")
        assert k == 4 or at.columns == own.columns
    assert at.columns == [*own.columns[:-2], "n_tokens", "ids", "decoded"]
    assert cells(at) == rows(*sorted(r.doc_id for r in at.select("doc_id").collect()))
