import zlib

import pytest

from tickweave.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize(("module", "name", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_held_out_rows_are_told_apart(spark, module, name, least):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r["doc_id"]: r for r in module.judged(docs, module.fitted(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    kept = [(got[r["doc_id"]]["predicted"], r[name]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(kept) > 40 and sum(p == y for p, y in kept) / len(kept) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_no_labels(spark, module):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 3000), (3, "x " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = module.judged(docs, module.fitted(docs, given)).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
        assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert module.judged(docs.limit(0), module.fitted(docs, labels)).count() == 0


def test_interactions_are_learned():
    import numpy as np

    draw = np.random.default_rng(3)
    x = (draw.random((600, 4)) < 0.5).astype(np.float32)
    y = ((x[:, 0] + x[:, 1]) == 2).astype(np.float64)  # neither term alone tells
    machine = toxicity.learned(x, y, np.arange(4))
    row, term = np.nonzero(x)
    assert ((machine.score(row, term, len(x)) >= 0.5) == (y > 0)).mean() > 0.98


def test_pairs_of_terms_that_tell_nothing_alone(spark):
    import random

    draw = random.Random(6)
    some = [f"{a}{b}" for a in "bdfgklmnprst" for b in "aeiou"]
    rows = [(i, draw.sample(some, 20) + draw.choice([["group", "insult"], ["group"], ["insult"], []])) for i in range(2500)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    toxic = {i: int(("group" in w) == ("insult" in w)) for i, w in rows}
    got = toxicity.judged(docs, toxicity.fitted(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))).where("held_out").collect()
    assert len(got) > 400 and sum(r["predicted"] == toxic[r["doc_id"]] for r in got) / len(got) > 0.95


def test_flattened_trees_step_like_the_rules():
    import numpy as np

    draw = np.random.default_rng(4)
    x = draw.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(np.float64)
    trees = quality.grown(x, y)

    def walk(row):
        total = trees.start
        for c, limit, value in zip(trees.column, trees.limit, trees.value, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[c[at]] > limit[at])
            total += value[at - len(limit)]
        return 1 / (1 + np.exp(-total))

    scores = trees.score(x)
    assert np.allclose(scores, [walk(r) for r in x]) and ((scores >= 0.5) == (y > 0)).mean() > 0.97
