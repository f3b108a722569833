import math
import random

import numpy as np
import pytest

from tickweave.llm import topk


def by_hand(rows, asked, k, scale):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if asked(i)}):
        own = min(v for i, v in sound if i == q)
        best = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=True)))), i) for i, v in sound if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "scale"), [(4096, 4096, 256.0), (7, 3, 256.0), (5, 4, 2.0**40)])
def test_the_nearest_as_by_hand(spark, shard, block, scale):
    draw = random.Random(shard)
    rows = [(i, [draw.choice([-1.0, -0.25, 0.0, 0.3, 0.5]) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5]) for i in range(20)] + [(10, [0.1, 0.2, 0.3]), (30, [1.0]), (31, [2.0]), (200, None), (None, [1.0, 1.0, 1.0]), (201, [float("nan"), 0.0, 0.0]), (202, [None, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0])]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3), "vec_id", "v")
    got = topk.nearest(vectors.where("id % 10 = 0"), vectors, scale=scale, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, lambda i: i % 10 == 0, 5, scale)


def test_ties_go_to_the_smaller_id_and_few_rows_are_enough():
    scores, ids = np.array([[3, 5, 5, 5, 1], [2, 2, 2, 2, 2]]), np.array([10, 11, 12, 13, 14])
    best, names = topk.selected(scores, ids, 3)
    assert best.tolist() == [[5, 5, 5], [2, 2, 2]] and names.tolist() == [[11, 12, 13], [10, 11, 12]]
    assert topk.selected(scores[:, :2], ids[:2], 5)[1].tolist() == [[11, 10], [10, 11]]


def test_products_beyond_doubles_are_whole_numbers():
    left, right = np.array([[2.0**30, 1.0]]), np.array([[2.0**31, 1.0], [2.0**40, 3.0]])
    assert topk._products(left, right).tolist() == [[2**61 + 1, min(2**70 + 3, 2**63 - 1)]]


def test_no_rows(spark):
    vectors = topk.usable(spark.createDataFrame([], "vec_id long, v array<float>"), "vec_id", "v")
    assert topk.nearest(vectors, vectors).count() == 0
