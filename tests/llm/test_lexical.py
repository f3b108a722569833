import math
import random
import re
from collections import Counter

import pytest

from tickweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, items, k):
    """Each document against each item, from the definition."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    total, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in {i for i, _ in items if i is not None}:
        terms = {t for i, text in items if i == item for t in TERM.findall((text or "").translate(LOWER))}
        w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for i, bag in bags:
            m = 50 + 50 * bag.total() * total // max(1, length)
            scores.append((-sum(w[t] * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms & bag.keys()), i is None, i))
        out += [(item, n, i, -s) for n, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"W{i}" for i in range(80)] + ["É1", "naïve", "日本"]
    docs = [(rng.randint(0, 10**12), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(300)]
    docs += [(n, "same w1 w2 text") for n in range(40, 0, -1)] + [(7, "same w1 w2 text")] * 3 + [(7_000, "same w1 w2 other")] * 2
    docs += [(1_000_001, None), (1_000_002, ""), (1_000_003, ", ".join(["w3 w4 filler"] * 120_000) + "x" * 2_500_000 + " w5"), (1_000_004, "W3")]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for n in range(30)] + [(3, "w1 W1 naïve"), (None, "w1"), (99, None), (98, ""), (97, "never seen"), (96, "same w1")]
    return docs, items


@pytest.mark.parametrize("k, pass_bytes", [(50, 1 << 22), (3, 1 << 22), (5, 300)])
def test_matches_the_definition(spark, rows, k, pass_bytes):
    docs, items = rows
    given = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"vector": lexical.F.lit(1), "item_id": lexical.F.lit(2), "a b": lexical.F.lit(3)})
    made = lexical.ranked(given, spark.createDataFrame(items, "item_id int, text string"), k, pass_bytes)
    assert sorted(map(tuple, made.collect()), key=str) == expected(docs, items, k)


def test_nulls_come_last_and_empty_tables(spark):
    docs = [(None, "a b"), (5, "a b"), (4, "a b"), (3, "c")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x", "A")], "item_id string, text string")
    assert [r.doc_id for r in lexical.ranked(frame, items).orderBy("rank").collect()] == [4, 5, None]
    assert not lexical.ranked(frame.limit(0), items).count() and not lexical.ranked(frame, items.limit(0)).count()
    assert lexical.ranked(frame, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_classes_join_documents_that_no_item_can_tell_apart(spark):
    docs = spark.createDataFrame([(i, "a b b") for i in range(2000)] + [(5000, "b c b a")[:2], (6000, "a z b b x y")], "doc_id long, text string")
    items = lexical.numbered([("1", ["a", "b"])])
    made = lexical.classes(lexical.vectors(docs, items), 2002, 6010).collect()
    assert sorted(len(r.members) for r in made) == [1, 1, 50] and sorted(r.members for r in made)[0] == list(range(50))


def test_kept_while_pruning_as_when_sorted_at_once():
    rng = lexical.np.random.default_rng(4)
    scores = rng.integers(0, 6, (500, 7))
    best = lexical.Best(7, 5)
    for at in range(0, 500, 20):
        best.add(scores[at : at + 20], [[int(i)] for i in range(at, at + 20)])
    best.prune()
    for item in range(7):
        got = sorted(zip((-best.score[best.item == item]).tolist(), best.first[best.item == item].tolist(), strict=True))
        assert got == sorted((-s, i) for i, s in enumerate(scores[:, item].tolist()) if s)[:5]
