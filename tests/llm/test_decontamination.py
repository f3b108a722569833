import hashlib
import random
import re

import pytest

from tickweave.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, n):
    patterns = {}
    for item, text in items:
        own = words(text) if text is not None and item is not None else []
        for i in range(max(1, len(own) - n + 1) if own else 0):
            patterns.setdefault(tuple(own[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for p, who in patterns.items():
            for i in range(len(own) - len(p) + 1):
                if tuple(own[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names |= who
        out.append((doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "n", "size"), [(1, 10, 16 << 20), (2, 3, 16 << 20), (3, 4, 60)])
def test_hits_as_by_hand(spark, seed, n, size):
    draw = random.Random(seed)
    some = lambda k: " ".join(draw.choices("Aa b, c-d É 9 x".split(), k=k))
    items = [(i, some(draw.randint(0, 14))) for i in range(12)] + [(3, "a b"), (3, "a b"), (90, None), (None, "c d"), (91, "...")]
    docs = [(i, some(draw.randint(0, 80))) for i in range(60)] + [(1, items[0][1] * 3), (1, items[0][1] * 3), (None, "a b"), (70, None), (71, ""), (72, "b " * 4000)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.digest(d.occurrences(left, right, n, size)).collect()), key=str) == by_hand(docs, items, n)


def test_clean_keeps_columns_and_rows_without_passages(spark):
    docs = spark.createDataFrame([(1, "one two three", "p"), (2, None, "q"), (2, None, "q"), (3, "zero one two three four", "r")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(5, "TWO-three four")], "item_id long, text string")
    assert sorted(map(tuple, d.clean(docs, items).collect()), key=str) == [(1, "one two three", "p"), (2, None, "q"), (2, None, "q")]
    assert d.clean(docs, items.limit(0)).count() == 4 and d.clean(docs.limit(0), items).count() == 0
