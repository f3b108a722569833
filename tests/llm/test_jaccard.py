import random

import numpy as np
import pyarrow as pa
import pytest

from tickweave.llm import jaccard


def shingles(text, n):
    own = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def by_hand(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[top(i)] = min(first.get(top(i), doc), doc)
    return sorted(((doc, len(s), first.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("seed", "n", "percent", "entries"), [(1, 5, 80, 1 << 19), (2, 5, 80, 300), (3, 2, 50, 200)])
def test_groups_as_by_hand(spark, seed, n, percent, entries):
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for base in range(12):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(3, 120))] + passage * (base % 2)
        for _ in range(draw.choice([1, 2, 9])):
            own = list(words)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = f"E{draw.randint(0, 99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (502, None), (503, ""), (504, "  "), (505, "one two"), (506, "One  two"), (None, rows[1][1]), (None, "alone here"), (7, "seven " * 9), (7, "seven " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.groups(docs, n, percent, entries).collect()), key=str) == by_hand(rows, n, percent)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(4, text, "a"), (2, text + " more", "b"), (9, None, "c"), (9, None, "c"), (None, text, "d")], "doc_id long, text string, label string")
    assert sorted(map(tuple, jaccard.first_of_groups(docs).select("doc_id", "label").collect()), key=str) == [(2, "b"), (9, "c"), (9, "c"), (None, "d")]
    assert jaccard.first_of_groups(docs.limit(0)).count() == 0


def _of_one_list(n):
    """Sets that share one element and nothing else."""
    draw = random.Random(5)
    sets = [sorted({1, *(draw.getrandbits(63) for _ in range(60))}) for _ in range(n)]
    return [(i, np.array(s, np.uint64)) for i, s in enumerate(sets)]


def test_pairs_of_one_element_grow_linearly():
    for n in (500, 5000):
        sets = _of_one_list(n)
        table = pa.table({
            "element": np.ones(n, np.int64), "set": np.arange(n), "size": np.array([len(s) for _, s in sets]), "at": np.zeros(n, np.int64), "grp": np.arange(n),
            "parity": pa.array([jaccard._parity(s) for _, s in sets], pa.binary()),
        })
        assert sum(b.num_rows for b in jaccard._pairs_of(table, 80)) <= n // 100


@pytest.mark.parametrize("outside", [3, 1024])
def test_a_list_of_many_groups_is_split_by_second_elements(spark, monkeypatch, outside):
    """Texts of which all share an opening, and pairs of which are near copies; lists of over 64 sets, split and whole."""
    monkeypatch.setattr(jaccard, "_OUTSIDE", outside)
    draw = random.Random(8)
    opening = [f"o{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = opening + [f"x{draw.randint(0, 10**6)}" for _ in range(draw.choice([4, 9, 15]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + ["end"] * draw.randint(0, 3)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.groups(docs).collect()), key=str) == by_hand(rows, 5, 80)


def test_sets_built_to_collide_under_polynomials_differ(spark):
    from test_substrings import thue_morse

    rows = [(1, thue_morse(11, "a", "b")), (2, thue_morse(11, "b", "a")), (3, thue_morse(11, "A", "B"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.groups(docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
