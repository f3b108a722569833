import random
import re

import pytest

from tickweave.llm import substrings


def removed_by_hand(rows, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), own in zip(rows, split, strict=True):
        if doc is not None:
            for i in range(len(own) - n + 1):
                key = tuple(own[i : i + n])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), own in zip(rows, split, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(own) - n + 1):
                if first[tuple(own[i : i + n])] < doc:
                    gone.update(range(i, i + n))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    some = [" ".join(draw.choices("a b c dd é ñandú".split(), k=draw.randint(0, 60))) for _ in range(20)]
    rows = []
    for i in range(120):
        parts = draw.choices(some, k=draw.randint(0, 3)) + [" ".join(f"w{draw.randint(0, 900)}" for _ in range(draw.randint(0, 30)))]
        rows.append((i if i % 40 else i // 40, draw.choice(["  ", "\n", " \t"]).join(parts)))
    rows += [(5, "same same"), (5, "same same"), (7, None), (None, some[0] * 3), (None, None), (8, ""), (9, " \n "), (200, "x " * 5000), (201, "x " * 900), (202, "z\xa0z " * 40), (203, "z\xa0z " * 40)]
    return rows


@pytest.mark.parametrize(("seed", "group", "block", "n"), [(1, 1 << 21, 8 << 20, 13), (2, 700, 3000, 13), (3, 300, 2000, 3)])
def test_removed_words_as_by_hand(spark, seed, group, block, n):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.repeats_removed(docs, n, True, group, block).selectExpr("row.doc_id", "n_words", "n_removed", "coalesce(text, '')")
    assert sorted(map(tuple, got.collect()), key=str) == removed_by_hand(rows, n)


def test_groups_are_placed_without_another_shuffle(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    plan = substrings.repeats_removed(docs, 13, False, 300, 2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_clean_keeps_other_columns_and_untouched_texts(spark):
    text = "one two three four five six seven eight nine ten eleven twelve  thirteen"
    docs = spark.createDataFrame([(1, text, "a"), (2, "x " + text, None), (3, None, "c")], "doc_id long, text string, packed string").select("packed", "text", "doc_id")
    assert sorted(map(tuple, substrings.clean(docs).collect()), key=str) == [("a", text, 1), ("c", None, 3), (None, "x", 2)]
    assert substrings.clean(docs.limit(0)).columns == docs.columns
    assert substrings.clean(docs.limit(0)).count() == 0


def thue_morse(k, a, b):
    out = a
    for _ in range(k):
        out += out.translate(str.maketrans(a + b, b + a))
    return out


def test_words_built_to_collide_under_polynomials_differ(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{thue_morse(11, 'a', 'b')} {rest}"), (2, f"{thue_morse(11, 'b', 'a')} {rest}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substrings.repeats_removed(docs).collect()] == [0, 0]


def test_windows_built_to_collide_under_polynomials_differ(spark):
    rows = [(i + 1, " ".join(thue_morse(11, a, b))) for i, (a, b) in enumerate(("ab", "ba"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substrings.repeats_removed(docs, 2048).collect()] == [0, 0]
