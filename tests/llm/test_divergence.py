import random
import re
from collections import Counter

import numpy as np
import pytest

from tickweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least, ranks):
    """From the definition: no runs, no blocks."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(lower)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in d[2])
        vocabulary = [t for t, n in held.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in docs if d[0] == lang}}
        for one, source, terms in docs:
            if one == lang:
                counts[source].update({t: terms[t] for t in vocabulary})
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in vocabulary) + 5 * len(vocabulary)) for t in vocabulary} for s, c in counts.items()}
        for s in counts.keys() - {None}:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in vocabulary), o.encode()) for o in counts if o not in (s, None)]
            terms = [(p[None][t] - p[s][t], t.encode()) for t in vocabulary if counts[s][t] and p[s][t] > p[None][t]]
            out |= {(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", sorted(terms)[:ranks])) for k, (v, item) in enumerate(sorted(found), 1)}
    return out


def test_matches_the_definition_in_blocks_of_any_size(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Él", "été", "Ünï", "日本", "z" * 300]
    rows = [(rng.choice(["en", "de"]), rng.choice(["a", "B", "é", None]), " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40)))) for _ in range(300)]
    rows += [("xx", "only", "few terms here"), (None, "a", None), (None, None, ""), ("en", "empty", "12 34"), rows[0], rows[0], ("de", "a", "Word, " * 300_000 + "y" * 2_500_000 + " wb a")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": divergence.F.lit("x"), "a b": divergence.F.lit(1)})
    want = expected(rows, 3, 5)
    for cells in (1 << 20, 64):
        assert {tuple(r) for r in divergence.audit(docs, 3, 5, cells).select("lang", "source", "part", "item", "value", "rank").collect()} == want
    assert not divergence.audit(docs.limit(0)).count()
    small = {tuple(r) for r in divergence.counted(docs, 10, 100).collect()}
    assert small == {tuple(r) for r in divergence.counted(docs).collect()}


def test_slices_cut_between_terms():
    text = ("ab cd1ef " * 50 + "x" * 100 + " é").encode()
    for limit in (1, 2, 7, 64, 1000):
        assert sum(divergence.terms_of(text, limit=limit), []) == text.translate(divergence.LETTERS).split()


def test_runs_are_few_and_sums_exact():
    rng = np.random.default_rng(2)
    columns = rng.poisson(0.3, (4000, 3))
    columns[0] = 3 * 10**12
    ordered, starts = divergence.runs(columns)
    assert len(starts[0]) < 12 and sum(map(len, starts)) < 200
    totals = columns.sum(0).tolist()
    p = [[1 + 10**9 * (c + 5) // (t + 5 * 4000) for c in columns[:, k].tolist()] for k, t in enumerate(totals)]
    for a, b, value in divergence.pair_sums(columns, totals, 4000):
        assert value == sum(abs(x - y) for x, y in zip(p[a], p[b], strict=True))


def test_shares_do_not_overflow(spark):
    n, total = 4 * 10**15, 9 * 10**15
    got = spark.range(1).select(divergence.share(*(divergence.F.lit(x) for x in (n, total, 7)))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 35)


@pytest.mark.parametrize("column", ["lang", "source"])
def test_no_column_decides_by_type(spark, column):
    docs = spark.createDataFrame([(1, 2, "a b"), (1, 3, "a")], "lang int, source int, text string")
    assert {tuple(r) for r in divergence.audit(docs, 1).select("lang", column, "part").collect()} >= {("1", "1" if column == "lang" else "2", "pair")}
