import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickweave.llm import packing

TEXTS = [
    "Plain words, don't they'll I'VE 12 345", None, "", "   \t\n", "naïve Ångström é a ́b  x y   z\x1cq", "ΣΑΣ ΟΔΟΣ straße İstanbul",
    "<|endoftext|> a<|startoftext|>b 's", "x" * 5000, "H\u0331h\u0331 J\u030c A\u0301, I\u0307 \u1e96 Word's, WORD... \u00c9T\u00c9!? \u0130stanbul. \u01c5 \u1fbc, a\u2026! \u00bd, x2, 3d. it's-it'S <|ENDOFTEXT|> \u212aelvin; \u00aa, \u0345a\u0345.",
    "漢字かな交じり文 🙂🙂", "word " * 4000, "one " * 2047, "one " * 2048, "long text, in slices " * 120_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_hold_the_ids_of_whole_texts(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "kept"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a b.c` string").withColumns({"ids": packing.F.lit(1), "row": packing.F.lit(2)})
    made = packing.pieces(docs).collect()
    assert made[0].asDict().keys() == {"doc_id", "a b.c", "row", "piece", "start", "length", "ids"}
    by_doc = {}
    for r in sorted((r for r in made if r.doc_id), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == r.piece * 2048 and r.length * 4 == len(r.ids) and r["a b.c"] == "kept"
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS[1:], 1):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(r.ids for r in by_doc[i]), "<u4").tolist() == ids
        assert [r.length for r in by_doc[i]] == [2048] * ((len(ids) - 1) // 2048) + [(len(ids) - 1) % 2048 + 1]
    assert sum(r.doc_id == 0 for r in made) == 2 and sum(r.doc_id is None for r in made) == 1
    assert not packing.pieces(docs.limit(0)).count()


def fewest(sizes, capacity):
    """By trying all ways to set pieces one after the other."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_bound_never_passes_the_fewest_sequences():
    rng, reached = random.Random(3), 0
    for _ in range(150):
        capacity = rng.choice([7, 10, 12, 24])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        least, u, whole = packing.bound(np.bincount(sizes, minlength=capacity + 1))
        best = fewest(sizes, capacity)
        assert least <= best
        reached += least == best
        for n in (1, 2, 3):  # what fits into a sequence is worth one at most
            for some in itertools.combinations(range(len(sizes)), n):
                assert sum(sizes[i] for i in some) > capacity or sum(u[sizes[i]] for i in some) <= whole
    assert reached > 130
    assert packing.bound(np.bincount([4] * 9, minlength=11))[0] == 5  # three of ten do not fit, though their volume says four


def check(rows, capacity):
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in taken.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([n for _, n in parts[:-1]], initial=0)) and sum(n for _, n in parts) <= capacity
    return len(taken)


@pytest.mark.parametrize("high", [300, 1500, 2048])
def test_groups_exchange_what_leaves_gaps(spark, high):
    rng = random.Random(high)
    sizes = [rng.randint(1, high) for _ in range(5000)]
    made = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    rows = packing.packed(made, group_rows=500).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(sizes))
    used, least = check(rows, 2048), packing.bound(packing.counts_by_length(made))[0]
    assert least <= used <= least * 1.01 + 1
    assert max(r.round for r in rows if r.length < 2048) >= 1
    alone = packing.best_fit(sorted(sizes, reverse=True), 2048)[0].max() + 1
    assert used <= alone * 1.005 + 1


def test_equal_lengths_are_certified_although_sequences_stay_unfilled(spark):
    made = spark.createDataFrame([(i // 3, 700) for i in range(3000)], "doc_id long, length long")
    rows = packing.packed(made, group_rows=400).collect()
    assert check(rows, 2048) == 1500 and all(r.certified for r in rows)


def test_clashing_names_and_refusals(spark):
    made = spark.createDataFrame([(1, 5, 9, "x"), (1, 5, 9, "x"), (2, 2048, 9, None)], "doc_id long, length long, offset long, `held b` string")
    rows = packing.packed(made).collect()
    assert sorted((r.doc_id, r.offset, r["held b"]) for r in rows if r.doc_id == 1) == [(1, 0, "x"), (1, 5, "x")] and check(rows, 2048) == 2
    assert not packing.packed(made.limit(0)).count()
    for wrong in (0, None, 2049):
        with pytest.raises(Exception, match="a length is not within"):
            packing.packed(spark.createDataFrame([(1, wrong)], "doc_id long, length long")).collect()


def test_sequences_and_query(spark, library):
    from tickweave.llm.registered import QUERIES, table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").select("doc_id", "text")
    full = packing.packed(packing.pieces(docs))
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(full).collect()}
    rows = QUERIES["op11_best_fit_packing"](spark, folder).collect()
    assert check(rows, 2048) == len(ids) <= packing.bound(packing.counts_by_length(packing.pieces(docs)))[0] + 1
    assert sum(map(len, ids.values())) == sum(r.length for r in rows)
    texts = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for r in full.collect():
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == texts[r.doc_id][r.start : r.start + r.length]
