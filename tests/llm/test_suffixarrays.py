import random
from collections import Counter

import numpy as np
import pytest

from tickweave.llm import places, suffixarrays
from tickweave.llm.textbytes import Powers


def removed_by_hand(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((doc, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    some = ["".join(draw.choices("ab cñ\0", k=draw.randint(0, 500))) for _ in range(15)]
    rows = [(i, "".join([*draw.choices(some, k=draw.randint(0, 3)), "".join(draw.choices("abcdefgh é", k=draw.randint(0, 300)))])) for i in range(90)]
    for i in range(30):  # near copies
        text = list(rows[draw.randint(0, 60)][1])
        for _ in range(min(len(text), draw.randint(1, 3))):
            text[draw.randrange(len(text))] = "Z"
        rows.append((100 + i, "".join(text)))
    return rows + [(5, "same " * 60), (5, "same " * 60), (7, None), (None, some[0] * 2), (None, None), (8, ""), (300, "x" * 3000), (301, "yz" * 700)]


@pytest.mark.parametrize(("seed", "runs", "group", "block", "n"), [(1, 1 << 19, 2 << 20, 8 << 20, 200), (2, 100, 5000, 4000, 200), (3, 50, 3000, 4000, 40)])
def test_removed_bytes_as_by_hand(spark, seed, runs, group, block, n):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixarrays.repeats_removed(docs, n, runs, group, block).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=str) == removed_by_hand(rows, n)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    import numpy as np

    from tickweave.llm.textbytes import Powers

    text = np.frombuffer(random.Random(1).randbytes(50_000), np.uint8)
    whole = suffixarrays.runs(text, np.array([0, len(text)]), Powers(), 200)
    monkeypatch.setattr(suffixarrays, "SLICE_BYTES", 7001)
    cut = suffixarrays.runs(text, np.array([0, len(text)]), Powers(), 200)
    windows = [np.concatenate([np.arange(a, a + n) for a, n in zip(r[1], r[2], strict=True)]) for r in (whole, cut)]
    assert (windows[0] == np.arange(len(text) - 199)).all() and (windows[1] == windows[0]).all()


@pytest.mark.parametrize("alone", [0, 60, 300])
def test_one_phrase_before_many_texts_is_split(spark, monkeypatch, alone):
    draw = random.Random(5)
    phrase, tails = "".join(draw.choices("abcdefgh é", k=160)), ["".join(draw.choices("abcdefgh é", k=150)) for _ in range(150)]
    rows = [(i, "".join([*draw.choices("xyzé", k=20), phrase, tails[i % 150], *draw.choices("abcdefgh é", k=100)])) for i in range(300)]
    kinds = "doc_id long, text string"
    docs = spark.createDataFrame(rows[alone:], kinds).coalesce(1).union(spark.createDataFrame(rows[:alone], kinds).repartition(30))
    held, written = {}, suffixarrays.written
    monkeypatch.setattr(suffixarrays, "written", lambda df, name: held.setdefault(name, written(df, name)))
    got = suffixarrays.repeats_removed(docs, 200, 1 << 19, 20_000).selectExpr("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted(((*r[:4], bytes(r[4])) for r in got.collect()), key=str) == removed_by_hand(rows, 200)
    anchors = {r["tag"]: suffixarrays.runs(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"].encode())]), Powers(), 200)[3] for r in docs.selectExpr("xxhash64(doc_id, text) as tag", "text").collect()}
    asked = places.joined([r["blob"] for r in held["runs"].where(f"kind = {suffixarrays._ASKED}").collect()])
    pieces = Counter(anchors[tag][at] for tag, at in zip(asked.each(asked.tags).tolist(), asked.at.tolist(), strict=True))
    assert max(pieces.values(), default=0) * 285 <= 20_000


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixarrays.digest(suffixarrays.repeats_removed(docs)).count() == 0


def test_pieces_built_to_collide_under_polynomials_differ(spark):
    from test_substrings import thue_morse

    rows = [(1, thue_morse(11, "a", "b")), (2, thue_morse(11, "b", "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in suffixarrays.repeats_removed(docs, 2048).collect()] == [0, 0]


@pytest.mark.parametrize("n", [8, 25, 40, 200])
def test_windows_of_pieces_with_zero_bytes_are_classed_as_by_hand(n):
    draw = random.Random(n)
    for kinds in (b"\0", b"\0a", b"\0ab\xff", bytes(range(256))) * 10:
        some = bytes(draw.choices(kinds, k=draw.randint(1, 300)))
        pieces = [some[draw.randrange(len(some)) :] + bytes(draw.choices(kinds, k=n)) + some * draw.randint(0, 3) for _ in range(draw.randint(1, 8))]
        text, ends = b"\0".join(pieces) + b"\0", np.cumsum([len(p) + 1 for p in pieces])
        order, same = suffixarrays.common_prefixes(np.frombuffer(text, np.uint8), n)
        assert sorted(order.tolist()) == list(range(len(text)))
        classes = np.empty(len(text), np.int64)
        classes[order] = np.cumsum(~same)
        pairs = {(text[i : i + n], int(classes[i])) for end, p in zip(ends.tolist(), pieces, strict=True) for i in range(end - len(p) - 1, end - n)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({c for _, c in pairs})


def test_runs_of_many_texts_are_found_together(monkeypatch):
    draw, asked, runs = random.Random(7), [], suffixarrays.runs
    texts = [bytes(draw.choices(b"ab c\0", k=draw.choice([0, 199, 200, 450, 3000, 9000]))) for _ in range(60)]
    tags, wanted = [i // 2 for i in range(60)], {i for i in range(30) if i % 3}
    monkeypatch.setattr("tickweave.llm.textbytes.slices.__defaults__", (5000,))
    monkeypatch.setattr(suffixarrays, "runs", lambda *a: asked.append(1) or runs(*a))
    got = list(suffixarrays._runs_of(tags, texts, wanted, Powers(), 200))
    assert [g[0] for g in got] == [i for i in range(60) if tags[i] in wanted] and len(asked) < len(got)
    for i, *found in got:
        alone = runs(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]), Powers(), 200)[1:]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(found, alone, strict=True))
