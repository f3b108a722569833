"""Stages against plain Python on the same rows; the classifier's own decisions are taken as given."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipeline  # noqa: E402
from test_substrings import removed_by_hand  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = pipeline.written(stage(spark, docs, SF), f"test-{k}")
        out.append(docs.toPandas().sort_values("doc_id"))
    return out


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def test_columns_and_rows_go_down(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(list(k.columns) == docs.columns for k in kept[:4])
    counts = [docs.count(), *(len(k) for k in kept)]
    assert counts == sorted(counts, reverse=True) and counts[1] > 0.7 * counts[0] and counts[2] < counts[1]


def test_one_of_each_group(kept):
    rows = [(r.doc_id, shingles(r.text)) for r in kept[0].itertuples()]
    first = {doc: doc for doc, _ in rows}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(first[a], first[b])
            changed |= first[a] != low or first[b] != low
            first[a] = first[b] = low
    assert kept[1].doc_id.tolist() == sorted(d for d, f in first.items() if d == f)


def test_repeats_are_gone(kept):
    by_hand = {d: t if n else None for d, _, n, t in removed_by_hand([(r.doc_id, r.text) for r in kept[1].itertuples()], 13)}
    before = dict(zip(kept[1].doc_id, kept[1].text, strict=True))
    assert {r.doc_id: r.text for r in kept[2].itertuples()} == {d: before[d] if t is None else t for d, t in by_hand.items()}


def test_no_benchmark_passage_stays(spark, kept):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = {tuple(w[i : i + 10]) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for w in [low(t)] for i in range(max(1, len(w) - 9))}
    clean = [r.doc_id for r in kept[2].itertuples() for w in [low(r.text)] if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))]
    assert kept[3].doc_id.tolist() == clean


def test_tokens_as_the_library_makes_them(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in kept[4].itertuples():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
