"""Repeated word sequences, by prefix-partitioned suffix trees.

A suffix begins at each word of a document. Its variable-length prefix names the subtree it belongs to: one word, or
two, four or the whole window where shorter prefixes are shared by more suffixes than a group may hold (all suffixes are
counted, in tables of fixed size). Prefixes are dealt to groups of bounded memory. Within a group the suffixes are
sorted by their first ``window`` words (by a 64-bit hash of them): the tree is cut at that depth, below which the rule looks at nothing. Each
run of equals is a node at depth ``window``; one with two leaves is a deep internal node, so a repeat. Leaves whose
node also has a leaf of a smaller doc_id are reported, and consecutive ones make up the maximal repeats of a document.

A repeat of a third of all rows doesn't fill a group: leaves of a node that meet in one slice of the scan are
settled there, and only the leaves of the slice's smallest doc_id travel on.

Nulls: a null text has no words; a row with a null doc_id is neither compared nor changed. Rows that share a doc_id
don't remove from each other; each is answered. Empty texts and tables give empty answers. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places
from .spark_tools import named, quoted, shape, squeezed, unsqueezed, written
from .textbytes import SPACED, U, Powers, mixed, slices, utf8, words

WINDOW = 13
#: Suffixes of a group and bytes of text of a block, which fit a task's memory.
GROUP_SUFFIXES, BLOCK_BYTES = 1 << 21, 8 << 20
_DEPTHS, _CELLS = (1, 2, 4), 1 << 16


def _prefixes(found, first: np.ndarray, sums: np.ndarray, powers: Powers, window: int) -> list[np.ndarray]:
    return [powers.hashes(sums, first, first + min(d, window)) for d in _DEPTHS]


def _counts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    powers, size = Powers(), np.zeros(2, np.int64)
    cells = np.zeros((len(_DEPTHS), _CELLS), np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        size[1] += offsets[-1] - offsets[0]
        for a, b in slices(offsets):
            found = words(data, offsets[a : b + 1], SPACED, powers)
            first, _ = found.windows(window, powers)
            size[0] += len(first)
            sums = powers.sums(found.hashes)
            for row, key in zip(cells, _prefixes(found, first, sums, powers, window), strict=True):
                row += np.bincount((key >> U(48)).astype(np.int64), minlength=_CELLS)
    parts = [(-1, size.tobytes()), *((i, c.tobytes()) for i, c in enumerate(np.split(cells.ravel(), 16)) if c.any())]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["part", "sums"])


def _added(key, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def prefix_counts(texts: DataFrame, window: int) -> tuple[int, int, np.ndarray]:
    """Number of suffixes, bytes of text, and how many suffixes fall to each cell of prefixes; 1.5 MB at any size."""
    counted = texts.select("text").mapInArrow(lambda b: _counts(b, window), "part int, sums binary")
    got = {r.part: np.frombuffer(r.sums, np.int64) for r in counted.groupBy("part").applyInArrow(lambda k, t: _added(k, t), "part int, sums binary").collect()}
    cells = np.concatenate([got.get(i, np.zeros(len(_DEPTHS) * _CELLS // 16, np.int64)) for i in range(16)])
    suffixes, size = got.get(-1, np.zeros(2, np.int64)).tolist()
    return suffixes, size, cells.reshape(len(_DEPTHS), _CELLS)


def _leaves(batches: Iterator[pa.RecordBatch], window: int, heavy: np.ndarray, groups: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Suffixes by group, and places that the slice itself settles, by block."""
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets):
            found = words(data, offsets[a : b + 1], SPACED, powers)
            first, node = found.windows(window, powers)
            if not len(first):
                continue
            rows = found.row_of()[first]
            at, doc = first - found.rows[rows], ids[a:b][rows]
            covered = _later(node, doc)
            sums = powers.sums(found.hashes)
            group, done = node.copy(), np.zeros(len(node), bool)
            for key, over in zip(_prefixes(found, first, sums, powers, window), heavy, strict=True):
                light = ~done & ~over[(key >> U(48)).astype(np.int64)]
                group[light] = key[light]
                done |= light
            group = (mixed(group) % U(groups)).astype(np.int64)
            out = []
            here = np.flatnonzero(covered)
            if len(here):
                out += [(p % groups, p, blob) for p, blob in places.dealt(ids[a:b], tags[a:b], rows[here], at[here], None, tags[a:b][rows[here]] % blocks)]
            here = np.flatnonzero(~covered)
            out += [(g, -1, blob) for g, blob in places.dealt(ids[a:b], tags[a:b], rows[here], at[here], node[here], group[here])]
            yield _batch(out)


def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["part", "block", "blob"])


def _later(node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a leaf's node has a leaf of a smaller document."""
    order = np.argsort(node)
    ends = node[order]
    heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
    smallest = np.minimum.reduceat(doc[order], heads)
    out = np.zeros(len(node), bool)
    out[order] = doc[order] > np.repeat(smallest, np.diff(np.append(heads, len(node))))
    return out


def _subtrees(table: pa.Table, blocks: int) -> pa.Table:
    """Deep nodes of a group and the leaves that they report."""
    own = np.array(table["block"].to_numpy(), np.int64)
    blobs = table["blob"].to_pylist()
    out = [(0, int(k), b) for k, b in zip(own, blobs, strict=True) if k >= 0]
    got = places.joined([b for k, b in zip(own, blobs, strict=True) if k < 0])
    del blobs
    if len(got.at):
        rows = np.repeat(np.arange(len(got.ids)), got.counts)
        here = np.flatnonzero(_later(got.keys, got.ids[rows]))
        out += [(0, k, b) for k, b in places.dealt(got.ids, got.tags, rows[here], got.at[here], None, got.tags[rows[here]] % blocks)]
    return pa.table({"block": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})


def _kept(left: pa.Table, right: pa.Table, window: int, joined: bool) -> pa.Table:
    """Counts and the kept words of each document of a block."""
    got = places.joined(right["blob"].to_pylist())
    ends = np.cumsum(got.counts)
    lists: dict[tuple[int, int], list[np.ndarray]] = {}
    for key, a, b in zip(zip(got.ids.tolist(), got.tags.tolist(), strict=True), (ends - got.counts).tolist(), ends.tolist(), strict=True):
        lists.setdefault(key, []).append(got.at[a:b])
    total, removed, kept = [], [], []
    keys = left["row"].combine_chunks().field("doc_id").cast(pa.int64()).to_pylist()
    for key, tag, packed in zip(keys, left["tag"].to_pylist(), left["packed"].to_pylist(), strict=True):
        text = unsqueezed(packed)
        own = text.split() if text else []
        starts = lists.get((key, tag))
        total.append(len(own))
        if starts:
            edge = np.zeros(len(own) + 1, np.int64)
            starts = np.concatenate(starts)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            stay = np.cumsum(edge[:-1]) == 0
            removed.append(len(own) - int(stay.sum()))
            kept.append(b" ".join(compress(own, stay.tolist())).decode())
        else:
            removed.append(0)
            kept.append(b" ".join(own).decode() if joined else text and text.decode())
    return pa.table({"row": left["row"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(kept, pa.string())})


def repeats_removed(docs: DataFrame, window: int = WINDOW, joined: bool = False, group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: row (a struct of its columns but the text), n_words, n_removed and text, the kept words joined by a space.

    A text that loses nothing stays as it is, or is joined likewise if ``joined``. Two scans, a shuffle of nine bytes for
    each suffix, and one of the compressed texts to meet the places found in them.
    """
    tag = F.xxhash64("doc_id", "text", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).bitwiseAND(0xFFFFFFFF).alias("tag")
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tag, "text")
    suffixes, size, cells = prefix_counts(known, window)
    groups, blocks = -(-suffixes // group_suffixes) or 1, -(-size // block_bytes) or 1
    heavy = cells > max(1, group_suffixes // 4)
    leaves = known.mapInArrow(lambda b: _leaves(b, window, heavy, groups, blocks), "part int, block int, blob binary")
    found = leaves.repartitionById(groups, "part").groupBy("part").applyInArrow(lambda t: _subtrees(t, blocks), "block int, blob binary")
    found = written(found, "repeats")
    whole = squeezed(docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"), tag, "text")).withColumn("block", F.pmod("tag", F.lit(blocks)).cast("int"))
    schema = shape(whole.schema["row"], "n_words long, n_removed long, text string")
    sides = whole.repartitionById(blocks, "block").groupBy("block"), found.repartitionById(blocks, "block").groupBy("block")
    return sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: _kept(a, b, window, joined), schema)


def digest(found: DataFrame) -> DataFrame:
    """Of what ``repeats_removed`` returns with ``joined``."""
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts; texts without repeats, null ones too, stay as they are."""
    found = repeats_removed(docs, window)
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.{quoted(c)}") for c in docs.columns))
