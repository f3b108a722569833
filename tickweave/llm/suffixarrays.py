"""Repeated byte strings, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Candidates. The 32-byte string of the least hash in each window of ``length`` bytes is the window's anchor; equal windows have
equal anchors. Consecutive windows of one anchor make a run, and the run's bytes a piece. Runs are dealt by anchor with a
digest of their piece: equal pieces repeat in whole; pieces that share their anchor, but differ, are compared.

Comparison. The differing pieces of a group of anchors are joined, sorted into a suffix array as deep as ``length`` and
transformed. From the intervals of strings of a quarter of ``length`` on, breadth-first backward extension makes those of strings one byte
longer at a time. An interval whose end no shorter string has marked proves the common prefix there to be as long as the string was, so
common prefixes come by increasing value, and the search ends at ``length``: what is still unmarked is at least as long.

Pieces that many documents have travel once for each slice of the scan. An anchor that very many different texts surround is
split: equal windows have their anchor in the same place, so the windows of its pieces are dealt by their own hashes
instead, those that are equal within a block once. A slice with more than ``SLICE_KINDS`` pieces of an anchor asks for that
itself and sends one of them, which tells the others; so no group grows with the texts that one anchor is in.

Nulls: a null text is empty and keeps no bytes; a null doc_id is answered like others. Rows that share a doc_id are
documents of their own. Texts shorter than ``length`` lose nothing, an empty table gives no rows, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places
from .spark_tools import named, shape, squeezed, unsqueezed, written
from .textbytes import SLICE_BYTES, U, Powers, mixed, slices, utf8

LENGTH = 200
GROUP_RUNS, GROUP_BYTES, BLOCK_BYTES = 1 << 19, 2 << 20, 8 << 20
SLICE_KINDS, BLOCK_WINDOWS = 16, 1 << 19
_ANCHOR, _PLACE_BITS = 32, 22
_WHOLE, _ASKED, _STARTS, _SPLIT = 0, 1, 2, 3


def runs(data: np.ndarray, offsets: np.ndarray, powers: Powers, length: int) -> tuple[np.ndarray, ...]:
    """Of some rows: row, first window and number of windows of each run (places in ``data``), hash of its anchor, digest of its piece."""
    out, at, end = [], int(offsets[0]), int(offsets[-1])
    long = end - at > SLICE_BYTES
    while at == offsets[0] or at + length <= end:
        to = min(end, at + SLICE_BYTES + length - 1) if long else end
        own = np.clip(offsets, at, to) - at
        if to - at >= length:
            found = _runs(data[at:to], own, powers, length)
            out.append((found[0], found[1] + at, *found[2:]))
        if not long:
            break
        at += SLICE_BYTES
    kinds = (np.int64, np.int64, np.int64, U, U)
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate(kinds))


def _runs(data: np.ndarray, offsets: np.ndarray, powers: Powers, length: int) -> tuple[np.ndarray, ...]:
    k = min(_ANCHOR, length)
    width, n = length - k + 1, len(data)
    sums = powers.sums(data.astype(U) + U(1))
    down = powers.to(n + 1)[1]
    anchor = mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])
    key = (anchor & ~U((1 << _PLACE_BITS) - 1)) | np.arange(len(anchor), dtype=U)
    tail = -len(key) % width
    block = np.concatenate([key, np.full(tail, ~U(0), U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    if not len(row):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][row]
    place = least[start]
    heads = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    sizes = np.diff(np.append(heads, len(start)))
    first, place = start[heads], place[heads]
    digest = mixed(powers.hashes(sums, first, first + sizes + length - 1) + (place - first).astype(U))
    return row[heads], first, sizes, anchor[place], digest


def _ordinals(row: np.ndarray) -> np.ndarray:
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    return np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))


def _batch(out: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], pa.int32()) for i in range(len(names) - 1)), pa.array([o[-1] for o in out], pa.binary())], names=list(names))


def _dealt_runs(batches: Iterator[pa.RecordBatch], length: int, groups: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Runs by group of anchors; those that repeat within the slice are settled, and one of them travels."""
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        tags = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets):
            row, _, _, anchor, digest = runs(data, offsets[a : b + 1], powers, length)
            if not len(row):
                continue
            at, own, none = _ordinals(row), tags[a:b], np.zeros(b - a, np.int64)
            twice, first = _equals(anchor, digest)
            hot = _of_anchor(anchor, first) > SLICE_KINDS
            lead = np.zeros(len(row), bool)
            lead[np.flatnonzero(hot)[np.unique(anchor[hot], return_index=True)[1]]] = True
            out = []
            for kind, told in ((_WHOLE, twice & (hot | ~first)), (_SPLIT, hot & first)):
                here = np.flatnonzero(told)
                out += [(p % groups, p, kind, blob) for p, blob in places.dealt(none, own, row[here], at[here], None, own[row[here]] % blocks)]
            here = np.flatnonzero(~hot & (~twice | first) | lead)
            keys = np.stack([anchor[here], digest[here] & ~U(3) | twice[here].astype(U) | hot[here].astype(U) << U(1)], 1)
            out += [(g, -1, 0, blob) for g, blob in places.dealt(none, own, row[here], at[here], keys, (anchor[here] % U(groups)).astype(np.int64))]
            yield _batch(out, ("part", "block", "kind", "blob"))


def _equals(anchor: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece is there twice, and whether it is the first of its kind."""
    order = np.lexsort((digest, anchor))
    new = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1]))
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(order)))
    twice, first = np.empty(len(order), bool), np.empty(len(order), bool)
    twice[order], first[order] = np.repeat(counts > 1, counts), new
    return twice, first


def _of_anchor(anchor: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each run the sum of ``values`` over the runs of its anchor."""
    _, own = np.unique(anchor, return_inverse=True)
    return np.bincount(own, values)[own]


def _sorted_out(table: pa.Table, blocks: int, most: int) -> pa.Table:
    """What the runs of a group tell: repeated in whole, or asked for because another piece has their anchor; window by window if over ``most`` have it."""
    own, kinds, blobs = np.array(table["block"].to_numpy(), np.int64), table["kind"].to_pylist(), table["blob"].to_pylist()
    out = [(int(k), kind, b) for k, kind, b in zip(own, kinds, blobs, strict=True) if k >= 0]
    got = places.joined([b for k, b in zip(own, blobs, strict=True) if k < 0])
    if len(got.at):
        key = got.keys.reshape(-1, 2)
        anchor, digest, before = key[:, 0], key[:, 1] & ~U(3), (key[:, 1] & U(1)) > 0
        twice, first = _equals(anchor, digest)
        kinds_of = _of_anchor(anchor, first)
        hot = (_of_anchor(anchor, (key[:, 1] & U(2)) > 0) > 0) | (kinds_of > max(1, most))
        rows = np.repeat(np.arange(len(got.ids)), got.counts)
        for kind, told in ((_WHOLE, twice | before), (_ASKED, (kinds_of > 1) & first & ~hot), (_SPLIT, first & hot)):
            here = np.flatnonzero(told)
            out += [(k, kind, b) for k, b in places.dealt(got.ids, got.tags, rows[here], got.at[here], None, got.tags[rows[here]] % blocks)]
    counts = [places.count(b) for _, _, b in out]
    return pa.table({"block": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([o[1] for o in out], pa.int32()), "places": pa.array(counts, pa.int64()), "blob": pa.array([o[2] for o in out], pa.binary())})


def _by_document(table: pa.Table, kind: int) -> dict[int, np.ndarray]:
    got = places.joined([b for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind])
    ends = np.cumsum(got.counts)
    lists: dict[int, list[np.ndarray]] = {}
    for tag, a, b in zip(got.tags.tolist(), (ends - got.counts).tolist(), ends.tolist(), strict=True):
        lists.setdefault(tag, []).append(got.at[a:b])
    return {tag: np.unique(np.concatenate(parts)) for tag, parts in lists.items()}


def _runs_of(tags: list[int], texts: list[bytes], wanted, powers: Powers, length: int) -> Iterator[tuple]:
    """Of each wanted text, one slice together: its number, then first window, number of windows, anchor and digest of its runs."""
    here = [i for i, tag in enumerate(tags) if tag in wanted]
    offsets = np.append(0, np.cumsum([len(texts[i]) for i in here], dtype=np.int64))
    for a, b in slices(offsets) if here else ():
        own = offsets[a : b + 1] - offsets[a]
        row, first, *more = runs(np.frombuffer(b"".join([texts[i] for i in here[a:b]]), np.uint8), own, powers, length)
        found, edges = (first - own[row], *more), np.searchsorted(row, np.arange(b - a + 1)).tolist()
        yield from ((i, *(x[edges[k] : edges[k + 1]] for x in found)) for k, i in enumerate(here[a:b]))


def _windows(text: np.ndarray, first: np.ndarray, sizes: np.ndarray, powers: Powers, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and hash of each window of some runs of a text, a bounded number at a time."""
    for at in range(0, len(text), SLICE_BYTES):
        here = slice(*np.searchsorted(first, [at, at + SLICE_BYTES]))
        n = sizes[here]
        if len(n):
            start = np.repeat(first[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sums = powers.sums(text[at : at + SLICE_BYTES + 2 * length].astype(U) + U(1))
            yield start, powers.hashes(sums, start - at, start - at + length)


def _dealt_windows(held: list[tuple], groups: int, blocks: int) -> list[tuple]:
    """Windows (tag, places, hashes) by group of hashes; those that repeat here are settled, and one of them travels."""
    tags, counts = np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held]
    rows, at, key = np.repeat(np.arange(len(held)), counts), *(np.concatenate([h[i] for h in held]) for i in (1, 2))
    key &= ~U(1)
    twice, first = _equals(key, key)
    here = np.flatnonzero(twice & ~first)
    out = [(p % groups, p, _STARTS, blob) for p, blob in places.dealt(tags, tags, rows[here], at[here], None, tags[rows[here]] % blocks)]
    here = np.flatnonzero(first)
    keys = key[here] | twice[here].astype(U)
    return out + [(g, -1, _SPLIT, blob) for g, blob in places.dealt(tags, tags, rows[here], at[here], keys, (mixed(key[here]) % U(groups)).astype(np.int64))]


def _pieces(left: pa.Table, right: pa.Table, length: int, groups: int, blocks: int) -> pa.Table:
    """The pieces that are asked for, by group: anchor, digest, tag, place of the first window, number of windows, then bytes. Of those to split, the windows."""
    powers, out, told, held, size = Powers(), {}, [], [], 0
    asked, split = _by_document(right, _ASKED), _by_document(right, _SPLIT)
    tags, wanted = left["tag"].to_pylist(), asked.keys() | split.keys()
    texts = [unsqueezed(packed) if tag in wanted else b"" for tag, packed in zip(tags, left["packed"].to_pylist(), strict=True)]
    for own, first, sizes, anchor, digest in _runs_of(tags, texts, wanted, powers, length):
        tag, raw = tags[own], texts[own]
        text = np.frombuffer(raw, np.uint8)
        if tag in asked:
            i = asked[tag]
            head = np.stack([anchor[i].view(np.int64), digest[i].view(np.int64), np.full(len(i), tag), first[i], sizes[i]], 1)
            for g, one, at, to in zip((anchor[i] % U(groups)).tolist(), head, first[i].tolist(), (first[i] + sizes[i] + length - 1).tolist(), strict=True):
                out.setdefault(g, []).append((one.tobytes(), raw[at:to]))
        for start, key in _windows(text, first[split[tag]], sizes[split[tag]], powers, length) if tag in split else ():
            held.append((tag, start, key))
            size += len(start)
            if size > BLOCK_WINDOWS:
                told, held, size = told + _dealt_windows(held, groups, blocks), [], 0
    told += _dealt_windows(held, groups, blocks) if held else []
    told += [(g, -1, _ASKED, np.array([len(out[g])], np.int64).tobytes() + b"".join(h for h, _ in out[g]) + b"".join(t for _, t in out[g])) for g in sorted(out)]
    return pa.Table.from_batches([_batch(told, ("part", "block", "kind", "blob"))])


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array as deep as ``length``, and for each suffix in it whether its common prefix with the one before is that long."""
    n, seeds = len(text), None
    # bytes by their number among those there are, so that more of them fit into a word; 0 is the end, which is no byte
    code = np.cumsum(np.bincount(text, minlength=256) > 0).astype(U)
    bits = int(code[-1]).bit_length()
    depth = min(64 // bits, length)
    ahead = np.append(code[text], np.zeros(depth, U))
    word = ahead[:n]
    for k in range(1, depth):
        word = (word << U(bits)) | ahead[k : k + n]
    order = np.argsort(word)
    new = np.append(True, np.diff(word[order]) != 0)
    rank = np.zeros(n + length, U)
    while True:
        if seeds is None and 4 * depth >= length:
            seeds, seed_depth = new.copy(), depth
        if depth >= length or new.all():
            break
        # suffixes that are alone have their place; the others are told apart by as many ranks as fit into a word
        held = np.cumsum(new)
        rank[order] = held
        bits = int(held[-1]).bit_length()
        times = min(64 // bits, -(-length // depth))
        reach = min(length, depth * times)
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        at = order[slots]
        key = rank[at]
        for k in range(1, times):
            key = (key << U(bits)) | rank[at + min(k * depth, reach - depth)]
        by = np.argsort(key)
        order[slots], new[slots], depth = at[by], np.append(True, np.diff(key[by]) != 0), reach
    if seeds is None:
        seeds, seed_depth = new, depth
    # seeds come in the order of their own depth; equal strings stand together in any deeper order, so ends agree
    before = text[order - 1].astype(np.int64)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    back = back[order - 1]
    back[order == 0] = -1
    marked = np.append(seeds, True)
    low = np.flatnonzero(seeds)
    high = np.append(low[1:], n)
    for _ in range(seed_depth, length):
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        held = back[at] >= 0
        key, to = (which[held] << 8) | before[at[held]], back[at[held]]
        if not len(key):
            break
        by = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        low = np.minimum.reduceat(to[by], heads)
        high = low + np.diff(np.append(heads, len(key)))
        fresh = ~marked[high]
        low, high = low[fresh], high[fresh]
        marked[high] = True
        if not len(low):
            break
    return order, ~marked[:n]


def _compared(table: pa.Table, length: int, blocks: int) -> pa.Table:
    """Windows of the pieces of a group that also start in another piece, and windows of its hashes that are there twice."""
    heads, texts = [], []
    own, kinds, blobs = table["block"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist()
    out = [(k, b) for k, kind, b in zip(own, kinds, blobs, strict=True) if kind == _STARTS]
    got = places.joined([b for kind, b in zip(kinds, blobs, strict=True) if kind == _SPLIT])
    if len(got.at):
        twice, _ = _equals(key := got.keys & ~U(1), key)
        here, rows = np.flatnonzero(twice | ((got.keys & U(1)) > 0)), np.repeat(np.arange(len(got.ids)), got.counts)
        out += places.dealt(got.ids, got.tags, rows[here], got.at[here], None, got.tags[rows[here]] % blocks)
    for blob in (b for kind, b in zip(kinds, blobs, strict=True) if kind == _ASKED):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        head = np.frombuffer(blob, np.int64, 5 * n, 8).reshape(-1, 5)
        ends = 8 + 40 * n + np.cumsum(head[:, 4] + length - 1)
        heads.append(head)
        texts += [blob[a:b] for a, b in zip((ends - head[:, 4] - length + 1).tolist(), ends.tolist(), strict=True)]
    if texts:
        head = np.concatenate(heads)
        _, own = np.unique(head[:, :2], axis=0, return_index=True)
        head, texts = head[own], [texts[i] for i in own.tolist()]
        text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        begin = np.cumsum(head[:, 4] + length) - head[:, 4] - length
        piece = np.repeat(np.arange(len(head)), head[:, 4] + length)
        offset = np.arange(len(text)) - begin[piece]
        order, same = common_prefixes(text, length)
        valid = (offset < head[piece, 4])[order]
        groups = np.flatnonzero(~same)
        held = np.add.reduceat(valid.astype(np.int64), groups)
        repeated = np.sort(order[valid & np.repeat(held > 1, np.diff(np.append(groups, len(order))))])
        row = piece[repeated]
        tags = head[:, 2]
        by = np.lexsort((head[row, 3] + offset[repeated], tags[row]))
        repeated, row = repeated[by], row[by]
        names, rows = np.unique(tags[row], return_inverse=True)
        out += places.dealt(names, names, rows, head[row, 3] + offset[repeated], None, tags[row] % blocks)
    return pa.table({"block": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([_STARTS] * len(out), pa.int32()), "blob": pa.array([o[1] for o in out], pa.binary())})


def _kept(left: pa.Table, right: pa.Table, length: int) -> pa.Table:
    powers = Powers()
    whole, starts = _by_document(right, _WHOLE), _by_document(right, _STARTS)
    total, removed, spans, kept = [], [], [], []
    tags, texts = left["tag"].to_pylist(), [unsqueezed(packed) or b"" for packed in left["packed"].to_pylist()]
    known = {own: (first[whole[tags[own]]], (first + sizes + length - 1)[whole[tags[own]]]) for own, first, sizes, *_ in _runs_of(tags, texts, whole, powers, length)}
    for own, (tag, raw) in enumerate(zip(tags, texts, strict=True)):
        total.append(len(raw))
        if tag not in whole and tag not in starts:
            removed.append(0)
            spans.append(0)
            kept.append(raw)
            continue
        text, edge = np.frombuffer(raw, np.uint8), np.zeros(len(raw) + 1, np.int64)
        if own in known:
            np.add.at(edge, known[own][0], 1)
            np.add.at(edge, known[own][1], -1)
        if tag in starts:
            np.add.at(edge, starts[tag], 1)
            np.add.at(edge, starts[tag] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed.append(int(gone.sum()))
        spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
        kept.append(text[~gone].tobytes())
    return pa.table({"row": left["row"], "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def repeats_removed(docs: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS, group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: row (a struct of its columns but the text), n_bytes, n_removed, n_spans and kept, the bytes that stay.

    ``length`` is 8 at least. One scan deals out the runs, 18 bytes for about 85 of text; two shuffles of the compressed
    texts meet what was found, one to fetch the pieces to compare and one to remove.
    """
    tag = F.xxhash64("doc_id", "text").alias("tag")
    known = docs.where("text is not null").select(tag, "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, blocks = -(-size // (group_runs * 80)) or 1, -(-size // block_bytes) or 1
    dealt = known.mapInArrow(lambda b: _dealt_runs(b, length, groups, blocks), "part int, block int, kind int, blob binary")
    found = dealt.repartitionById(groups, "part").groupBy("part").applyInArrow(lambda t: _sorted_out(t, blocks, group_bytes // (4 * (length + 85))), "block int, kind int, places long, blob binary")
    found = written(found, "runs")
    asked, split = (n or 0 for n in found.agg(*(F.sum(F.when(F.col("kind") == kind, F.col("places"))) for kind in (_ASKED, _SPLIT))).first())
    parts = -(-asked * (length + 85) // group_bytes) + -(-split * length // (2 * group_runs)) or 1

    def by_block(df: DataFrame):
        return df.repartitionById(blocks, "block").groupBy("block")

    def texts(*columns) -> DataFrame:
        return squeezed(docs.select(*columns, tag, "text")).withColumn("block", F.pmod("tag", F.lit(blocks)).cast("int"))

    wanted = found.where(F.col("kind").isin(_ASKED, _SPLIT)).drop("places")
    pieces = by_block(texts()).cogroup(by_block(wanted)).applyInArrow(lambda a, b: _pieces(a, b, length, parts, blocks), "part int, block int, kind int, blob binary")
    starts = pieces.repartitionById(parts, "part").groupBy("part").applyInArrow(lambda t: _compared(t, length, blocks), "block int, kind int, blob binary")
    told = found.where(F.col("kind") == _WHOLE).drop("places").unionByName(written(starts, "starts"))
    whole = texts(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"))
    schema = shape(whole.schema["row"], "n_bytes long, n_removed long, n_spans long, kept binary")
    return by_block(whole).cogroup(by_block(told)).applyInArrow(lambda a, b: _kept(a, b, length), schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
