"""Exact Jaccard self-join of word-shingle sets, with set-relation skipping, and the groups that its links make.

Two sets that overlap enough share one of the first elements of each in any common order, so an index of these
prefixes has every linked pair in some list. Elements are ordered by hash, those of overfull cells of a count of
all elements last, which keeps what very many sets share out of most prefixes.

Index-level skipping: a list is sorted by size, and each set looks only at the stretch whose sizes can still reach the
overlap, given how many elements it has left from its place on; the rest is skipped in blocks, unread.
Answer-level skipping: the members of a list are first held against one hub. A set that is linked with the hub has the
hub's answers: it shares its group, and no pair within a group is looked at again. A second round takes only pairs of
sets in different groups, so large groups of near copies cost one comparison a member and list, not all pairs.
Lists of one hub have much the same sets, those of a shared passage above all, so for this round they are made one, in which
a set has one entry, at the least of its places. If that has many sets outside its largest group, its lists are taken one
by one, and a list with many sets outside its largest group is split: two linked sets share their first two common elements within
prefixes that are one longer, so the list is dealt anew by its sets' second elements.

The parities of a set's elements in a few hundred cells bound from below in how many elements two sets differ. In the
second round they come with the entries of lists, so pairs too far apart end inside the task, before anything is joined;
and in both rounds only pairs within the bound have their sets fetched.

Equal sets are one node (known by a 64-bit digest and the size), so exact copies are not compared at all.

Nulls: a null or empty text has no set and is linked with nothing, it is its own group. A row with a null doc_id takes
part like others but never names a group; a group of such rows alone has a null id. Repeated rows are answered one by one.
An empty table gives no rows. Other columns may have any name; ``first_of_groups`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places
from .spark_tools import named, written
from .textbytes import SPACED_LOWER, U, Powers, mixed, slices, utf8, words

SHINGLE, PERCENT = 5, 80
#: Cells of the count of elements, and how many standard deviations of a chance count, and elements more, make one overfull.
_CELL_BITS, _OVERFULL, _LEAST = 20, 6, 64
#: Pairs whose parities are compared at once.
_AT_ONCE = 1 << 16
#: Sets outside its largest group that a list may have before it is split by second elements.
_OUTSIDE = 1024
_PARTS, _SEEN_BITS = 16, 23
#: Hubs, the nearest by parities, that a set is held against in the first round.
_HUBS, _DRAWS = 8, 16
GROUP_ENTRIES = 1 << 19


def shingle_sets(data, offsets, powers: Powers, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted shingle hashes of each row, and the digest of each set."""
    found = words(data, offsets, SPACED_LOWER, powers)
    sums = powers.sums(found.hashes)
    first, hashes = found.windows(n, powers)
    edges = np.searchsorted(first, found.rows)
    short = np.flatnonzero((np.diff(found.rows) > 0) & (np.diff(found.rows) < n))
    whole = dict(zip(short.tolist(), powers.hashes(sums, found.rows[short], found.rows[short + 1]), strict=True))
    sets = [np.unique(hashes[a:b]) if b > a else np.array([whole[r]] if r in whole else [], U) for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))]
    digests = np.array([int(mixed(np.array([mixed(s).sum(dtype=U) + U(len(s))], U))[0]) for s in sets], U).view(np.int64)
    return sets, digests


def _survey(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Size and digest of each document's set, and counts of elements by cell."""
    powers, cells = Powers(), np.zeros(1 << _CELL_BITS, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slices(offsets):
            sets, digests = shingle_sets(data, offsets[a : b + 1], powers, n)
            sizes = np.array([len(s) for s in sets])
            if sizes.sum():
                np.add.at(cells, (np.concatenate(sets) >> U(64 - _CELL_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64(), mask=sizes == 0), pa.array([_parity(x) for x in sets], pa.binary()), pa.array([_parity(x, 1, 12) for x in sets], pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())],
                names=["doc_id", "n_shingles", "set", "parity", "brief", "part", "cells"],
            )
    parts = [(i, np.minimum(c, 65535).astype(np.uint16).tobytes()) for i, c in enumerate(np.split(cells, _PARTS)) if c.any()]
    yield pa.RecordBatch.from_arrays(
        [*(pa.nulls(len(parts), pa.int64()) for _ in range(3)), *(pa.nulls(len(parts), pa.binary()) for _ in range(2)), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
        names=["doc_id", "n_shingles", "set", "parity", "brief", "part", "cells"],
    )


def _parity(elements: np.ndarray, an_element: int = 2, most: int = 15) -> bytes:
    """For each of about so many cells an element, 2 to the power of ``most`` at most, whether it holds an odd number of elements."""
    cells = 1 << min(most, max(6, int(an_element * len(elements)).bit_length()))
    return np.packbits(np.bincount((elements & U(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


class _Parities:
    """Parities of the entries of lists, each folded to all shorter lengths as well, so that two can be compared."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        data, offsets = utf8(column)
        self.bytes = np.diff(offsets)
        self.rows, self.place = {}, {}
        longer, kept = np.zeros((0, 0), np.uint64), np.zeros(0, np.int64)
        for size in sorted(set(self.bytes.tolist()), reverse=True):
            while len(kept) and longer.shape[1] * 8 > size:
                longer = longer[:, : longer.shape[1] // 2] ^ longer[:, longer.shape[1] // 2 :]
            own = np.flatnonzero(self.bytes == size)
            new = data[offsets[own][:, None] + np.arange(size)].view(np.uint64)
            longer, kept = (np.concatenate([longer, new]) if len(kept) else new), np.concatenate([kept, own])
            place = np.zeros(len(self.bytes), np.int64)
            place[kept] = np.arange(len(kept))
            self.rows[size], self.place[size] = longer, place

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many cells the entries of each pair (i, j) differ."""
        out, shorter = np.zeros(len(i), np.int64), np.minimum(self.bytes[i], self.bytes[j])
        for size in np.unique(shorter).tolist():
            chosen = np.flatnonzero(shorter == size)
            for some in np.array_split(chosen, -(-len(chosen) // _AT_ONCE)):
                x, y = (self.rows[size][self.place[size][k[some]]] for k in (i, j))
                out[some] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return out


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more cells than the sets may differ in elements, with the share of these."""
    for batch in batches:
        stay = []
        for x, y, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            stay.append(1000 * int(np.bitwise_count(x ^ y).sum()) * (100 + percent) // (n * (100 - percent)))
        far = pa.array(stay, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), far], names=["a", "b", "far"]).filter(pa.array(np.array(stay) <= 1000))


def _merged_cells(table: pa.Table, size, joined) -> pa.Table:
    total = None
    for blob in table["cells"]:
        own = np.frombuffer(blob.as_py(), size)
        total = own.astype(np.int64 if size is np.uint16 else size) if total is None else joined(total, own)
    return pa.table({"part": table["part"].combine_chunks().slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def _entries(batches: Iterator[pa.RecordBatch], n: int, percent: int, last: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Prefix elements, and one more, by group of elements: each with its set, the set's size and its place."""
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in slices(offsets):
            sets, digests = shingle_sets(data, offsets[a : b + 1], powers, n)
            _, own = np.unique(digests, return_index=True)
            prefixes, sizes = [], []
            for s in (sets[i] for i in own.tolist()):
                over = last[(s >> U(64 - _CELL_BITS)).astype(np.int64)]
                prefixes.append(np.concatenate([s[~over], s[over]])[: len(s) - -(-percent * len(s) // 100) + 2] if len(s) else s)
                sizes.append(len(s))
            lengths = np.array([len(p) for p in prefixes])
            if not lengths.sum():
                continue
            elements = np.concatenate(prefixes)
            rows = np.repeat(np.arange(len(own)), lengths)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out = list(places.dealt(digests[own], np.array(sizes), rows, at, elements, (elements % U(groups)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["part", "blob"])


def _lists(batches, most: int = 1 << 19):
    """Entries of elements that two sets or more have, each with the hub of its list: the first set seen of the element.

    The blobs of a group are taken in stretches of bounded size; of what came before only a hub for each element stays.
    """
    hubs = [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    waiting, size = [], 0
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("blob")):
            waiting.append(blob.as_py())
            size += len(waiting[-1])
            if size >= 10 * most:
                hubs, out = _stretch(hubs, waiting)
                waiting, size = [], 0
                yield out
    if waiting:
        yield _stretch(hubs, waiting)[1]


def _stretch(hubs: list[np.ndarray], blobs: list[bytes]) -> tuple[list[np.ndarray], pa.RecordBatch]:
    got = places.joined(blobs)
    element, own, size, at = got.keys, got.each(got.ids), got.each(got.tags), got.at
    n = len(hubs[0])
    element, own, size, at = (np.concatenate([h, x]) for h, x in zip(hubs[:4], (element, own, size, at), strict=True))
    said = np.concatenate([hubs[4], np.zeros(len(element) - n, bool)])
    order = np.lexsort((own, np.arange(len(element)) >= n, element))
    element, own, size, at, said = (x[order] for x in (element, own, size, at, said))
    new = np.append(True, (element[1:] != element[:-1]) | (own[1:] != own[:-1]))  # a set met in another stretch again is not told
    element, own, size, at, said = (x[new] for x in (element, own, size, at, said))
    heads = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
    counts = np.diff(np.append(heads, len(element)))
    hub = np.repeat(heads, counts)
    tell = (np.repeat(counts, counts) > 1) & ~said
    # in about _DRAWS of a set's lists a second hub, drawn by a hash, so that it meets several of those that are near it
    lot = mixed(own.view(U) ^ element)
    drawn = np.lexsort((lot, element))[hub]
    drawn = np.where(lot % (size // 5 + 1).astype(U) < U(_DRAWS), drawn, hub)
    out = [pa.array(x[tell].view(np.int64)) for x in (element, own, size, at, own[hub], size[hub], own[drawn], size[drawn])]
    return [element[heads], own[heads], size[heads], at[heads], said[heads] | (counts > 1)], pa.RecordBatch.from_arrays(out, names=["element", "set", "size", "at", "hub", "hub_size", "drawn", "drawn_size"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets in different groups that a list, sorted by size, leaves possible; lists may span batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        element = table["element"].to_numpy()
        cut = int(np.searchsorted(element, element[-1]))
        rest = table.slice(cut)
        yield from _pairs_of(table.slice(0, cut), percent)
    if rest is not None:
        yield from _pairs_of(rest, percent)


def _pairs_of(table: pa.Table, percent: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    element, own, size, at, group = (table[c].to_numpy() for c in ("element", "set", "size", "at", "grp"))
    parities = _Parities(table["parity"])
    # an overlap needs at least percent / (100 + percent) of both sizes: the longest partner that what is left allows
    longest = np.minimum(100 * size // percent, (100 + percent) * (size - at) // percent - size)
    heads = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
    counts = np.diff(np.append(heads, len(element)))
    several = np.minimum.reduceat(group, heads) != np.maximum.reduceat(group, heads)
    short = np.flatnonzero(np.repeat(several & (counts <= 64), counts))
    tall = int(size.max()) + 1
    key = np.repeat(np.arange(len(heads)), counts) * tall + size
    reach = np.searchsorted(key, key[short] - size[short] + np.minimum(longest[short], tall - 1), "right") - short - 1
    reach = np.maximum(reach, 0)
    for cut in np.split(np.arange(len(short)), np.searchsorted(np.cumsum(reach), np.arange(most, int(reach.sum()) + 1, most))):
        n = reach[cut]
        i = np.repeat(short[cut], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        stay = (group[i] != group[j]) & (longest[j] >= size[i])
        yield _told(own, size, parities, i[stay], j[stay], percent)
    for head, n in zip(heads[several & (counts > 64)].tolist(), counts[several & (counts > 64)].tolist(), strict=True):
        span = slice(head, head + n)
        _, which, sizes = np.unique(group[span], return_inverse=True, return_counts=True)
        small = which != sizes.argmax()
        for i in (np.flatnonzero(small) + head).tolist():  # members of the largest group meet only those outside it
            to = head + int(np.searchsorted(size[span], longest[i], "right"))
            low = head + int(np.searchsorted(size[span], -(-percent * size[i] // 100)))
            j = np.arange(low, to)
            j = j[(group[j] != group[i]) & (longest[j] >= size[i]) & ((j > i) | ~small[j - head])]
            if len(j):
                yield _told(own, size, parities, np.full(len(j), i), j, percent)


def _told(own: np.ndarray, size: np.ndarray, parities: _Parities, i: np.ndarray, j: np.ndarray, percent: int) -> pa.RecordBatch:
    i, j = (x[100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])] for x in (i, j))
    stay = (100 + percent) * parities.apart(i, j) <= (100 - percent) * (size[i] + size[j])
    x, y = own[i[stay]], own[j[stay]]
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _chosen(batches: Iterator[pa.RecordBatch], n: int, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets whose digest may be asked for."""
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in slices(offsets):
            sets, digests = shingle_sets(data, offsets[a : b + 1], powers, n)
            asked = np.flatnonzero(seen[_seen_cell(digests)])
            asked = asked[np.unique(digests[asked], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(digests[asked]), pa.array([sets[i].view(np.int64) for i in asked.tolist()], pa.list_(pa.int64()))], names=["set", "elements"])


def _seen_cell(digests: np.ndarray) -> np.ndarray:
    return (digests.view(U) >> U(64 - _SEEN_BITS)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << _SEEN_BITS, bool)
    for batch in batches:
        for column in batch.columns:
            cells[_seen_cell(column.to_numpy(zero_copy_only=False))] = True
    parts = [(i, np.packbits(c).tobytes()) for i, c in enumerate(np.split(cells, _PARTS)) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["part", "cells"])


def _verified(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose sets overlap enough. Only sets that are asked for travel: 1 MB of bits tells them from most others."""
    size = (1 << _SEEN_BITS) // _PARTS
    bits = {r.part: r.cells for r in pairs.mapInArrow(_asked, "part int, cells binary").groupBy("part").applyInArrow(lambda t: _merged_cells(t, np.uint8, np.bitwise_or), "part int, cells binary").collect()}
    seen = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8)).astype(bool) if i in bits else np.zeros(size, bool) for i in range(_PARTS)])
    own = texts.sparkSession.sparkContext.broadcast(np.packbits(seen))
    sets = texts.mapInArrow(lambda b: _chosen(b, n, np.unpackbits(own.value).astype(bool)), "set long, elements array<long>").groupBy("set").agg(F.first("elements").alias("elements"))
    met = pairs.join(sets.toDF("b", "right"), "b").join(sets.toDF("a", "left"), "a")
    both = F.size(F.array_intersect("left", "right"))
    return met.where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def _close(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the parities of their sets leave possible, and how ``far`` these are apart."""
    met = pairs.join(parities.toDF("a", "x", "n"), "a").join(parities.toDF("b", "y", "m"), "b")
    return met.select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("n")).mapInArrow(lambda b: _possible(b, percent), "a long, b long, far long")


def components(links: DataFrame) -> DataFrame:
    """The smallest node of each linked node's component, by passing smaller labels on and jumping along them."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        passed = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jumped = passed.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        labels = written(jumped, "labels")
        if not labels.where("old <> label").limit(1).count():
            return labels.select("node", "label")
        labels = labels.drop("old")


def _outside(entries: DataFrame, key: str) -> DataFrame:
    """Of each list that has sets of several groups, how many are outside its largest group."""
    return entries.groupBy(key, "grp").agg(F.count("*").alias("n")).groupBy(key).agg((F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")


def _merged(lists: DataFrame, labels: DataFrame, prefix: str, percent: int) -> DataFrame:
    """Entries of lists that have sets of several groups. The lists of one hub are one list, in which a set has one entry."""

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("grp", F.coalesce("label", "set")).drop("label")

    merged = written(grouped(lists.where(f"at < {prefix}").groupBy("hub", "set").agg(F.first("size").alias("size"), F.min("at").alias("at"))), "merged")
    outside = written(_outside(merged, "hub"), "outside")
    light = merged.join(outside.where(f"outside <= {_OUTSIDE}"), "hub").select(F.col("hub").alias("element"), "set", "size", "at", "grp")
    long = outside.where(f"outside > {_OUTSIDE}").select("hub")
    if not long.limit(1).count():
        return light
    return light.union(_mixed(grouped(lists.join(long, "hub", "left_semi").select("set", "element", "size", "at")).select("element", "set", "size", "at", "grp"), prefix, percent))


def _mixed(grouped: DataFrame, prefix: str, percent: int) -> DataFrame:
    """Entries of lists that have sets of several groups; those with many outside the largest group are split by second elements."""
    mixed = grouped.where(f"at < {prefix}").join(_outside(grouped, "element"), "element")
    # sets so small that one common element makes a link have no second one
    plain = mixed.where(f"outside <= {_OUTSIDE} or size * {percent} <= 100").drop("outside")
    second = grouped.select("set", F.col("element").alias("then"), F.col("at").alias("later"))
    split = mixed.where(f"outside > {_OUTSIDE}").join(second, "set").where("later > at")
    return plain.union(split.select(F.xxhash64("element", "then").alias("element"), "set", "size", F.expr("later - 1").alias("at"), "grp"))


def groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id it is linked with directly or on a way."""
    texts = docs.select("text").where("text is not null")
    survey = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _survey(b, n), "doc_id long, n_shingles long, set long, parity binary, brief binary, part int, cells binary"), "survey")
    rows = survey.where("part is null").drop("part", "cells", "parity", "brief")
    parities = survey.where("set is not null").groupBy("set").agg(F.first("parity").alias("parity"), F.first("n_shingles").alias("n"))
    brief = survey.where("set is not null").groupBy("set").agg(F.first("brief").alias("parity"))
    counted = survey.where("part is not null").select("part", "cells").groupBy("part").applyInArrow(lambda t: _merged_cells(t, np.uint16, np.add), "part int, cells binary")
    cells = {r.part: np.frombuffer(r.cells, np.int64) for r in counted.collect()}
    cells = np.concatenate([cells.get(i, np.zeros((1 << _CELL_BITS) // _PARTS, np.int64)) for i in range(_PARTS)])
    last = cells > cells.mean() + _OVERFULL * cells.mean() ** 0.5 + _LEAST
    prefix = f"size - ceil({percent} * size / 100.0) + 1"
    total = rows.agg(F.sum(F.expr(prefix.replace("size", "n_shingles")))).first()[0] or 0
    parts = -(-int(total) // group_entries) or 1
    entries = texts.mapInArrow(lambda b: _entries(b, n, percent, last, parts), "part int, blob binary")
    lists = written(entries.repartitionById(parts, "part").select("blob").mapInArrow(_lists, "element long, set long, size long, at long, hub long, hub_size long, drawn long, drawn_size long"), "lists")
    hubs = lists.select("set", "size", F.explode(F.array_distinct(F.array(F.struct(F.col("hub").alias("id"), F.col("hub_size").alias("n")), F.struct(F.col("drawn").alias("id"), F.col("drawn_size").alias("n"))))).alias("hub"))
    near = F.expr(f"100 * least(size, hub.n) >= {percent} * greatest(size, hub.n)")
    met = hubs.where("set <> hub.id").where(near).select(F.col("set").alias("a"), F.col("hub.id").alias("b")).distinct()
    best = _close(met, parities, percent).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "b"))), 1, _HUBS).alias("hubs")).select("a", F.explode("hubs.b").alias("b"))
    pairs = written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = written(_verified(texts, pairs, n, percent), "links")
    labels = components(links)
    across = _merged(lists, labels, prefix, percent).join(brief, "set").repartition("element").sortWithinPartitions("element", "size").mapInArrow(lambda b: _across(b, percent), "a long, b long").distinct()
    more = written(_close(across.join(pairs, ["a", "b"], "left_anti"), parities, percent).select("a", "b"), "pairs")
    if more.limit(1).count():
        # links between groups: their groups' labels are joined
        of_a, of_b = labels.toDF("a", "x"), labels.toDF("b", "y")
        between = _verified(texts, more, n, percent).join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        further = components(between).toDF("label", "further")
        alone = further.join(labels, "label", "left_anti").select(F.col("label").alias("node"), F.col("further").alias("label"))
        labels = written(labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")).union(alone), "labels")
    labelled = rows.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    firsts = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(firsts, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group. Rows that share a doc_id stay or go together, and stay if one of them is such; rows without a doc_id stay."""
    first = groups(docs.select("doc_id", "text"), n, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    return docs.join(first.where("component_id < doc_id").select("doc_id"), "doc_id", "left_anti").select(*map(named, docs.columns))
