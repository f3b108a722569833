"""Packed lists of places in documents, as they travel through a shuffle.

A blob holds, for documents known by (doc_id, tag), how many places each has, the places in rising order, and maybe a
64-bit key for each. tag is a hash of the text, so rows that share a doc_id stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbytes import packed_steps, unpacked_sums


@dataclass
class Places:
    ids: np.ndarray
    tags: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    keys: np.ndarray

    def each(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.counts)


def pack(ids: np.ndarray, tags: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray | None = None) -> bytes:
    """``rows`` (rising) tells the document of each place; ``ids`` and ``tags`` are by row."""
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    own = rows[heads]
    steps = at.astype(np.int64) + 1
    steps[1:] -= at[:-1] + 1
    steps[heads] = at[heads] + 1
    packed = packed_steps(steps)
    counts = np.diff(np.append(heads, len(rows)))
    size = np.array([len(own), len(at), len(packed)], np.int64)
    return b"".join(x.tobytes() for x in (size, ids[own].astype(np.int64), tags[own].astype(np.int64), counts.astype(np.uint32), packed, np.zeros(0, np.uint64) if keys is None else keys))


def unpack(blob: bytes) -> Places:
    docs, entries, steps = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24
    ids = np.frombuffer(blob, np.int64, docs, at)
    tags = np.frombuffer(blob, np.int64, docs, at := at + 8 * docs)
    counts = np.frombuffer(blob, np.uint32, docs, at := at + 8 * docs).astype(np.int64)
    packed = np.frombuffer(blob, np.uint8, steps, at := at + 4 * docs)
    keys = np.frombuffer(blob[at + steps :], np.uint64)
    sums = unpacked_sums(packed)
    heads = np.cumsum(counts) - counts
    before = np.where(heads > 0, sums[np.maximum(heads - 1, 0)], 0) if docs else heads
    return Places(ids, tags, counts, sums - np.repeat(before, counts) - 1, keys)


def count(blob: bytes) -> int:
    """Number of places in a blob."""
    return int(np.frombuffer(blob, np.int64, 1, 8)[0])


def joined(blobs) -> Places:
    parts = [unpack(b) for b in blobs]
    if not parts:
        parts = [Places(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)))]
    return Places(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "tags", "counts", "at", "keys")))


def dealt(ids: np.ndarray, tags: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray | None, part: np.ndarray):
    """A blob for each part: (part, blob); rows must rise."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for first, last in zip(edges, np.append(edges[1:], len(part)), strict=True):
        one = order[first:last]
        yield int(part[first]), pack(ids, tags, rows[one], at[one], None if keys is None else keys[one])
