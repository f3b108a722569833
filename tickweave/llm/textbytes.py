"""Words and windows of UTF-8 text as numpy arrays, over the buffers of an Arrow column.

Separators of all word rules here are ASCII, and no byte of a longer UTF-8 character is ASCII, so words are found
on bytes. A word or window is known by a 64-bit hash: a polynomial over its bytes or words, then mixed. Long runs of
values can be built to collide under any such polynomial (Thue-Morse sequences), so it takes stretches of ``_STRETCH``
values at most, mixed one after another, and long words are hashed by BLAKE2. Texts are taken in slices of bounded
size; one longer text is cut at separators, and only a longer word is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SLICE_BYTES = 1 << 20
#: Values under one polynomial.
_STRETCH = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def letters(inside, lower: bool) -> np.ndarray:
    """For each byte its value plus one if it belongs to words, else 0; ``inside(byte)`` decides; A-Z become a-z if ``lower``."""
    return np.array([(b + 33 if lower and 65 <= b <= 90 else b + 1) if inside(b) else 0 for b in range(256)], np.uint16)


#: Runs of anything but white space (the space and 9 to 13), with and without lower-casing.
SPACED = letters(lambda b: b != 32 and not 9 <= b <= 13, False)
SPACED_LOWER = letters(lambda b: b != 32 and not 9 <= b <= 13, True)
#: Runs of ASCII letters, digits and all that isn't ASCII, lower-cased.
ALNUM_LOWER = letters(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122, True)


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _BASE, U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, _INVERSE, U)]))
        return self.up, self.down

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums of values times powers, with a 0 before the first."""
        up, _ = self.to(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the values from first up to last, the same wherever they stand."""
        out, at = self._stretch(sums, first, np.minimum(first + _STRETCH, last)), first + _STRETCH
        more = np.flatnonzero(at < last)
        while len(more):
            begin = at[more]
            out[more] = mixed(out[more] + self._stretch(sums, begin, np.minimum(begin + _STRETCH, last[more])))
            at[more] = begin + _STRETCH
            more = more[at[more] < last[more]]
        return out

    def _stretch(self, sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        _, down = self.to(len(sums))
        return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(U))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offset of each row; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of some rows in order: where each begins and ends, its hash, and the index of each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    heads: tuple[np.ndarray, ...] = ()

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def windows(self, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of n words within one row, and the windows' hashes."""
        left = np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(len(self.hashes))
        first = np.flatnonzero(left >= n)
        return first, powers.hashes(powers.sums(self.hashes), first, first + n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, powers: Powers, limit: int = SLICE_BYTES, heads: tuple[int, ...] = ()) -> Words:
    """Of the rows between the offsets, by a table of letters. ``heads`` asks for hashes of the first so many bytes of the words, too."""
    parts, at, rows = [], int(offsets[0]), offsets
    while at < offsets[-1]:
        to = int(offsets[-1])
        if to - at > 2 * limit:
            to = at + limit
            while to < offsets[-1] and table[data[to]]:
                gap = np.flatnonzero(table[data[to : to + limit]] == 0)
                to = to + int(gap[0]) if len(gap) else min(to + limit, int(offsets[-1]))
        value = table[data[at:to]]
        inside = value > 0
        cuts = rows[(rows > at) & (rows < to)] - at
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
        before[cuts], after[cuts - 1] = False, False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = powers.sums(value.astype(U))
        own = powers.hashes(sums, first, np.minimum(first + _STRETCH, last))
        for i in np.flatnonzero(last - first > _STRETCH).tolist():
            own[i] = int.from_bytes(blake2b(value[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
        parts.append((first + at, last + at, own, *(powers.hashes(sums, first, np.minimum(first + n, last)) for n in heads)))
        at = to
    starts, ends, hashes, *firsts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, U, *(U for _ in heads))))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), tuple(firsts))


def packed_steps(steps: np.ndarray) -> np.ndarray:
    """Positive steps as bytes: a 0 stands for 255 more to go."""
    full = (steps - 1) // 255
    ends = np.cumsum(full + 1) - 1
    out = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    out[ends] = steps - full * 255
    return out


def unpacked_sums(packed: np.ndarray) -> np.ndarray:
    """Running sums of the steps that ``packed_steps`` took."""
    return np.cumsum(np.where(packed == 0, 255, packed).astype(np.int64))[packed != 0]
