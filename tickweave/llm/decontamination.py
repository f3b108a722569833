"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of the benchmark items; an item with fewer words is one
shorter pattern. For each pattern length there is one matcher of the classical three tables, with words for letters:
the shift table tells by the block of the last two words how far no pattern can end, the bucket of suffix hashes
selects patterns where the shift is 0, and a direct comparison of the words' bytes confirms. Many places of a slice
of text advance together, each by its own shift, so the skipping runs as numpy operations.

Nulls: a null text has no words, a null item_id or item text takes no part. Repeated rows are answered one by one;
repeated items count once. Empty tables give no rows, or documents without hits. Other columns of ``docs`` pass
through unread and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import named, shape
from .textbytes import ALNUM_LOWER, U, Powers, Words, mixed, slices, utf8, words

WINDOW = 10
#: Bytes of benchmark text whose tables one pass holds; a larger benchmark is taken in several passes.
PASS_BYTES = 16 << 20
_LANES, _BITS = 512, 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _sentences(found: Words, first: np.ndarray, n: int) -> list[bytes]:
    """The words from each first one, lower-cased and joined by a space."""
    raw, starts, ends = found.data, found.starts, found.ends
    return [b" ".join(raw[starts[i] : ends[i]].tobytes() for i in range(f, f + n)).translate(_LOWER) for f in first.tolist()]


class Matcher:
    """Wu-Manber tables of the patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, blocks: np.ndarray, texts: list[bytes], items: list[int]) -> None:
        self.length, self.block = length, min(2, length)
        most = length - self.block + 1
        self.shift = np.full(1 << _BITS, most, np.int64)
        for j in range(most):  # the largest shift first, so that the smallest of a block stands
            self.shift[blocks[:, j]] = np.minimum(self.shift[blocks[:, j]], most - 1 - j)
        order = np.argsort(hashes, kind="stable")
        self.suffix, self.bounds = np.unique(hashes[order], return_index=True)
        self.bounds = np.append(self.bounds, len(order))
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]

    def ends(self, blocks: np.ndarray) -> np.ndarray:
        """Places of words where a pattern may end, by shifts alone."""
        n = len(blocks)
        size = max(self.length, -(-n // _LANES))
        at = np.arange(0, n, size) + self.length - 1
        at[1:] -= self.length - 1  # an end belongs to the lane that holds it
        until = np.minimum(np.arange(0, n, size) + size, n)
        out = []
        live = at < until
        at, until = at[live], until[live]
        while len(at):
            step = self.shift[blocks[at]]
            out.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < until
            if not live.all():
                at, until = at[live], until[live]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def matches(self, found: Words, row_of: np.ndarray, blocks: np.ndarray, sums: np.ndarray, powers: Powers) -> tuple[list[int], list[int]]:
        """First words of the occurrences, and a pattern of each."""
        first = self.ends(blocks) - self.length + 1
        first = first[row_of[first] == row_of[first + self.length - 1]]
        bucket = np.searchsorted(self.suffix, key := powers.hashes(sums, first, first + self.length))
        bucket[bucket == len(self.suffix)] = 0
        hit = self.suffix[bucket] == key
        first, bucket = first[hit], bucket[hit]
        where, which = [], []
        for f, b, text in zip(first.tolist(), bucket.tolist(), _sentences(found, first, self.length), strict=True):
            for p in range(self.bounds[b], self.bounds[b + 1]):
                if self.texts[p] == text:
                    where.append(f)
                    which.append(p)
        return where, which


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Slot of the shift table of the block that ends at each word."""
    key = hashes.copy()
    if size == 2:
        key[1:] += hashes[:-1] * U(0xD6E8FEB86659FD93)
    return (mixed(key) >> U(64 - _BITS)).astype(np.int64)


def matchers(items: list[tuple[str, str]], window: int = WINDOW) -> tuple[list[Matcher], list[str]]:
    """One for each pattern length, and the item ids that their items point to."""
    powers, patterns, ids = Powers(), {}, []
    for item, text in sorted(set(items)):
        found = words(*utf8(pa.array([text])), ALNUM_LOWER, powers)
        if not len(found.hashes):
            continue
        length = min(window, len(found.hashes))
        first, hashes = found.windows(length, powers)
        blocks = _blocks(found.hashes, min(2, length))
        for f, h, sentence in zip(first.tolist(), hashes.tolist(), _sentences(found, first, length), strict=True):
            patterns.setdefault(length, []).append((h, blocks[f + min(2, length) - 1 : f + length], sentence, len(ids)))
        ids.append(item)
    return [Matcher(n, np.array([p[0] for p in ps], U), np.array([p[1] for p in ps]), [p[2] for p in ps], [p[3] for p in ps]) for n, ps in sorted(patterns.items())], ids


def _search(batches: Iterator[pa.RecordBatch], found_by: list[Matcher], ids: list[str]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            found = words(data, offsets[first : last + 1], ALNUM_LOWER, powers)
            row_of, sums = found.row_of(), powers.sums(found.hashes)
            hit = np.zeros(len(found.hashes) + 1, np.int64)
            items: dict[int, set[str]] = {}
            blocks = {}
            for m in found_by:
                if m.block not in blocks:
                    blocks[m.block] = _blocks(found.hashes, m.block)
                where, which = m.matches(found, row_of, blocks[m.block], sums, powers)
                np.add.at(hit, np.array(where, np.int64), 1)
                np.add.at(hit, np.array(where, np.int64) + m.length, -1)
                for f, p in zip(where, which, strict=True):
                    items.setdefault(int(row_of[f]), set()).add(ids[m.items[p]])
            places = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
            counts = np.bincount(row_of[places], minlength=last - first)
            places = places - found.rows[row_of[places]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(np.diff(found.rows), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(places, pa.int32())),
                    pa.array([sorted(items.get(r, ())) for r in range(last - first)], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "hit_words", "items"],
            )


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, hit_words (places of words inside an occurrence), items.

    One narrow pass over the documents for each ``pass_bytes`` of benchmark text; only with several passes are their
    answers, without texts, shuffled and united.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    texts = docs.select("doc_id", "text")
    if passes > 1:
        texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text")
    schema, out = shape(texts.schema["doc_id"], "n_words long, hit_words array<int>, items array<string>"), None
    for k in range(passes):
        found_by, ids = matchers([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()], window)
        one = texts.mapInArrow(lambda batches, m=spark.sparkContext.broadcast((found_by, ids)): _search(batches, *m.value), schema)
        out = one if out is None else out.unionByName(one)
    if passes > 1:
        out = out.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        ).withColumn("doc_id", F.col("doc_id.doc_id"))
    return out


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of what was found in each document."""
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; null texts stay.

    The texts are searched with all their columns beside them, so no join with the answers is needed.
    """
    kept = docs.select(F.struct(*map(named, docs.columns)).alias("doc_id"), "text")
    return occurrences(kept, benchmark, window).where(F.size("hit_words") == 0).select("doc_id.*")
