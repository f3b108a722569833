"""Quality of documents by histogram gradient-boosted trees over statistics of their texts.

The statistics are sums over bytes and words of whole texts. Trees are grown level by level on a bounded sample of labelled
documents: each statistic is cut into bins at its quantiles, gradients are summed by node and bin, and every node takes the
split of the largest gain. The trees are laid out as arrays of one row a tree, in the order of a binary heap, and scores
are found by stepping down all trees of a batch at once.

Nulls: a null text is scored like an empty one, a null doc_id is not held out. Without labelled rows every score is 0.5.
Repeated rows are scored one by one; other columns, of any name, pass through. Texts of any length are measured whole; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import SAMPLE, held_out, labelled
from .spark_tools import named, shape
from .textbytes import SPACED_LOWER, U, Powers, slices, utf8, words

TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 1.0
THRESHOLD = 0.3
_CLASSES = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b".,;:?'\"-()" else 4 if b in b" \t\n\r\f\v" else 5 if b < 128 else 6 for b in range(256)])
STATISTICS = (
    "words log", "bytes a word", "longest word log", "share of lower-case letters", "share of upper-case letters", "share of digits", "share of punctuation",
    "share of white space", "share of other signs", "share beyond ASCII", "distinct words", "words like the one before", "most frequent word", "distinct pairs of words",
    "lines log", "words a line", "words that end in a sign", "words of one or two bytes",
)


def statistics(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for one without words."""
    begin, end = int(offsets[0]), int(offsets[-1])
    found = words(data, offsets, SPACED_LOWER, powers)
    own, row = np.diff(offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kinds = np.bincount(row * 7 + _CLASSES[data[begin:end]], minlength=7 * len(own)).reshape(-1, 7)
    lines = np.bincount(row[data[begin:end] == 10], minlength=len(own)) + 1
    n, of = np.diff(found.rows), found.row_of()
    length = found.ends - found.starts
    some, many = np.maximum(n, 1), np.maximum(own, 1)
    sums = lambda values: np.bincount(of, weights=values, minlength=len(own))
    like = np.append(False, (found.hashes[1:] == found.hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else np.zeros(0, bool)
    pair = np.append(found.hashes[:1], found.hashes[1:] * U(3) + found.hashes[:-1])
    longest, distinct, top, pairs = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own))
    for i, (a, b) in enumerate(zip(found.rows[:-1].tolist(), found.rows[1:].tolist(), strict=True)):
        if b > a:
            longest[i] = length[a:b].max()
            _, counts = np.unique(found.hashes[a:b], return_counts=True)
            distinct[i], top[i], pairs[i] = len(counts), counts.max(), len(np.unique(pair[a + 1 : b]))
    ends = _CLASSES[data[found.ends - 1]] if len(of) else np.zeros(0, np.int64)
    out = np.stack([
        np.log1p(n), own / some, np.log1p(longest), *(kinds[:, i] / many for i in (0, 1, 2, 3, 4, 5, 6)), distinct / some, sums(like) / some, top / some,
        pairs / np.maximum(n - 1, 1), np.log(lines), n / lines, sums((ends == 5)) / some, sums(length <= 2) / some,
    ], 1)
    out[n == 0] = 0
    return out


@dataclass
class Trees:
    """Flattened trees: column and limit of each inner node and value of each leaf, heap by heap."""

    start: float
    column: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        at = np.zeros((len(x), len(self.column)), np.int64)
        tree, rows = np.arange(len(self.column)), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.column[tree, at]] > self.limit[tree, at])
        total += self.value[tree, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def grown(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted on the logistic loss by histograms of gradients."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    column, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y):
        return Trees(0.0, column, limit, value)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], 1)  # in bin b: cuts[b - 1] < v <= cuts[b]
    rate = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    start = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), start)
    columns = np.arange(x.shape[1])
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            slot = (((node - first)[:, None] * x.shape[1] + columns) * BINS + bins).ravel()
            size = nodes * x.shape[1] * BINS
            sg, sh = (np.bincount(slot, np.repeat(v, x.shape[1]), size).reshape(nodes, x.shape[1], BINS) for v in (g, h))
            left_g, left_h = sg.cumsum(2)[..., :-1], sh.cumsum(2)[..., :-1]
            all_g, all_h = sg.sum(2, keepdims=True), sh.sum(2, keepdims=True)
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            c, b = best // (BINS - 1), best % (BINS - 1)
            for i in np.flatnonzero(worth):
                if b[i] < len(cuts[c[i]]):
                    column[t, first + i], limit[t, first + i] = c[i], cuts[c[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), column[t, node]] > limit[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[t][leaf]
    return Trees(start, column, limit, value)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in slices(offsets):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(list(statistics(data, offsets[a : b + 1], powers)), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees learned from ``labels.quality``; only statistics of at most ``sample`` documents come to the driver."""
    rows = labelled(docs, labels, "quality", sample).select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(_measured, "doc_id string, label int, x array<double>")
    got = rows.orderBy("doc_id", "x").limit(sample).toPandas()
    return grown(np.array(got["x"].tolist()).reshape(len(got), len(STATISTICS)), got["label"].to_numpy(np.float64))


def _scored(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slices(offsets):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(trees.score(statistics(data, offsets[a : b + 1], powers)))], names=["row", "score"])


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``score``, likelier of quality the nearer to 1."""
    own = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), "text")
    return rows.mapInArrow(lambda b: _scored(b, own.value), shape(rows.schema["row"], "score double"))


def judged(docs: DataFrame, trees: Trees) -> DataFrame:
    return scored(docs.select("doc_id", "text"), trees).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return scored(docs, trees).where(F.col("score") >= THRESHOLD).select("row.*")
