"""Ranked lexical search of few items in all documents, by classes of documents that no item can tell apart.

Terms are runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased. With N documents that hold a term, L terms in all, n
terms in a document, df documents that hold a term and tf its occurrences in a document, a term weighs
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and gives ``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` with
``m = 50 + (50 * n * N) div L``. A document scores the sum over the item's terms.

One pass restricts each document to its tf vector over the terms of all items; N, L and df come from these vectors. Documents of the
same vector and m score alike for every item, so they form a class: a hash deals them, vector and m are compared in full, and
each class keeps its ``k`` smallest doc_ids (a limit that Spark applies before the shuffle, too, so a hot class sends k rows a task). Each class is scored once: its terms
reach the items by lists of items, and each task keeps the k best classes of an item. The best classes of all tasks are
expanded into their members by ascending doc_id. Nothing of the documents is broadcast. Of the items, terms and lists
are, in passes of about ``pass_bytes`` of distinct terms (at least one item); each pass reads the documents once.

Nulls: null texts have no terms; items of null item_id take no part; a null doc_id comes last among equal scores. Rows of one item_id form one item
of all their terms, each once. Repeated documents are ranked one by one. No documents, or items without terms, give no rows. Texts
are read in slices of 1 MB cut between terms. Only the columns named here are read, so others of any name do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .divergence import terms_of
from .spark_tools import shape, written
from .textbytes import utf8

K, PASS_BYTES = 50, 4 << 20
#: Cells (class, item) scored at a time, and terms met with items.
_CELLS, _MEETINGS = 1 << 20, 1 << 21
#: Bytes of terms, lower-cased; all others become a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Items:
    """Items of one pass: the number of each term, and for each term its items (``lists[starts[t] : starts[t + 1]]``)."""

    ids: list[str]
    terms: dict[bytes, int]
    starts: np.ndarray
    lists: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def numbered(items: list[tuple[str, list[str]]]) -> Items:
    terms: dict[bytes, int] = {}
    own = [sorted({terms.setdefault(t.encode(), len(terms)) for t in words}) for _, words in items]
    term, item = np.array([t for ts in own for t in ts], np.int64), np.repeat(np.arange(len(own)), [len(ts) for ts in own])
    order = np.argsort(term, kind="stable")
    return Items([i for i, _ in items], terms, np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            found = sorted(t.decode() for t in set().union(*terms_of(data[a:b].tobytes(), LETTERS)))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([found], pa.list_(pa.string()))], names=["item_id", "terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id as a string and its distinct terms, of items that have any."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string")).where("item_id is not null")
    rows = named.mapInArrow(_item_terms, "item_id string, terms array<string>")
    return rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def _vectors(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    known = terms.keys()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        lengths, vectors = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n, counts = 0, Counter()
            for words in terms_of(data[a:b].tobytes(), LETTERS):
                n += len(words)
                here = Counter(words)
                counts.update({t: here[t] for t in known & here.keys()})
            held = sorted((terms[t], tf) for t, tf in counts.items())
            lengths.append(n)
            vectors.append(np.array(held, "<u4").T.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(vectors, pa.binary())], names=["doc_id", "n", "vector"])


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, and vector: the numbers of the items' terms in the document, rising, then the occurrences of each."""
    known = docs.sparkSession.sparkContext.broadcast(items.terms)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(lambda batches: _vectors(batches, known.value), "doc_id long, n long, vector binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors: the row, term and occurrences of each entry."""
    data, offsets = utf8(column)
    words = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4").astype(np.int64)
    sizes = np.diff(offsets) // 8
    rows, before = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    at = np.arange(len(rows)) + before[rows]
    return rows, words[at], words[at + sizes[rows]]


def _held(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(many, np.int64)
    for batch in batches:
        counts += np.bincount(_flat(batch.column(0))[1], minlength=many)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["term", "df"])


def weights(vectors: DataFrame, many: int, total: int) -> np.ndarray:
    """w of each of ``many`` terms, given N."""
    df = np.zeros(many, np.int64)
    for term, n in vectors.select("vector").mapInArrow(lambda b: _held(b, many), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def classes(vectors: DataFrame, total: int, length: int, k: int = K) -> DataFrame:
    """vector, m and members (the k smallest doc_ids, nulls last) of documents that hold a term of the items."""
    wide = [x.cast("decimal(19,0)") for x in (F.col("n") * 50, F.lit(total), F.lit(length))]
    m = F.lit(50).cast("long") + F.call_function("div", wide[0] * wide[1], wide[2])
    known = vectors.where(F.octet_length("vector") > 0).select("doc_id", "vector", m.alias("m")).withColumn("hash", F.xxhash64("vector", "m"))
    same = ("hash", "vector", "m")
    first = known.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= k)
    return first.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias("members")).drop("hash")


class Best:
    """The k best classes of each item so far, by score, then by their first member."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.first = self.number = np.zeros(0, np.int64)
        self.members: dict[int, list] = {}
        self.seen = 0

    def add(self, scores: np.ndarray, members: list[list]) -> None:
        """``scores`` of classes by items."""
        row, item = np.nonzero(scores >= self.least)
        first = np.array([_NO_ID if m[0] is None else m[0] for m in members], np.int64)
        for name, new in (("item", item), ("score", scores[row, item]), ("first", first[row]), ("number", row + self.seen)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))
        for r in np.unique(row).tolist():
            self.members[r + self.seen] = members[r]
        self.seen += len(members)
        if len(self.item) > 4 * self.k * len(self.least):
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.first, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        for name in ("item", "score", "first", "number"):
            setattr(self, name, getattr(self, name)[order])
        full = rank == self.k - 1
        self.least[item[full]] = np.maximum(self.least[item[full]], self.score[rank[rank < self.k] == self.k - 1])
        self.members = {n: self.members[n] for n in set(self.number.tolist())}


def _scored(batches: Iterator[pa.RecordBatch], items: Items, k: int) -> Iterator[pa.RecordBatch]:
    many, best = len(items.ids), Best(len(items.ids), k)
    size = np.diff(items.starts)
    for batch in batches:
        row, term, tf = _flat(batch.column(0))
        m, members = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        gives = items.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        ends = np.searchsorted(row, np.arange(len(members) + 1))
        meetings = np.append(0, np.cumsum(size[term]))[ends]
        at, rows = 0, max(1, _CELLS // many)
        while at < len(members):
            to = min(at + rows, max(at + 1, int(np.searchsorted(meetings, meetings[at] + _MEETINGS, "right")) - 1), len(members))
            a, b = ends[at], ends[to]
            lists = size[term[a:b]]
            step = np.arange(int(lists.sum())) - np.repeat(np.cumsum(lists) - lists, lists)
            item = items.lists[np.repeat(items.starts[term[a:b]], lists) + step]
            scores = np.zeros((to - at) * many, np.int64)
            np.add.at(scores, np.repeat(row[a:b] - at, lists) * many + item, np.repeat(gives[a:b], lists))
            best.add(scores.reshape(-1, many), members[at:to])
            at = to
    best.prune()
    yield pa.RecordBatch.from_arrays(
        [pa.array([items.ids[i] for i in best.item.tolist()], pa.string()), pa.array(best.score), pa.array([best.members[n] for n in best.number.tolist()], pa.list_(pa.int64()))], names=["item_id", "score", "members"]
    )


def _pass(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    held = written(vectors(docs, items), "vectors")
    total, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    items.weights = weights(held, len(items.terms), total)
    own = spark.sparkContext.broadcast(items)
    return classes(held, total, max(1, length), k).select("vector", "m", "members").mapInArrow(lambda batches: _scored(batches, own.value, k), "item_id string, score long, members array<long>")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    known = written(item_terms(items), "items")
    size = known.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + F.octet_length("item_id"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    parts = []
    for n in range(passes):
        rows = [tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect()]
        if rows:
            parts.append(_pass(docs, numbered(rows), k))
    if not parts:
        return docs.sparkSession.createDataFrame([], shape(items.schema["item_id"], "rank int, doc_id long, score long"))
    first = F.col("members")[0].asc_nulls_last()
    best = reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), first))).where(F.col("place") <= k)
    expanded = best.select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), F.explode("members").alias("doc_id"), "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
