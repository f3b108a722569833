"""Toxicity of documents by a factorization machine over hashed terms.

A term is a word or the first four or five bytes of a longer one, hashed into a table of fixed size; a document has a term or not. The score is the
logistic of a constant, a weight for each term, and for each pair of terms the product of their vectors, so that two
terms together can weigh more or less than both alone; the sum over pairs comes from sums and squares of the vectors.
Learning takes a bounded sample of labelled documents. It starts from a machine over the ``TERMS`` hashed terms that tell the
labels apart best; then every hashed term of the sample has a weight and a vector, and sparse steps over small batches learn what the start
leaves unexplained: rarer terms, and pairs of terms that tell nothing alone.

Nulls: a null text is scored like an empty one, a null doc_id is not held out. Without labelled rows every score is 0.5.
Repeated rows are scored one by one. Texts of any length are read whole, an empty table gives no rows, and other columns, of
any name, stay in ``row``.
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
from .textbytes import ALNUM_LOWER, U, Powers, slices, utf8, words

HASH_BITS, TERMS, FACTORS, ROUNDS = 18, 512, 8, 200
EPOCHS, STEPS, BATCH = 4, 1000, 64
THRESHOLD = 0.5
HEADS = (4, 5)
_RATE, _DECAY, _SEED = 0.1, 1e-4, 7


def _terms(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term, once for each row that has the term."""
    found = words(data, offsets, ALNUM_LOWER, powers, heads=HEADS)
    row, size = found.row_of(), found.ends - found.starts
    key = [(row, found.hashes), *((row[size > n], h[size > n] + U(i + 1)) for i, (n, h) in enumerate(zip(HEADS, found.heads, strict=True)))]
    pairs = np.unique(np.concatenate([r * (1 << HASH_BITS) + ((k * U(0x9E3779B97F4A7C15)) >> U(64 - HASH_BITS)).astype(np.int64) for r, k in key]))
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


@dataclass
class Machine:
    """``slot`` of each hashed term (or -1), constant, weights and vectors by slot."""

    slot: np.ndarray
    constant: float
    weight: np.ndarray
    vectors: np.ndarray

    def score(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        own = self.slot[term]
        row, own = row[own >= 0], own[own >= 0]
        total = self.constant + np.bincount(row, self.weight[own], rows)
        for v in self.vectors.T:
            total += (np.bincount(row, v[own], rows) ** 2 - np.bincount(row, v[own] ** 2, rows)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def learned(x: np.ndarray, y: np.ndarray, slot: np.ndarray, rounds: int = ROUNDS) -> Machine:
    """Full-batch descent with step sizes by the running moments of the gradients; ``x`` is 0 or 1."""
    draw = np.random.default_rng(_SEED)
    n, terms = x.shape
    rate = np.clip(y.mean(), 0.01, 0.99) if n else 0.5
    what = [p.astype(np.float32) for p in (np.array([np.log(rate / (1 - rate))]), np.zeros(terms), draw.normal(0, 0.05, (terms, FACTORS)))]
    first, second = [np.zeros_like(p) for p in what], [np.zeros_like(p) for p in what]
    y = y.astype(np.float32)
    balance = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
    for step in range(1, rounds + 1 if n and terms else 1):
        constant, weight, vectors = what
        sums = x @ vectors
        margin = constant[0] + x @ weight + ((sums**2).sum(1) - x @ (vectors**2).sum(1)) / 2
        g = balance * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / n
        down = x.T @ (g[:, None] * sums) - vectors * (x.T @ g)[:, None]
        for i, slope in enumerate((np.array([g.sum()]), x.T @ g + _DECAY * weight, down + _DECAY * vectors)):
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.999 * second[i] + 0.001 * slope**2
            what[i] = what[i] - _RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(slot, float(what[0][0]), what[1].astype(np.float64), what[2].astype(np.float64))


def deepened(start: Machine, ends: np.ndarray, term: np.ndarray, y: np.ndarray) -> Machine:
    """``start`` carried on with all terms; row i has those from ``ends[i]`` up to ``ends[i + 1]``. Steps shrink with
    the terms of a row and the gradients a number has had. A fifth of the rows takes no part; the machine that answers these best stays, ``start`` among them."""
    draw = np.random.default_rng(_SEED)
    names = np.flatnonzero(np.bincount(term, minlength=1 << HASH_BITS))
    slot = np.full(1 << HASH_BITS, -1, np.int32)
    slot[names] = np.arange(len(names))
    what = np.concatenate([np.zeros((len(names), 1)), draw.normal(0, 0.01, (len(names), FACTORS))], 1).astype(np.float32)
    old = start.slot[names]
    what[old >= 0] = np.concatenate([start.weight[:, None], start.vectors], 1)[old[old >= 0]]
    constant, seen, had = start.constant, np.ones_like(what), 1.0
    rate = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    balance = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))
    rows = np.flatnonzero(np.diff(ends))
    rows, apart = rows[np.arange(len(rows)) % 5 > 0], rows[::5]
    pace = min(_RATE, len(y) / max(1, len(term)))
    told = np.concatenate([term[ends[i] : ends[i + 1]] for i in apart]) if len(apart) else term[:0]
    told_of = np.repeat(np.arange(len(apart)), np.diff(ends)[apart])
    best, least = None, np.inf
    for _ in range(1 + max(EPOCHS, -(-STEPS * BATCH // len(rows))) if len(rows) else 1):
        now = Machine(slot, float(constant), what[:, 0], what[:, 1:])
        score = now.score(told_of, told, len(apart))
        loss = -float((balance[apart] * np.log(np.where(y[apart] > 0, score, 1 - score) + 1e-9)).sum())
        if loss < least or best is None:
            best, least = Machine(slot, now.constant, now.weight.copy(), now.vectors.copy()), loss
        order = draw.permutation(rows)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            sizes = ends[own + 1] - ends[own]
            heads = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(own)), sizes)
            cell = slot[term[np.repeat(ends[own] - heads, sizes) + np.arange(len(doc))]]
            value = what[cell]
            sums, squares = np.add.reduceat(value, heads), np.add.reduceat((value[:, 1:] ** 2).sum(1), heads)
            margin = constant + sums[:, 0] + ((sums[:, 1:] ** 2).sum(1) - squares) / 2
            g = (balance[own] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[own])).astype(np.float32)
            value, sums[:, 0] = sums[doc] - value, 0
            value[:, 0] = 1
            by = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.append(True, cell[by][1:] != cell[by][:-1]))
            slope, cell = np.add.reduceat((value * g[doc][:, None])[by], first), cell[by][first]
            seen[cell] += slope**2
            what[cell] -= pace * slope / np.sqrt(seen[cell])
            had += float(g.sum()) ** 2
            constant -= pace * float(g.sum()) / had**0.5
    return best


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in slices(offsets):
            row, term = _terms(data, offsets[a : b + 1], powers)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), pa.array(term, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["doc_id", "label", "terms"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Machine:
    """A machine learned from ``labels.toxic``; it starts from ``terms`` terms. The driver sees the hashed terms of at most ``sample`` documents, four bytes each, and holds a table of fixed size."""
    rows = labelled(docs, labels, "toxic", sample).select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(_listed, "doc_id string, label int, terms array<int>")
    got = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).orderBy("doc_id").limit(sample).select("label", "terms").toArrow()
    y, lists = got["label"].to_numpy().astype(np.float64), got["terms"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    term = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(np.asarray(lists.value_lengths(), np.int64))).astype(np.int64)
    n, t = np.bincount(term, minlength=1 << HASH_BITS).astype(float), np.bincount(term[np.repeat(y > 0, np.diff(ends))], minlength=1 << HASH_BITS)
    slot = np.full(1 << HASH_BITS, -1, np.int16 if terms < 1 << 15 else np.int64)
    if len(term):
        own = np.flatnonzero(n)
        n, t, share = n[own], t[own], y.mean()
        spread = (t - n * share) ** 2 / np.maximum(n * share * (1 - share) * (1 - n / (len(y) + 1)), 1e-9)
        telling = np.flatnonzero(spread > 1.5 * np.log(len(own) + 1))  # few terms do by chance
        best = telling[np.lexsort((own[telling], -spread[telling]))[:terms]]
        slot[own[best]] = np.arange(len(best))
    x = np.zeros((len(y), int((slot >= 0).sum())), np.float32)
    here = np.flatnonzero(slot[term] >= 0)
    x[np.searchsorted(ends, here, "right") - 1, slot[term[here]]] = 1
    return deepened(learned(x, y, slot), ends, term, y)


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slices(offsets):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(machine.score(*_terms(data, offsets[a : b + 1], powers), b - a))], names=["row", "score"])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``row``, a struct of the columns of ``docs`` but the text, and ``score``, likelier toxic the nearer to 1."""
    own = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"), "text")
    return rows.mapInArrow(lambda b: _scored(b, own.value), shape(rows.schema["row"], "score double"))


def judged(docs: DataFrame, machine: Machine) -> DataFrame:
    return scored(docs.select("doc_id", "text"), machine).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
