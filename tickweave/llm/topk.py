"""Exact top-k search by inner product, as tiled matrix products.

Candidates are packed where they lie into shards of ``SHARD`` vectors, queries into blocks of ``BLOCK``. A grid deals the
tiles out: each shard falls to one of some columns and meets every block there, so no task holds more than a block
and a shard. A tile is a matrix product in stretches of rows; per query the k best are selected from it, not sorted,
and merged with the best so far of the column. The columns' lists are merged as a tree, sixteen at a time.

Components x count as floor(scale * x), so scores are whole numbers: exact in doubles while they must stay below 2**53, else
worked out in whole numbers and held to the range of a long. Vectors that are null, hold a null or non-finite
component or have a null id take no part; only vectors of one length meet. Rows that share an id never answer a query of this id,
which is asked once, with the least of their vectors; to other queries each of them is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD, BLOCK, K, SCALE = 4096, 4096, 5, 256
_ROWS, _FAN_IN, _LEAST = 512, 16, np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the vectors that take part."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def _packed(batches: Iterator[pa.RecordBatch], size: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors of one length as matrices of at most ``size`` rows, by rising id; ``shard`` is a number to deal them by."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        flat, length = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        begin = np.cumsum(length) - length
        for dim in np.unique(length).tolist():
            own = np.flatnonzero(length == dim)
            matrix = np.floor(scale * flat[begin[own][:, None] + np.arange(dim)])
            waiting.setdefault(dim, []).append((ids[own], matrix))
            while sum(len(i) for i, _ in waiting[dim]) >= size:
                i, m = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
                yield _matrix(dim, i[:size], m[:size])
                waiting[dim] = [(i[size:], m[size:])]
    for dim, parts in waiting.items():
        i, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(i):
            yield _matrix(dim, i, m)


def _matrix(dim: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(ids[order].sum() & 0x7FFFFFFF)], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([matrix[order].tobytes()], pa.binary())], names=["dim", "shard", "ids", "matrix"])


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2.0**53:
        return (left @ right.T).astype(np.int64)
    if most < 2.0**62:
        return left.astype(np.int64) @ right.astype(np.int64).T
    whole = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in right] for x in left]
    return np.array([[min(max(v, _LEAST + 1), -(_LEAST + 1)) for v in row] for row in whole], np.int64).reshape(len(left), len(right))


def selected(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row with their ids, ties to the smaller id; ids rise. Rows of fewer are filled by the least score."""
    k = min(k, scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, at = scores > edge, scores == edge
    take = above | at & (np.cumsum(at, axis=1) <= k - above.sum(1, keepdims=True))
    which = np.nonzero(take)[1].reshape(len(scores), k)
    best = np.take_along_axis(scores, which, 1)
    order = np.lexsort((ids[which], ~best), axis=1)
    return np.take_along_axis(best, order, 1), np.take_along_axis(ids[which], order, 1)


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in a column of the grid, from all its tiles."""
    best: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, block, column, asked, left, ids, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            asked, ids = np.frombuffer(asked, np.int64), np.frombuffer(ids, np.int64)
            left, right = (np.frombuffer(m, np.float64).reshape(-1, dim) for m in (left, right))
            parts = []
            for a in range(0, len(asked), _ROWS):
                scores = _products(left[a : a + _ROWS], right)
                scores[asked[a : a + _ROWS, None] == ids] = _LEAST
                parts.append(selected(scores, ids, k))
            found, names = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            key = (dim, block, column, asked.tobytes())
            if key in best:
                found, names = np.concatenate([best[key][1], found], 1), np.concatenate([best[key][2], names], 1)
                order = np.lexsort((names, ~found), axis=1)[:, :k]
                found, names = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)
            best[key] = asked, found, names
    for (_, _, column, _), (asked, found, names) in best.items():
        real = found > _LEAST
        edges = pa.array(np.append(0, np.cumsum(real.sum(1))), pa.int32())
        lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(~found[real]), pa.array(names[real])], names=["low", "id"]))
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.full(len(asked), column), pa.int32()), lists], names=["query", "part", "best"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, scale: float = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each of ``queries`` (id, vector) its k best of ``candidates`` (id, vector) but itself: query_id, rank from 1, vec_id, score."""
    schema = "dim int, shard long, ids binary, matrix binary"
    asked = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    count = asked.count()
    blocks = -(-count // block) or 1
    rows = candidates.count()
    columns = min(-(-rows // shard) or 1, 1 << 15)
    left = asked.repartition(blocks).mapInArrow(lambda b: _packed(b, block, scale), schema)
    numbered = left.select("dim", F.monotonically_increasing_id().alias("block"), F.col("ids").alias("asked"), F.col("matrix").alias("left"))
    numbered = numbered.withColumn("block", F.pmod("block", F.lit(blocks)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = candidates.mapInArrow(lambda b: _packed(b, shard, scale), schema)
    right = right.withColumn("column", F.pmod(F.xxhash64("shard", "ids"), F.lit(columns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = numbered.join(right.hint("shuffle_hash"), ["dim", "block", "column"])
    lists = met.select("dim", "block", "column", "asked", "left", "ids", "matrix").mapInArrow(lambda b: _tiles(b, k), "query long, part int, best array<struct<low:long,id:long>>")

    def merged():
        return F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")

    while columns > 1:
        columns = -(-columns // _FAN_IN)
        lists = lists.groupBy("query", F.floor(F.col("part") / _FAN_IN).cast("int").alias("part")).agg(merged())
    # a column may be cut over several tasks
    lists = lists.groupBy("query").agg(merged())
    flat = lists.select("query", F.posexplode("best").alias("at", "one"))
    return flat.select(F.col("query").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("vec_id"), F.bitwise_not("one.low").alias("score"))
