"""Best-fit packing of token pieces into sequences, certified by lower bounds of dual-feasible functions.

``pieces`` cuts texts into ids, ``packed`` gives each piece its sequence and offset, ``sequences`` puts the ids together.

A dual-feasible function u maps lengths to [0, 1] so that what fits into one sequence sums up to 1 at most; the sum of u over
all pieces is thus a lower bound of the number of sequences. ``bound`` takes the best of two families from the counts of
lengths. Pieces are dealt at random to groups of about ``group_rows``, and each group is packed by best-fit decreasing. A
group that needs less than one sequence more than its pieces are worth by the best function of all pieces is certified and
keeps all but its emptiest sequence, in which its rounding loss lies. A group with a gap keeps nothing while groups still
grow, later its fullest sequences as long as they lose less than half of one. What a group doesn't keep is exchanged: dealt
anew with what others give up, in groups four times as large for two rounds, and packed again, until one group holds it or
``rounds`` are over; then all stays. Only sizes and row numbers travel in these rounds.

Nulls: a null text counts as empty, and an empty text is one piece of the end id. Repeated rows are pieces of their own. No
rows give no rows. Texts are read in slices of 1 MB cut at white space. Other columns stay, whatever their names; columns
that have a name of the result (piece, start, length, ids; sequence_id, offset, round, certified) are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_tools import written
from .textbytes import SLICE_BYTES, utf8

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 2048, 0
#: Rows of a group in the first round, how often it doubles later, rounds of exchange, and the finest steps that ``bound`` tries.
GROUP_ROWS, GROWTH, ROUNDS, STEPS = 1 << 14, 4, 6, 16
#: The table of ids by chunk of text: number of chunks, and their bytes; words encoded in one call.
_TABLE, _HELD, _CALL = 1 << 19, 16 << 20, 1024
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: What a chunk that isn't lower-cased holds: special tokens, or a lead byte of U+0300 to U+037F.
_UNLIKE = (b"<|", b"\xcc", b"\xcd")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Chunks(dict):
    """Ids of chunks without ASCII white space, as bytes. The vocabulary's normaliser drops white space and nothing composes
    with it, so the ids of a text are those of its chunks. ASCII capitals are lower-cased first, as the normaliser would do,
    but for chunks with marks that could compose with them or with the beginning of a special token. A word of letters with
    ASCII punctuation behind it is its letters and its punctuation, and many such words are encoded in one call: each ends
    with the one token that ends a word. The table is emptied when it is full."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or " "
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for token, i in tokens.items() if token.endswith(suffix)]] = True
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __missing__(self, chunk: bytes) -> bytes:
        self[chunk] = ids = self.encoded(chunk.decode()).tobytes()
        return ids

    def learn(self, chunks: set[bytes]) -> None:
        split, words = [], set()
        for chunk in chunks:
            word = chunk.rstrip(_PUNCTUATION)
            if word.isalpha() or _letters(word):
                split.append((chunk, word))
                if word not in self:
                    if word in self.older:
                        self[word] = self.older[word]
                    else:
                        words.add(word)
        few = list(words)
        for at in range(0, len(few), _CALL):
            some = few[at : at + _CALL]
            ids = self.encoded(b" ".join(some).decode())
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data = ids.tobytes()
                self.update(zip(some, (data[4 * a : 4 * b] for a, b in pairwise([0, *cuts.tolist()])), strict=True))
        for chunk, word in split:
            if len(word) < len(chunk):
                self[chunk] = self[word] + self[chunk[len(word) :]]

    def ids(self, text: bytes) -> bytes:
        if any(x in text for x in _UNLIKE):
            words = [w if any(x in w for x in _UNLIKE) else w.lower() for w in text.split()]
        else:
            words = text.lower().split()
        found = list(map(self.get, words))
        if None not in found:
            return b"".join(found)
        new = {w for w, ids in zip(words, found, strict=True) if ids is None}
        self.held += sum(map(len, new))
        if len(self) + len(new) > _TABLE or self.held > _HELD:
            self.older = dict(self)
            self.clear()
            new, self.held = set(words), 0
        back = set(filter(self.older.__contains__, new))
        self.update((w, self.older[w]) for w in back)
        self.learn(new - back)
        return b"".join(map(self.__getitem__, words))

    def slices(self, text: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[bytes]:
        """Ids of UTF-8 bytes, slice by slice."""
        at = 0
        while at < len(text):
            to = at + limit
            while to < len(text) and not _SPACE[text[to]]:
                gap = np.flatnonzero(_SPACE[text[to : to + limit]])
                to = to + int(gap[0]) if len(gap) else to + limit
            yield self.ids(text[at:to].tobytes())
            at = to


def _letters(word: bytes) -> bool:
    """Whether a word of other than ASCII is letters, and stays so in lower case."""
    text = "" if word.isascii() else word.decode()
    return text.isalpha() and text.lower().isalpha()


@lru_cache(1)
def chunks(vocabulary: str) -> Chunks:
    """One table for all tasks of a worker."""
    return Chunks(vocabulary)


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    known, full, last = chunks(vocabulary), 4 * capacity, np.array([end], "<u4").tobytes()
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        of, piece, ids, held = [], [], [], 0

        def out(of, piece, ids, rows=batch.column(0)):
            piece, length = np.array(piece, np.int32), np.array([len(x) // 4 for x in ids], np.int64)
            return pa.RecordBatch.from_arrays(
                [rows.take(pa.array(of, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length), pa.array(ids, pa.binary())], names=["row", "piece", "start", "length", "ids"]
            )

        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            rest, k = b"", 0
            for part in chain(known.slices(data[a:b]), [last]):
                rest += part
                while len(rest) > full:
                    done = len(rest) // full - (len(rest) % full == 0)
                    for i in range(done):
                        of.append(row), piece.append(k + i), ids.append(rest[i * full : (i + 1) * full])
                    rest, k, held = rest[done * full :], k + done, held + done * full
                    if held > 4 * SLICE_BYTES:
                        yield out(of, piece, ids)
                        of, piece, ids, held = [], [], [], 0
            of.append(row), piece.append(k), ids.append(rest)
            held += len(rest)
            if held > 4 * SLICE_BYTES:
                yield out(of, piece, ids)
                of, piece, ids, held = [], [], [], 0
        if of:
            yield out(of, piece, ids)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The columns of ``docs`` without its text, and piece (from 0), start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit integers). A document is the ids of its text, then ``end``; only one of more than ``capacity`` ids is cut.
    ``vocabulary`` is a file of the ``tokenizers`` library that drops white space, the same for all executors."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    made = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    own = [docs[_quoted(c)] for c in docs.columns if c != "text" and c not in made.names]
    rows = docs.select(F.struct(*own) if own else F.struct(F.lit(0).alias("none")), docs["text"].cast("string")).toDF("row", "text")
    cut = rows.mapInArrow(lambda batches: _cut(batches, vocabulary, capacity, end), T.StructType([rows.schema["row"], *made.fields]))
    return cut.select("row.*", *made.names) if own else cut.select(*made.names)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _families(capacity: int, steps: int = STEPS) -> Iterator[tuple[np.ndarray, int]]:
    """Dual-feasible functions as (numerators by length, denominator)."""
    size = np.arange(capacity + 1, dtype=np.int64)
    yield size, capacity
    for k in range(1, steps + 1):  # rounds (k + 1) x down to whole parts, k of which make a sequence
        whole = (k + 1) * size % capacity == 0
        yield np.where(whole, k * size, (k + 1) * size // capacity * capacity), k * capacity


def bound(counts: np.ndarray, steps: int = STEPS) -> tuple[int, np.ndarray, int]:
    """Of ``counts`` of pieces by length (0 to capacity): the least number of sequences that any packing needs, as far as the
    functions tell, and the best function as (numerators by length, denominator)."""
    capacity = len(counts) - 1
    best = max(((-(-int(counts @ u) // d), int(counts @ u) / d, u, d) for u, d in _families(capacity, steps)), key=lambda x: x[:2])
    # the second family counts pieces over capacity - e as whole sequences and drops those under e
    size, e = np.arange(capacity + 1, dtype=np.int64), np.arange(1, capacity // 2 + 1)
    number, volume = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * size))
    sums = capacity * (number[-1] - number[capacity - e + 1]) + volume[capacity - e + 1] - volume[e]
    if len(e) and int(sums.max()) / capacity > best[1]:
        e = int(e[np.argmax(sums)])
        best = (-(-int(sums.max()) // capacity), 0.0, np.where(size > capacity - e, capacity, np.where(size < e, 0, size)), capacity)
    return best[0], best[2], best[3]


def best_fit(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the given order; each goes where the least room is left that holds it."""
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            one = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, one, used = capacity, used, used + 1
        bins[i], offsets[i] = one, capacity - room
        if room > size:
            open_by_room[room - size].append(one)
            rooms |= 1 << (room - size)
    return bins, offsets


def packed_group(sizes: np.ndarray, capacity: int, u: tuple[np.ndarray, int], state: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Sequence, offset and whether it stays, for each piece of a group whose sizes fall; and whether the group is certified.
    ``u`` is the best function of all pieces; ``state`` is ``last`` (all stay), ``largest`` (groups do not grow any more) or ``growing``."""
    bins, offsets = best_fit(sizes.tolist(), capacity)
    least, (worth_of, whole) = bound(np.bincount(sizes, minlength=capacity + 1))[0], u
    used = int(bins.max()) + 1
    worth, fill = np.zeros(used, np.int64), np.zeros(used, np.int64)
    np.add.at(worth, bins, worth_of[sizes])
    np.add.at(fill, bins, sizes)
    order = np.lexsort((-fill, -worth))  # those that lose least come first
    lost = np.cumsum(whole - worth[order])
    stays = np.ones(used, bool)
    if state != "last" and lost[-1] < whole:
        stays[order[-1]] = fill[order[-1]] == capacity
    elif state == "growing":
        stays[:] = False
    elif state == "largest":
        stays[order[2 * lost > whole]] = False
    return bins, offsets, stays[bins], used == least or bool(lost[-1] < whole)


def _packed(table: pa.Table, capacity: int, u: tuple[np.ndarray, int], round_: int, state: str) -> pa.Table:
    at, size = table.column("at").to_numpy(), table.column("size").to_numpy()
    order = np.lexsort((at, -size))
    bins, offsets, stays, certified = packed_group(size[order], capacity, u, state)
    n = len(at)
    part = table.column("part").to_numpy()[order]
    return pa.table(
        {
            "at": at[order], "size": size[order], "sequence_id": (np.int64(round_) << 58) | (part << 22) | bins, "offset": offsets,
            "round": np.full(n, round_, np.int32), "certified": np.full(n, certified), "stays": stays,
        }
    )


def _group(capacity: int, u: tuple[np.ndarray, int], round_: int, state: str) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _packed(table, capacity, u, round_, state)


def packed(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id, offset, the round after which it stayed (null: it fills a sequence), and whether its group was then
    certified. Lengths outside 1 to capacity are an error."""
    made = ("sequence_id", "offset", "round", "certified")
    fits = F.col("length").between(1, capacity)
    size = F.when(fits, F.col("length").cast("long")).otherwise(F.raise_error(F.lit(f"a length is not within 1 and {capacity}")).cast("long"))
    own = [pieces[_quoted(c)] for c in pieces.columns if c not in made]
    stock = written(pieces.select(F.struct(*own), size, F.monotonically_increasing_id()).toDF("held", "size", "at"), "pieces")
    schema = "at long, size long, sequence_id long, offset long, round int, certified boolean, stays boolean"
    done = [stock.where(F.col("size") == capacity).select("at", (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("int").alias("round"), F.lit(True).alias("certified"))]
    left = stock.where(F.col("size") < capacity).select("at", "size")
    _, *u = bound(counts_by_length(left.withColumnRenamed("size", "length"), capacity))
    for round_ in range(rounds + 1):
        many, rows = left.count(), group_rows << min(2 * round_, GROWTH)
        if not many:
            break
        parts = -(-many // rows)
        state = "last" if parts == 1 or round_ == rounds else "growing" if 2 * round_ < GROWTH else "largest"
        part = F.pmod(F.xxhash64("at", F.lit(round_)), F.lit(parts)).cast("long")
        out = written(left.withColumn("part", part).groupBy("part").applyInArrow(_group(capacity, u, round_, state), schema), f"packed-{round_}")
        done.append(out.where("stays").select("at", *made))
        if state == "last":
            break
        left = out.where("not stays").select("at", "size")
    placed = reduce(DataFrame.unionByName, done)
    return stock.join(placed, "at").select("held.*", *made)


def counts_by_length(pieces: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Number of pieces of each length from 0 to capacity, as ``bound`` takes it."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return counts


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, the pieces of each sequence one after the other. A sequence holds at most its capacity of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, one: F.concat(all_, one["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "certified")
