"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder as a state machine.

The vocabulary is a file of the ``tokenizers`` library: merges with an end-of-word suffix over byte-level symbols. A text
is cut at special tokens, normalised (composed, white space joined, lower case) and split into words, which no merge
crosses. What a merge decides about a place depends on what follows only through chains of merges of ever higher
priority, so the merge list bounds how many symbols have to be seen: ``Bpe.lookahead``. A word of any length is thus
encoded through a window: tokens that end at least the lookahead before the window's end are stable and leave it, and the
next window begins where they end. What stands between spaces is looked up in a bounded table first, whole, then by words.

Nulls: a null text is encoded as an empty one, to no tokens. Repeated rows are answered one by one; other columns, of any name, stay in ``row``.
Characters are classed and lower-cased by Python's Unicode tables; code points that these don't assign yet may fall to another word.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import named, shape
from .textbytes import slices, utf8

VOCABULARY = "word_bpe_49k.json"
#: Characters of text taken at a time, symbols of a window besides the lookahead, longest word and number of words in the table.
_PIECE, _WINDOW, _LONG, _TABLE = 1 << 20, 256, 64, 1 << 18
#: A merge is an integer, its rank above the bits of the token that it makes; no merge is above all.
_TOKEN_BITS, _NONE = 32, 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or for the others the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Bpe:
    """A vocabulary with its merges."""

    def __init__(self, vocabulary: str) -> None:
        said = json.loads(vocabulary)
        model = said["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.end, self.special = end, {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.first = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {(ids[a], ids[b]): rank << _TOKEN_BITS | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.lookahead = self._lookahead([(ids[a], ids[b], ids[a + b]) for a, b in merges])
        (pattern,) = (p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> _Table:
        """Known words; as a worker keeps what is broadcast to it, its tasks share them."""
        return _Table(self)

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        """Symbols after a token that can still decide whether it stays.

        A merge takes its right part from the text; that part must not be taken by a merge of higher priority with what
        follows, through any token on its right edge, and so on. The merges come by falling priority.
        """
        length = {i: 1 for i in (*self.first, *self.last)}
        right_of: dict[int, int] = {}
        reach: dict[int, int] = {}
        for left, right, whole in merges:
            furthest, edge = 0, right
            while edge is not None:
                furthest = max(furthest, reach.get(edge, 0))
                edge = right_of.get(edge)
            length[whole] = length[left] + length[right]
            right_of[whole] = right
            reach[left] = max(reach.get(left, 0), length[right] + furthest)
        return max(reach.values(), default=0)

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of some symbols, those of the highest priority first, from the left.

        Many symbols are merged in rounds, all of a priority at once; of few, one pair at a time, where only its neighbours change.
        """
        merge = self.merge.get
        pairs = [merge(p, _NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        while len(pairs) >= _LONG and (best := min(pairs)) != _NONE:
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and pairs[i] == best:
                    out.append(best & (1 << _TOKEN_BITS) - 1)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
            pairs = [merge(p, _NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        ids = ids[:]
        while pairs and (best := min(pairs)) != _NONE:
            i = pairs.index(best)
            ids[i] = whole = best & (1 << _TOKEN_BITS) - 1
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merge((ids[i - 1], whole), _NONE)
            if i < len(pairs):
                pairs[i] = merge((whole, ids[i + 1]), _NONE)
        return ids

    def word(self, word: str) -> Iterator[list[int]]:
        """Tokens of a word, as soon as they are stable."""
        raw = word.encode()
        at, n = 0, len(raw)
        while at < n:
            to = min(n, at + _WINDOW + self.lookahead)
            symbols = [self.first[b] for b in raw[at:to]]
            if to == n:
                symbols[-1] = self.last[raw[-1]]
                yield self.merged(symbols)
                return
            stable, seen = [], 0
            for token in self.merged(symbols):
                size = self._size(token)
                if at + seen + size > to - self.lookahead:
                    break
                stable.append(token)
                seen += size
            yield stable
            at += seen

    def _size(self, token: int) -> int:
        return len(self.tokens[token].removesuffix(self.end))


class _Table(dict):
    """Words, and what stands between spaces, with their ids as little-endian unsigned 32-bit integers.

    A full table becomes the older one, from which what is met again is taken over; so frequent words stay.
    """

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe, self.older = bpe, {}
        self.words = regex.compile(bpe.pattern.replace(r"\s", r"\p{White_Space}")).findall

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            words = self.words(chunk)
            if words == [chunk]:
                return self._word(chunk)
            ids = b"".join([self.get(w) or self._word(w) for w in words])
        return self._kept(chunk, ids)

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if len(word) > _LONG:
                return b"".join(np.array(part, "<u4").tobytes() for part in self.bpe.word(word))
            raw = word.encode()
            symbols = [self.bpe.first[b] for b in raw]
            symbols[-1] = self.bpe.last[raw[-1]]
            ids = self.bpe.merged(symbols)
            ids = struct.pack(f"<{len(ids)}I", *ids)
        return self._kept(word, ids)

    def _kept(self, key: str, ids: bytes) -> bytes:
        if len(key) <= _LONG:
            if len(self) >= _TABLE:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Text in, ids out in pieces; keeps nothing but the vocabulary's table of words."""

    def __init__(self, bpe: Bpe) -> None:
        self.table = bpe.table
        self.split = re.compile("(" + "|".join(map(re.escape, bpe.special)) + ")") if bpe.special else None
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in bpe.special.items()}
        self.spaces = regex.compile(r"\p{White_Space}")

    def pieces(self, text: str) -> Iterator[bytes]:
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                to = at + _PIECE
                if to < len(part):
                    gap = self.spaces.search(part, to)
                    to = gap.start() if gap else len(part)
                yield from self._piece(part[at:to])
                at = to

    def _piece(self, text: str) -> Iterator[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma is lower-cased without regard to its place
        yield b"".join(map(self.table.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def __call__(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


class Decoder:
    """Ids in, text out as soon as it is certain.

    ``plain`` joins the tokens by spaces as the library does for a vocabulary without a decoder. Else tokens become bytes,
    ends of words spaces, and an unfinished character waits for its other bytes.
    """

    def __init__(self, bpe: Bpe, plain: bool = True) -> None:
        self.plain, self.begun = plain, False
        if plain:
            self.tokens = bpe.tokens
        else:
            byte = {s: b for b, s in enumerate(byte_symbols())}
            special = {*bpe.special}
            self.tokens = [t.encode() if t in special else bytes(byte[c] for c in t.removesuffix(bpe.end)) + (b" " if bpe.end and t.endswith(bpe.end) else b"") for t in bpe.tokens]
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if not self.plain:
            return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))
        text = " ".join(map(self.tokens.__getitem__, ids))
        if text and self.begun:
            text = " " + text
        self.begun |= bool(text)
        return text

    def end(self) -> str:
        return "" if self.plain else self.state.decode(b"", True)


def load(path: str | None = None) -> Bpe:
    """Reads a vocabulary; without a path that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return Bpe(file.read())


def _encode(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(bpe)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            ids = [encoder(data[a:b].tobytes().decode()) for a, b in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(ids, pa.binary())], names=["row", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], bpe: Bpe, plain: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            texts = []
            for a, b in zip(offsets[first:last].tolist(), offsets[first + 1 : last + 1].tolist(), strict=True):
                decoder, parts = Decoder(bpe, plain) if plain or not texts else decoder, []
                parts = [decoder.feed(np.frombuffer(data[i : min(b, i + 4 * _PIECE)].tobytes(), "<u4").tolist()) for i in range(a, b, 4 * _PIECE)]
                texts.append("".join([*parts, decoder.end()]))
                if not plain:
                    decoder.state.reset()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(texts, pa.string())], names=["row", "ids", "decoded"])


def encoded(docs: DataFrame, bpe: Bpe | None = None) -> DataFrame:
    """``row``, a struct of the columns of ``docs`` without its text, and ``ids``, little-endian unsigned 32-bit integers."""
    own = docs.sparkSession.sparkContext.broadcast(bpe or load())
    rows = docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _encode(batches, own.value), shape(rows.schema["row"], "ids binary"))


def decoded(ids: DataFrame, bpe: Bpe | None = None, plain: bool = True) -> DataFrame:
    """``row``, ``ids`` and the text that the ids stand for."""
    own = ids.sparkSession.sparkContext.broadcast(bpe or load())
    return ids.select("row", "ids").mapInArrow(lambda batches: _decode(batches, own.value, plain), shape(ids.schema["row"], "ids binary, decoded string"))


def _both(batches: Iterator[pa.RecordBatch], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    # a slice at a time, so that the vocabulary is held once by a task
    for batch in _encode(batches, bpe):
        yield from _decode(iter([batch]), bpe, True)


def transcoded(docs: DataFrame, bpe: Bpe | None = None) -> DataFrame:
    """``encoded`` and ``decoded`` in one pass: ``row``, ``ids`` and the text that the ids stand for."""
    own = docs.sparkSession.sparkContext.broadcast(bpe or load())
    rows = docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _both(batches, own.value), shape(rows.schema["row"], "ids binary, decoded string"))


def digest(texts: DataFrame) -> DataFrame:
    return texts.select(
        "row.doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
