"""Divergence of the sources of a language from each other, by run-length columns of term counts.

A document's terms are runs of ASCII letters and of all that is not ASCII, A-Z lower-cased. A language keeps the terms that
occur in at least ``least`` of its documents. A group, of one language and one source, gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, with N the sum of its counts and V the number of kept terms.

Counts: tasks count the terms of many documents in tables of bounded size before anything is shuffled, so a frequent term or
a hot source sends a row a table. Two sources are compared over blocks of the vocabulary: a block holds as many terms as fit into
``cells`` counts with all sources of the language. Within a block terms are put in order of their counts, source by source, so
that terms of equal counts, zero above all, lie together. Each source's column is then a list of runs, p is worked out once a run, and a
pair's sum is taken over the intersected runs, |p - q| times their length. Sums of blocks are added up.

Nulls: null text, lang and source count as ''. Documents without terms still make their group known. Repeated rows are documents
of their own. No rows give no rows. Texts are read in slices of 1 MB cut between terms. Only the columns named here are read, so
other columns of any name do no harm. Integers are exact: shares come from decimals and Python's integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import written
from .textbytes import SLICE_BYTES, utf8

LEAST, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Counts of a block, entries and bytes of a task's table.
CELLS, ENTRIES, HELD = 1 << 16, 1 << 18, 32 << 20
#: Bytes of terms, lower-cased; all others become a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes, letters: bytes = LETTERS, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time. ``letters`` maps bytes to those of terms or to a space."""
    at = 0
    while at < len(text):
        to = at + limit
        if to < len(text):
            clean = text[at:to].translate(letters)
            while not clean.endswith(b" ") and to < len(text):  # up to the end of the term
                more = text[to : to + limit].translate(letters)
                gap = more.find(b" ")
                clean, to = (clean + more, to + len(more)) if gap < 0 else (clean + more[: gap + 1], to + gap + 1)
        else:
            clean = text[at:].translate(letters)
        yield clean.split()
        at = to


def _counted(batches: Iterator[pa.RecordBatch], entries: int, held: int) -> Iterator[pa.RecordBatch]:
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = number = 0

    def out() -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, docs[term]) for (lang, source), (counts, docs) in tables.items() for term, n in counts.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        data, offsets = utf8(batch.column(2))
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, a, b in zip(langs, sources, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            counts, docs = tables.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(data[a:b].tobytes()):
                before = len(counts)
                counts.update(terms)
                new = set(terms) - seen
                docs.update(new)
                if b - a > SLICE_BYTES:
                    seen |= new
                number += len(counts) - before
                size += sum(map(len, new))
            if number > entries or size > held:
                if number:
                    yield out()
                tables.clear()
                size = number = 0
    if number:
        yield out()


def counted(docs: DataFrame, entries: int = ENTRIES, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    texts = docs.select(_named("lang"), _named("source"), F.col("text").cast("string"))
    parts = texts.mapInArrow(lambda batches: _counted(batches, entries, held), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def kept(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, all_n (of the language) and first (once a term) for terms in at least ``least`` documents of the language."""
    term = Window.partitionBy("lang", "term")
    of_lang = counts.withColumns({"all_n": F.sum("n").over(term), "all_docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return of_lang.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "all_n", "first")


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), all_total (N of the language), terms (V), sources (of the language)."""
    known = docs.select(_named("lang"), _named("source")).distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"))
    each = known.join(own, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    of_lang = each.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("terms").alias("terms"), F.count("*").alias("sources"))
    return each.drop("terms").join(of_lang, "lang")


def share(n: Column, total: Column, terms: Column) -> Column:
    wide = [c.cast("decimal(25,0)") for c in (n, total, terms)]
    return F.lit(1).cast("long") + F.call_function("div", (wide[0] + SMOOTH) * F.lit(SCALE), wide[1] + wide[2] * SMOOTH)


def over_used(terms: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Terms that a group uses more than its language does, the ``ranks`` largest differences of each group."""
    met = terms.join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = met.select("lang", "source", "term", value.alias("value")).where("n > 0 and value > 0").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def runs(columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns with their rows reordered, so that equal counts lie together, and where the runs of each column begin."""
    columns = columns[np.lexsort(columns.T[::-1])] if columns.size else columns
    edges = np.ones(columns.shape, bool)
    edges[1:] = columns[1:] != columns[:-1]
    return columns, [np.flatnonzero(edges[:, k]) for k in range(columns.shape[1])]


def pair_sums(columns: np.ndarray, totals: list[int], vocabulary: int) -> Iterator[tuple[int, int, int]]:
    """For each two columns a < b the sum of the differences of their shares over the rows of ``columns`` (terms by sources)."""
    columns, starts = runs(columns)
    shares = [np.array([1 + SCALE * (c + SMOOTH) // (total + SMOOTH * vocabulary) for c in columns[at, k].tolist()], np.int64) for k, (at, total) in enumerate(zip(starts, totals, strict=True))]
    for a in range(len(starts)):
        for b in range(a + 1, len(starts)):
            both = np.union1d(starts[a], starts[b])
            lengths = np.diff(np.append(both, len(columns)))
            p, q = (shares[k][np.searchsorted(starts[k], both, "right") - 1] for k in (a, b))
            yield a, b, int(np.abs(p - q) @ lengths)


def _block(table: pa.Table) -> pa.Table:
    heads = table.filter(pa.compute.is_null(table.column("term")))
    heads = heads.take(pa.compute.sort_indices(heads, [("total", "descending"), ("source", "ascending")]))
    sources, totals, lang = heads.column("source"), heads.column("total").to_pylist(), table.column("lang")[0]
    entries = table.filter(pa.compute.is_valid(table.column("term")))
    rows = entries.column("term").combine_chunks().dictionary_encode()
    columns = np.zeros((len(rows.dictionary), len(sources)), np.int64)
    columns[rows.indices.to_numpy(), pa.compute.index_in(entries.column("source"), sources.combine_chunks()).to_numpy()] = entries.column("n").to_numpy()
    made = list(pair_sums(columns, totals, heads.column("terms")[0].as_py() if len(heads) else 0))
    a, b, value = (pa.array([m[i] for m in made], pa.int64()) for i in range(3))
    return pa.table({"lang": pa.array([lang.as_py()] * len(made), pa.string()), "source": sources.take(a), "item": sources.take(b), "value": value})


def between(terms: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """Each source against each other one of its language, over all kept terms, the most different first."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.lit(64), F.floor(F.lit(cells) / F.col("sources")))))
    dealt = groups.withColumn("blocks", blocks.cast("long"))
    heads = dealt.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "terms")
    of_lang = dealt.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    entries = terms.join(of_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"))
    parts = heads.unionByName(entries).groupBy("lang", "block").applyInArrow(_block, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, cells: int = CELLS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank of ``documents`` (lang, source, text)."""
    terms = written(kept(counted(docs), least), "kept-terms")
    known = written(groups(docs, terms), "groups")
    return between(terms, known, cells).unionByName(over_used(terms, known, ranks))
