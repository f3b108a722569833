"""Window functions along a tick axis that never put a whole series into one task.

A plain ``lag(...) OVER (PARTITION BY run ORDER BY tick)`` sends every row of a run to one
task; one run may hold a third of all rows. Here the axis is cut into bands of a fixed
number of ticks. The rows are partitioned by (series, band), and what has to cross a band
edge, the last row before it, the first row after it, the running total up to it, is taken
from a summary of one row per band. The summary is built by a partial aggregate, so its
shuffle is small, and its rows join the data as *edge rows*: one exchange on (series, band)
serves every function asked for, and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 14
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Bands:
    """Series identified by ``keys``, ordered by the integer column ``tick`` and, where
    ticks repeat, by the columns ``ties``."""

    keys: Sequence[str]
    tick: str
    ties: Sequence[str] = ()
    width: int = DEFAULT_WIDTH

    def scan(
        self,
        df: DataFrame,
        lag: Mapping[str, Column | str] | None = None,
        lead: Mapping[str, Column | str] | None = None,
        running: Mapping[str, tuple[str, Column]] | None = None,
        before: Mapping[str, tuple[str, Column]] | None = None,
    ) -> DataFrame:
        """``df`` with, for every row, the values of the previous row (``lag``), of the next
        row (``lead``), and running sum/max/min up to and including the row (``running``:
        name -> (function, column)); ``before`` is the same without the row itself.

        ``df`` is read twice, once for the summary: several functions of one table belong in
        one call, and a table that is scanned repeatedly is cut from its lineage first."""
        lag, lead = dict(lag or {}), dict(lead or {})
        exclusive = set(before or {})
        running = {**(running or {}), **(before or {})}
        keys, names = list(self.keys), df.columns

        def packed(items: Mapping[str, Column | str]) -> Column:
            columns = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in items.items()]
            return F.struct(F.lit(True).alias("_there"), *columns)

        rows = df.withColumn("_band", F.expr(f"`{self.tick}` div {int(self.width)}L"))
        order = F.struct(F.col(self.tick), *[F.col(c) for c in self.ties])
        if lag:
            rows = rows.withColumn("_lag", packed(lag))
        if lead:
            rows = rows.withColumn("_lead", packed(lead))
        for name, (_, column) in running.items():
            rows = rows.withColumn(f"_run_{name}", column)

        summary = []
        if lag:
            summary.append(F.max_by("_lag", order).alias("_lag"))
        if lead:
            summary.append(F.min_by("_lead", order).alias("_lead"))
        summary += [_MERGE[fn](f"_run_{n}").alias(f"_run_{n}") for n, (fn, _) in running.items()]
        per_band = rows.groupBy(*keys, "_band").agg(*summary)
        along = Window.partitionBy(*keys).orderBy("_band")
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)

        # One edge row in front of each band and, for lead, one behind it.
        front = per_band.select(
            *keys,
            "_band",
            F.lit(0).alias("_side"),
            *([F.lag("_lag").over(along).alias("_lag")] if lag else []),
            *([F.lead("_lead").over(along).alias("_next")] if lead else []),
            *[_MERGE[fn](f"_run_{n}").over(earlier).alias(f"_run_{n}") for n, (fn, _) in running.items()],
        )
        if lead:
            edges = front.select(
                *keys,
                "_band",
                F.explode(F.array(F.lit(0), F.lit(2))).alias("_side"),
                *(["_lag"] if lag else []),
                F.col("_next").alias("_lead"),
                *[f"_run_{n}" for n in running],
            )
            if running:  # totals enter once, with the row in front
                for n in running:
                    edges = edges.withColumn(f"_run_{n}", F.when(F.col("_side") == 0, F.col(f"_run_{n}")))
        else:
            edges = front
        both = rows.withColumn("_side", F.lit(1)).unionByName(edges, allowMissingColumns=True)

        inside = Window.partitionBy(*keys, "_band").orderBy("_side", self.tick, *self.ties)
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = [F.col(c) for c in names]
        if lag:
            both = both.withColumn("_before", F.lag("_lag").over(inside))
            out += [F.col(f"_before.{n}").alias(n) for n in lag]
        if lead:
            both = both.withColumn("_after", F.lead("_lead").over(inside))
            out += [F.col(f"_after.{n}").alias(n) for n in lead]
        for name, (fn, _) in running.items():
            frame = inside.rowsBetween(Window.unboundedPreceding, -1) if name in exclusive else upto
            both = both.withColumn(f"_upto_{name}", _MERGE[fn](f"_run_{name}").over(frame))
            out.append(F.col(f"_upto_{name}").alias(name))
        return both.where(F.col("_side") == 1).select(*out)


@dataclass(frozen=True)
class Neighbourhood:
    """Bands for functions that look a bounded number of ticks back and ahead. Every row is
    sent to the bands whose ticks can see it, so one exchange and a plain window inside each
    band are exact; rows near an edge are copied, (back + ahead) / width of them."""

    keys: Sequence[str]
    tick: str
    back: int
    ahead: int
    width: int = DEFAULT_WIDTH

    def spread(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_band`` and ``_home``, true for the copy a result is taken from."""
        t, w = F.col(self.tick), F.lit(int(self.width))
        bands = F.sequence(F.floor((t - self.ahead) / w), F.floor((t + self.back) / w))
        return df.withColumn("_band", F.explode(bands)).withColumn("_home", F.col("_band") == F.floor(t / w))

    def window(self):
        return Window.partitionBy(*self.keys, "_band").orderBy(self.tick)

    @staticmethod
    def gather(df: DataFrame) -> DataFrame:
        return df.where("_home").drop("_band", "_home")


def number_rows(df: DataFrame, keys: Sequence[str], tick: str, name: str, ties: Sequence[str] = (),
                width: int = DEFAULT_WIDTH) -> DataFrame:
    """1-based position of each row in its series."""
    return Bands(keys, tick, ties, width).scan(df, running={name: ("sum", F.lit(1).cast("long"))})
