"""Exact medians of groups of any size, by narrowing. A group's bracket holds the values that may still be the median; as long as it
holds more than ``most`` different values, cut points of a quantile sketch split it into cells, the rows of each cell are
counted, and only the cells of the middle ranks stay. Then the few values that are left are ordered. So no task orders more
than ``most`` values of a group, however large the group is; a group of n values takes about log(n / most) / log(cells / 2) rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.stats import midpoint
from tickweave.session import staged

#: Different values that are ordered at once, and cells of a round.
MOST, CELLS = 1 << 16, 64


def _within(value: Column) -> Column:
    return value.between(F.col("_from"), F.col("_to"))


def narrowed(counted: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str, cells: int = CELLS) -> DataFrame:
    """One round: ``brackets`` (keys, _size, _below, _values, _from, _to) with only the cells that hold a middle rank left.
    ``counted`` holds each value of a group once, with its number of rows ``_n``."""
    keys = list(keys)
    near = counted.join(brackets, keys).where(_within(F.col(value)))
    cuts = near.groupBy(*keys).agg(F.percentile_approx(value, [k / cells for k in range(1, cells)], 10 * cells).alias("_cuts"))
    placed = near.join(cuts, keys).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    filled = placed.groupBy(*keys, "_cell").agg(
        F.sum("_n").alias("_rows"), F.count("*").alias("_values"), F.min(value).alias("_from"), F.max(value).alias("_to"), F.first("_size").alias("_size"), F.first("_below").alias("_start")
    )
    upto = F.col("_start") + F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_cell"))  # a row a cell
    middle = filled.withColumn("_upto", upto).where((F.col("_upto") >= F.expr("(_size + 1) div 2")) & (F.col("_upto") - F.col("_rows") < F.expr("_size div 2 + 1")))
    return middle.groupBy(*keys).agg(
        F.first("_size").alias("_size"), F.min(F.col("_upto") - F.col("_rows")).alias("_below"), F.sum("_values").alias("_values"), F.min("_from").alias("_from"), F.max("_to").alias("_to")
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", most: int = MOST, cells: int = CELLS) -> DataFrame:
    """The median of ``value`` by ``keys``; nulls don't count, and a group without other values has no row."""
    if most < 3 or cells < 4:
        raise ValueError("fewer values or cells might not narrow a bracket any more")
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    brackets = counted.groupBy(*keys).agg(
        F.sum("_n").alias("_size"), F.lit(0).cast("long").alias("_below"), F.count("*").alias("_values"), F.min(value).alias("_from"), F.max(value).alias("_to")
    )
    wide = F.col("_values") > most
    if not brackets.where(wide).isEmpty():
        counted, brackets = staged(counted, "counted"), staged(brackets, "brackets")
        while not brackets.where(wide).isEmpty():
            brackets = staged(brackets.where(~wide).unionByName(narrowed(counted, brackets.where(wide), keys, value, cells)), "brackets")
    left = counted.join(brackets, keys).where(_within(F.col(value)))
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    ranked = left.withColumn("_last", upto).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    low, high = F.expr("(_size + 1) div 2"), F.expr("_size div 2 + 1")
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(low.between(F.col("_first"), F.col("_last")), F.col(value))).alias("_lo"),
        F.max(F.when(high.between(F.col("_first"), F.col("_last")), F.col(value))).alias("_hi"),
    )
    return picked.select(*keys, midpoint(F.col("_lo"), F.col("_hi")).alias(name))
