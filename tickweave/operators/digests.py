"""Content identity. The digest of a set of rows is the SHA-256 of the number of rows and of
the sums of the words of their hashes: each row is hashed by itself (SHA-256 of its canonical
text), its first sixty hexadecimal digits, a to f read as 0 to 5, are twelve words of five decimal digits, and the words are
summed over the rows. A sum does not depend on order, files or partitions, counts repeated rows, and merges:
every task adds up its own rows and sends one row per run, however long the run is. The sums
are exact in 64 bits for up to 2**46 rows to a run. Text, hashes and sums are plain enough for another engine to
work out the same digest, which the SQL of the registered queries does.

The digest tells content apart that changed by accident or by a new version. It is not a
defence against someone who searches for rows with equal sums. A sequential hash over a
whole run would have to stream it through one task and is not offered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.contract import SCHEMAS, Tables
from tickweave.functions.encoding import texted
from tickweave.functions.scalars import differs

TABLE_ENCODING, RUN_ENCODING = "table-rows/v2", "run-rows/v2"
ROW_COLUMNS = ("plant_id", "quality_flag", "sample_index", "sensor_id", "time_s", "value")
CHANNEL_COLUMNS = ("channel_index", "channel_kind", "noise_model", "noise_std", "sampling_period_s", "unit", "variable_name")
WORDS, DIGITS = 12, 5  # words of a row hash, digits of each


def _decimal_digits(x: Column) -> Column:
    """Fifteen hexadecimal digits, ten to fifteen among them made zero to five, all at once."""
    high = F.shiftleft(x, 1).bitwiseOR(F.shiftleft(x, 2)).bitwiseAND(x).bitwiseAND(F.lit(0x888888888888888))
    return x - high - F.shiftright(high, 2)


def _three_words(d: Column) -> Column:
    """Three words of five decimal digits, a digit in four bits, as three numbers in twenty bits each."""
    lowest = F.lit(0x0000F0000F0000F)
    return reduce(lambda a, b: a + b, [F.shiftright(d, 4 * k).bitwiseAND(lowest) * F.lit(10**k) for k in range(DIGITS)])


def rows_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], header: str, more: Sequence[str] = ()) -> DataFrame:
    """One digest per ``keys`` over ``columns`` and the texts in ``more``: one pass, one partial aggregate."""
    keys = list(keys)
    rows = texted(df, keys, columns, "_text", more).select(*keys, F.sha2(F.col("_text").cast("binary"), 256).alias("_row"))
    # three words are read at a time
    rows = rows.select(*keys, *[F.coalesce(F.conv(F.substring("_row", 3 * DIGITS * i + 1, 3 * DIGITS), 16, 10).cast("long"), F.lit(0)).alias(f"_h{i}") for i in range(WORDS // 3)])
    rows = rows.select(*keys, *[_decimal_digits(F.col(f"_h{i}")).alias(f"_d{i}") for i in range(WORDS // 3)])
    rows = rows.select(*keys, *[_three_words(F.col(f"_d{i}")).alias(f"_t{i}") for i in range(WORDS // 3)])
    words = [F.shiftright(f"_t{i}", 4 * DIGITS * k).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1)) for i in range(WORDS // 3) for k in (2, 1, 0)]
    names = [f"_w{i}" for i in range(WORDS)]
    summed = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(w), F.lit(0)).alias(n) for n, w in zip(names, words, strict=True)]
    )
    parts = [F.lit(header), F.col("n_rows").cast("string"), *[F.col(n).cast("string") for n in names]]
    return summed.select(*keys, "n_rows", F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256).alias("content_sha256"))


def run_digests(tables: Tables) -> DataFrame:
    """Digest of the content of every run: its rows with the position, unit and noise of their channels, whose text is
    worked out once a channel. Where a row is stored or who stored it does not enter."""
    channels = texted(tables.sensors, ["sensor_id"], CHANNEL_COLUMNS, "_channel")
    rows = tables.measurements.join(channels, "sensor_id", "left")
    return rows_digest(rows, ["run_id"], ROW_COLUMNS, RUN_ENCODING, ["_channel"])


def table_digests(tables: Tables) -> DataFrame:
    """Digest and number of rows of each dimension table."""
    parts = None
    for name, df in tables.items():
        if name == "measurements":
            continue
        one = rows_digest(df, [], SCHEMAS[name].names, f"{TABLE_ENCODING} {name}").select(
            F.lit(name).alias("table_name"), "n_rows", "content_sha256"
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def changed_runs(recorded: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Runs whose rebuilt content is not what was recorded, absent content included."""
    a = recorded.select("run_id", F.col("content_sha256").alias("recorded"))
    b = rebuilt.select("run_id", F.col("content_sha256").alias("rebuilt"))
    return a.join(b, "run_id", "left").where(differs("recorded", "rebuilt"))


def recorded_runs(tables: Tables) -> Tables:
    """The tables with the digest of its content written into every run row."""
    found = run_digests(tables).select("run_id", "content_sha256")
    runs = tables.operating_runs.drop("content_sha256").join(found, "run_id", "left")
    return tables.with_(operating_runs=runs.select(SCHEMAS["operating_runs"].names))
