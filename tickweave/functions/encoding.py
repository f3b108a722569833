"""Canonical text of a value: its kind, its length, its content. No two different rows share
a text. A double is written as its whole mantissa of 53 bits and its exponent, "4503599627370497p-52", so nothing is rounded and
any engine with exact powers of two can write the same text; zeros, which keep their sign, infinities and NaN are words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _guess(x: Column) -> Column:
    return F.floor(F.log2(F.abs(x)))


def _scaled(x: Column, guess: Column) -> Column:
    """By a shift for sizes from 2**-10 to 2**52; else in two steps, as one power of two can leave the range of doubles."""
    by = F.lit(52) - guess
    first = F.floor(by / 2)
    shifted = F.call_function("shiftleft", F.lit(1).cast("long"), by.cast("int")).cast("double")
    return F.abs(x) * F.when(by.between(0, 62), shifted).otherwise(F.pow(F.lit(2.0), first)) * F.when(by.between(0, 62), 1.0).otherwise(F.pow(F.lit(2.0), by - first))


def mantissa_exponent(x: Column, guess: Column, scaled: Column) -> Column:
    """Text of a double that is neither zero nor infinite nor NaN. ``guess`` only has to be right to the next integer."""
    shift = F.when(scaled >= float(1 << 53), 1).when(scaled < float(1 << 52), -1).otherwise(0)
    whole = F.when(scaled >= float(1 << 53), scaled / 2).when(scaled < float(1 << 52), scaled * 2).otherwise(scaled).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("p"), (guess + shift - 52).cast("string"))


def texted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, more: Sequence[str] = ()) -> DataFrame:
    """``keys`` and the canonical text of ``columns``, followed by the texts in ``more``. What the text of a double needs several
    times is a column of its own first, so that it is worked out once."""
    doubles = [c for c in columns if isinstance(df.schema[c].dataType, T.DoubleType | T.FloatType)]
    x = {c: F.col(f"`{c}`").cast("double") for c in doubles}
    rows = df.select("*", *[_guess(x[c]).alias(f"_guess_{c}") for c in doubles])
    rows = rows.select("*", *[_scaled(x[c], F.col(f"`_guess_{c}`")).alias(f"_scaled_{c}") for c in doubles])
    return rows.select(*keys, F.concat_ws(",", *[encoded(df.schema[c]) for c in columns], *more).alias(name))


def encoded(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DoubleType | T.FloatType):
        x = c.cast("double")
        special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0.0, x.cast("string"))
        text = F.concat(F.lit("F"), F.coalesce(special, mantissa_exponent(x, F.col(f"`_guess_{field.name}`"), F.col(f"`_scaled_{field.name}`"))))
    elif isinstance(field.dataType, T.IntegralType):
        text = F.concat(F.lit("I"), c.cast("string"))
    elif isinstance(field.dataType, T.StringType):
        text = F.concat(F.lit("S"), F.length(c).cast("string"), F.lit(":"), c)
    else:
        raise TypeError(f"no canonical encoding for {field.name}: {field.dataType.simpleString()}")
    return F.coalesce(text, F.lit("N"))
