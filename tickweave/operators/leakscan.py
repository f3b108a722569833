"""Scan of published tables and documents for what must not be in them: names that speak of
hidden things, numbers equal to hidden values, forbidden text."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words forbidden in names, text forbidden in values, the relative tolerance of
# a hidden parameter, and the fields whose values the contract fixes.
FORBIDDEN_IN_NAMES = (
    "seed", "stream", "true", "truth", "exact", "error", "hidden", "k0", "saturation", "activation", "ua_ref", "alpha",
    "t_ref", "steady", "initial_state", "peak", "residual", "derivative",
)
FORBIDDEN_IN_TEXT = ("true_physics", "sensor_master_seed", "saturation_constant", "UA_ref")
RELATIVE_TOLERANCE = 1.0e-12
STRUCTURAL_FIELDS = (
    "sample_index", "channel_index", "quality_flag", "n_samples", "rows", "n_rows", "n_channels", "schema_version", "version",
    "ticks_since_previous", "time_s", "start_time_s", "end_time_s", "sampling_period_s", "seconds_since_previous",
)
LEAF_SCHEMA = "document string, trail string, field string, kind string, text string, number double, integer bigint"


def forbidden_names(names: DataFrame, words: Sequence[str] = FORBIDDEN_IN_NAMES) -> DataFrame:
    """(.., word): names, in any case, that contain a forbidden word. The words are a declared
    list, so each row carries them as an array; nothing is joined."""
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("name"), w))
    return names.withColumn("word", F.explode(found))


def column_names(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(place, name): columns and column metadata of tables, known from their schemas."""
    rows = []
    for table, df in tables.items():
        for field in df.schema:
            rows.append((table, field.name))
            rows += [(f"{table}.{field.name} metadata", key) for key in (field.metadata or {})]
    return spark.createDataFrame(rows, "place string, name string")


def parquet_metadata(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(place, name, text): key-value metadata of Parquet footers, file level and column
    level. The footers are read on the executors, one file list split over tasks."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for path in batch["path"]:
                filesystem, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
                with filesystem.open_input_file(inner) as handle:
                    schema = pq.read_schema(handle)
                name = inner.rsplit("/", 1)[-1]
                out += [(f"{name} metadata", k.decode(), v.decode("utf-8", "replace")) for k, v in (schema.metadata or {}).items()]
                for field in schema:
                    out += [(f"{name} metadata", f"{field.name}:{k.decode()}", v.decode("utf-8", "replace")) for k, v in (field.metadata or {}).items()]
            yield pd.DataFrame(out, columns=["place", "name", "text"])

    return listed.mapInPandas(footers, "place string, name string, text string")


def free_columns(df: DataFrame, kinds: tuple[type, ...], structural: Sequence[str] = STRUCTURAL_FIELDS) -> list[str]:
    """Columns of some types whose values the contract does not fix."""
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in structural]


def _cells(df: DataFrame, cells: list[tuple[str, str]], name: str, condition) -> DataFrame:
    """(column, name, n): rows that meet the condition of each (column, name), in one pass."""
    if not cells:
        return df.sparkSession.createDataFrame([], f"`column` string, {name} string, n bigint")
    counts = df.agg(*[F.count_if(condition(c, k)).alias(f"n{i}") for i, (c, k) in enumerate(cells)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias(name), F.col(f"n{i}").alias("n")) for i, (c, k) in enumerate(cells)])
    return counts.select(F.inline(entries)).where(F.col("n") > 0)


def hidden_parameters(df: DataFrame, secrets: dict[str, float]) -> DataFrame:
    """(column, label, n): free floating columns that hold a hidden parameter to a relative
    1e-12. Declared secrets are a few literals: one pass, one aggregate, no join."""
    bad = [k for k, v in secrets.items() if v == 0.0 or v != v or abs(v) == float("inf")]
    if bad:
        raise ValueError(f"these hidden values cannot be searched for: {bad}")
    cells = [(c, k) for c in free_columns(df, (T.DoubleType, T.FloatType)) for k in secrets]
    return _cells(df, cells, "label", lambda c, k: F.abs(F.col(c) - secrets[k]) <= F.lit(RELATIVE_TOLERANCE * abs(secrets[k])))


def hidden_states(df: DataFrame, states: DataFrame) -> DataFrame:
    """(column, n): values equal, bit for bit, to one of many hidden states. Values are
    counted per column before they meet the states, so a repeated value is one row."""
    columns = free_columns(df, (T.DoubleType,))
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long = df.select(F.inline(entries)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # most readings differ, so they meet the secrets before anything is counted
    return long.join(states.select("value").distinct(), "value", "left_semi").groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def hidden_integers(df: DataFrame, secrets: dict[str, int]) -> DataFrame:
    cells = [(c, k) for c in free_columns(df, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in secrets]
    return _cells(df, cells, "label", lambda c, k: F.col(c) == F.lit(secrets[k]))


def forbidden_text(df: DataFrame, words: Sequence[str] = FORBIDDEN_IN_TEXT) -> DataFrame:
    """(column, word, n): string columns whose values mention a forbidden text, whole values
    searched, any case."""
    cells = [(c, w) for c in free_columns(df, (T.StringType,)) for w in words]
    return _cells(df, cells, "word", lambda c, w: F.contains(F.lower(c), F.lit(w.lower())))


def _walk(document: str, node: object, trail: str, field: str, out: list) -> None:
    """Leaves and keys of one parsed document, with the nearest key above each."""
    stack = [(node, trail, field)]
    while stack:
        here, path, name = stack.pop()
        if isinstance(here, dict):
            for key, value in here.items():
                out.append((document, path, str(key), "key", str(key), None, None))
                stack.append((value, f"{path}/{key}", str(key)))
        elif isinstance(here, list):
            stack += [(value, f"{path}[{i}]", name) for i, value in enumerate(here)]
        elif isinstance(here, bool) or here is None:
            continue
        elif isinstance(here, int):
            small = -(2**63) <= here < 2**63
            # a number of more digits than Python turns into text is told by its size alone
            text = str(here) if here.bit_length() < 10_000 else f"an integer of {here.bit_length()} bits"
            out.append((document, path, name, "integer", text, float(here) if here.bit_length() < 1024 else None, here if small else None))
        elif isinstance(here, float):
            out.append((document, path, name, "float", repr(here), here, None))
        else:
            out.append((document, path, name, "text", here, None, None))


def walk_documents(documents: DataFrame) -> DataFrame:
    """Keys and scalar leaves of JSON documents (document, json), to any depth. Each document
    is walked by itself inside the tasks; a text that is not JSON, or is nested or long beyond
    what the parser takes, gives one ``invalid`` row with the whole text, which is searched as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for document, text in zip(batch["document"], batch["json"], strict=True):
                try:
                    found: list = []
                    _walk(document, json.loads(text), "", "", found)
                    out += found
                except (ValueError, TypeError, RecursionError, OverflowError):
                    out.append((document, "", "", "invalid", text, None, None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in LEAF_SCHEMA.split(", ")])
            frame["integer"] = frame["integer"].astype("Int64")
            yield frame

    return documents.select(F.col("document").cast("string"), "json").mapInPandas(run, LEAF_SCHEMA)


def document_findings(leaves: DataFrame, parameters: dict[str, float], integers: dict[str, int], states: DataFrame | None = None) -> DataFrame:
    """(document, trail, finding): forbidden names and text, hidden numbers of the walked
    documents. Structural fields are examined by name, not by value."""
    free = ~F.col("field").isin(*STRUCTURAL_FIELDS)
    names = forbidden_names(leaves.where(F.col("kind") == "key").withColumn("name", F.col("text")))
    parts = [names.select("document", "trail", F.concat(F.lit("name "), "name", F.lit(" contains "), "word").alias("finding"))]
    words = F.filter(F.array(*[F.lit(w) for w in FORBIDDEN_IN_TEXT]), lambda w: F.contains(F.lower("text"), F.lower(w)))
    parts.append(leaves.where(F.col("kind").isin("text", "invalid") & free).select("document", "trail", F.explode(words).alias("w")).select("document", "trail", F.concat(F.lit("text mentions "), "w").alias("finding")))
    floats = leaves.where((F.col("kind") == "float") & free)

    def labelled(rows: DataFrame, secrets: dict, match) -> DataFrame:
        hits = F.array_compact(F.array(*[F.when(match(v), k) for k, v in secrets.items()]))
        return rows.select("document", "trail", F.explode(hits).alias("k")).select("document", "trail", F.concat(F.lit("holds "), "k").alias("finding"))

    if parameters:
        parts.append(labelled(floats, parameters, lambda v: F.abs(F.col("number") - v) <= F.lit(RELATIVE_TOLERANCE * abs(v))))
    if integers:
        parts.append(labelled(leaves.where((F.col("kind") == "integer") & free), integers, lambda v: F.col("integer") == F.lit(v)))
    if states is not None:
        hidden = states.select(F.col("value").alias("number")).distinct()
        parts.append(floats.join(hidden, "number", "left_semi").select("document", "trail", F.lit("equals a hidden state").alias("finding")))
    return reduce(DataFrame.unionByName, parts)


def table_findings(df: DataFrame, parameters: dict[str, float], integers: dict[str, int], states: DataFrame) -> DataFrame:
    """All value findings of one table as (column, finding, n)."""
    def shaped(found: DataFrame, text: Column) -> DataFrame:
        return found.select("column", text.alias("finding"), F.col("n").cast("long").alias("n"))

    return (
        shaped(hidden_parameters(df, parameters), F.concat(F.lit("holds "), "label"))
        .unionByName(shaped(hidden_states(df, states), F.lit("equals a hidden state")))
        .unionByName(shaped(hidden_integers(df, integers), F.concat(F.lit("holds "), "label")))
        .unionByName(shaped(forbidden_text(df), F.concat(F.lit("mentions "), "word")))
    )
