"""A small log by formula: the plants ``north`` and ``south``, each with the run of one definition, of unequal length."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.contract import CHANNELS, KNOWN_PARAMETERS, NOISE_MODEL, PERIOD_S, SCHEMAS, Tables

START_S = 30.0
NORTH, SOUTH = "north.p3.e4.x2.n0", "south.p3.e4.x2.n0"
LENGTHS = {NORTH: 6, SOUTH: 9}
#: What each channel reads at a tick; the south runs a little hotter and steeper.
READINGS = {
    "C_A": lambda k, south: 120.0 + k * k + south * k,
    "T": lambda k, south: 340.0 + 0.25 * k + 4.0 * south,
    "q": lambda k, south: 0.003,
    "C_Af": lambda k, south: 480.0,
    "T_f": lambda k, south: 345.0,
    "T_c": lambda k, south: 330.0 if k < 5 else 333.0,
}


def log(spark, lengths=None, readings=None, start=START_S):
    """The contract tables of runs {run_id: number of ticks}; ``readings`` replaces formulas of channels."""
    lengths, shown = lengths or LENGTHS, READINGS | (readings or {})
    plants = sorted({run.partition(".")[0] for run in lengths})
    runs, long = [], []
    for run, n in lengths.items():
        plant, _, rest = run.partition(".")
        runs.append((run, plant, "formulas", rest.partition(".")[0], "by formula", start, start + PERIOD_S * (n - 1), PERIOD_S, n, "ab" * 32))
        for name, show in shown.items():
            long += [(plant, run, f"{plant}.{name}", k, start + PERIOD_S * k, float(show(k, plant == "south")), 0) for k in range(n)]
    made = {
        "plants": [(p, p.title(), "tank") for p in plants],
        "process_parameters": [(p, name, 2.0 + i, unit) for p in plants for i, (name, unit) in enumerate(KNOWN_PARAMETERS)],
        "sensors": [(f"{p}.{v}", p, v, kind, i, unit, PERIOD_S, NOISE_MODEL if noise is not None else None, noise) for p in plants for v, kind, i, unit, noise in CHANNELS],
        "operating_runs": runs,
        "measurements": long,
    }
    free = {name: T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]) for name, schema in SCHEMAS.items()}
    return Tables(**{name: spark.createDataFrame(rows, free[name]) for name, rows in made.items()})


def altered(table, condition, **expressions):
    """A change of some columns, as SQL text, where a condition holds."""

    def change(tables):
        df = getattr(tables, table)
        return tables.with_(**{table: df.select(*(F.expr(f"CASE WHEN {condition} THEN {expressions[c]} ELSE {c} END").cast(df.schema[c].dataType).alias(c) if c in expressions else c for c in df.columns))})

    return change


def doubled(table, condition):
    return lambda tables: tables.with_(**{table: getattr(tables, table).unionByName(getattr(tables, table).where(condition))})


def without(table, condition):
    return lambda tables: tables.with_(**{table: getattr(tables, table).where(f"NOT ({condition})")})
