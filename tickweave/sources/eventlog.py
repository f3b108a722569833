"""Contract tables derived from generic event and order tables.

``event_log``   events -> a sensor log of paired plants (runs, ticks, six channels);
``planted``     the same log with defects planted by event number;
``registry``    customers, parts and orders -> plants, parameters, channels and runs, with
                defects planted by key. It grows with the input and has no measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.contract import CHANNELS, INPUTS, KNOWN_PARAMETERS, NOISE_MODEL, PERIOD_S, SCHEMAS, VARIABLES, Tables, conform
from tickweave.plans.bands import Bands

RUN_GROUPS = 20
# Nominal inputs, and the two moved values of each (up, down).
NOMINAL = {"q": 0.002, "C_Af": 500.0, "T_f": 350.0, "T_c": 337.5}
MOVED = {"q": (0.0022, 0.0018), "C_Af": (550.0, 450.0), "T_f": (355.0, 345.0), "T_c": (342.5, 332.5)}
PARAMETER_VALUES = dict(
    zip([n for n, _ in KNOWN_PARAMETERS], [0.1, 1000.0, 239.0, -50000.0, 0.002, 500.0, 350.0, 337.5], strict=True)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_log(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """One row per (run, tick) with the six channels side by side. Ticks are numbered in bands
    of so many minutes, so a denser log takes narrower bands, not larger tasks."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % RUN_GROUPS).alias("r"),
        (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
        "ts", "event_id", "value",
    )
    numbered = Bands(("r",), "minute", ("ts", "event_id"), width=minutes).scan(
        events, running={"ordinal": ("sum", F.lit(1).cast("long"))}
    )
    k = F.expr("r div 2")
    plant = F.when(F.col("r") % 2 == 0, "source").otherwise("target")
    tick = F.col("ordinal") - 1
    excursion = F.expr("(ordinal - 11) div 120")
    moved = (tick >= 10) & ((tick - 10) % 120 < 20)
    corner = (3 * k + 5 * excursion) % 16

    def applied(position: int, name: str) -> Column:
        up = F.shiftright(corner.cast("int"), position).bitwiseAND(F.lit(1)) == 1
        return F.when(moved & up, MOVED[name][0]).when(moved, MOVED[name][1]).otherwise(NOMINAL[name])

    return numbered.select(
        "event_id",
        plant.alias("plant_id"),
        F.concat(plant, F.lit(".p3.e"), k.cast("string"), F.lit(".x4.l60.a10.n0")).alias("run_id"),
        tick.alias("sample_index"),
        (F.lit(PERIOD_S) * tick).alias("time_s"),
        F.col("value").alias("C_A"),
        (F.lit(350.0) + (F.col("event_id") % 100) / F.lit(10.0)).alias("T"),
        *[applied(i, n).alias(n) for i, n in enumerate(INPUTS)],
    )


def to_long(wide: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per channel and tick: readings first, then inputs; flag 0."""
    long = wide.unpivot(
        ["plant_id", "run_id", "sample_index", "time_s", *carried], list(VARIABLES), "variable_name", "value"
    )
    return long.select(
        "plant_id",
        "run_id",
        F.concat_ws(".", "plant_id", "variable_name").alias("sensor_id"),
        "sample_index",
        "time_s",
        "value",
        F.lit(0).cast("short").alias("quality_flag"),
        *carried,
    )


def _dimensions(wide: DataFrame, dataset: str) -> dict[str, DataFrame]:
    # ticks are numbered from 0 without a gap, so the last one is known from their count and nothing is ordered for it
    runs = wide.groupBy("run_id", "plant_id").agg(
        F.count(F.lit(1)).alias("n_samples"), (F.lit(PERIOD_S) * (F.count(F.lit(1)) - 1)).alias("end_time_s")
    )
    plants = wide.select("plant_id").distinct()
    channels = F.array(
        *[
            F.struct(
                F.lit(v).alias("variable_name"), F.lit(kind).alias("channel_kind"),
                F.lit(i).alias("channel_index"), F.lit(unit).alias("unit"),
                F.lit(NOISE_MODEL if std is not None else None).cast("string").alias("noise_model"),
                F.lit(std).cast("double").alias("noise_std"),
            )
            for v, kind, i, unit, std in CHANNELS
        ]
    )
    parameters = F.array(
        *[
            F.struct(F.lit(n).alias("parameter"), F.lit(PARAMETER_VALUES[n]).alias("value"), F.lit(u).alias("unit"))
            for n, u in KNOWN_PARAMETERS
        ]
    )
    return {
        "plants": conform(
            plants.select("plant_id", F.col("plant_id").alias("name"), F.lit("cstr").alias("process_type")), "plants"
        ),
        "process_parameters": conform(
            plants.select("plant_id", F.inline(parameters)), "process_parameters"
        ),
        "sensors": conform(
            plants.select("plant_id", F.inline(channels)).select(
                "*", F.concat_ws(".", "plant_id", "variable_name").alias("sensor_id"),
                F.lit(PERIOD_S).alias("sampling_period_s"),
            ),
            "sensors",
        ),
        "operating_runs": conform(
            runs.select(
                "*", F.lit(dataset).alias("dataset_id"), F.lit("p3").alias("operating_mode"),
                F.lit("events as excursions").alias("description"), F.lit(0.0).alias("start_time_s"),
                F.lit(PERIOD_S).alias("sampling_period_s"),
                F.sha2(F.col("run_id").cast("binary"), 256).alias("content_sha256"),
            ),
            "operating_runs",
        ),
    }


def event_log(spark: SparkSession, sf_dir: str, dataset: str = "events") -> Tables:
    wide = wide_log(spark, sf_dir)
    return Tables(measurements=to_long(wide), **_dimensions(wide, dataset))


def planted(spark: SparkSession, sf_dir: str) -> Tables:
    """Every measurement-level defect, planted by event number; a few broken dimension rows."""
    wide = wide_log(spark, sf_dir)
    dims = _dimensions(wide, "events")
    e = F.col("event_id")
    long = to_long(wide, ("event_id",)).where((e % 97 != 0) & ~((e % 89 == 0) & F.col("sensor_id").endswith(".T_f")))
    is_ca, is_t, is_tc = (F.col("sensor_id").endswith(s) for s in (".C_A", ".T", ".T_c"))
    broken = long.select(
        F.when((e % 59 == 0) & is_tc, "target").otherwise(F.col("plant_id")).alias("plant_id"),
        F.when((e % 991 == 0) & is_ca, "source.p3.orphan.n0").otherwise(F.col("run_id")).alias("run_id"),
        F.when((e % 61 == 0) & is_t, F.concat("plant_id", F.lit(".X"))).when((e % 499 == 0) & is_t, " ")
        .otherwise(F.col("sensor_id")).alias("sensor_id"),
        "sample_index",
        F.when(e % 83 == 0, F.col("time_s") + 0.25).when(e % 103 == 0, F.col("time_s") - 12.0)
        .when((e % 787 == 0) & is_tc, F.lit(float("inf"))).otherwise(F.col("time_s")).alias("time_s"),
        F.when((e % 79 == 0) & is_ca, F.lit(float("nan"))).when((e % 73 == 0) & is_t, F.lit(None))
        .otherwise(F.col("value")).alias("value"),
        F.when(e % 71 == 0, F.lit(3)).when((e % 701 == 0) & is_t, F.lit(None)).otherwise(F.col("quality_flag")).alias("quality_flag"),
        F.explode(F.when(e % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    empty = dims["operating_runs"].where(F.col("run_id").rlike(r"\.e[01]\.")).withColumn(
        "run_id", F.concat(F.lit("empty."), "run_id")
    )
    runs = dims["operating_runs"].withColumn(
        "end_time_s", F.when(F.col("run_id").contains(".e2."), F.col("end_time_s") + 6.0).otherwise(F.col("end_time_s"))
    ).unionByName(empty)
    sensors = dims["sensors"].withColumn(
        "sampling_period_s", F.when(F.col("sensor_id") == "source.T_c", 5.0).otherwise(F.col("sampling_period_s"))
    )
    dims |= {"operating_runs": conform(runs, "operating_runs"), "sensors": conform(sensors, "sensors")}
    return Tables(measurements=conform(broken, "measurements"), **dims)


def registry(spark: SparkSession, sf_dir: str) -> Tables:
    """Dimensions at the size of the order tables, with defects planted by key."""
    customer = table(spark, sf_dir, "customer")
    c = F.col("c_custkey")
    plants = customer.select(
        F.concat(F.lit("c"), c.cast("string")).alias("plant_id"),
        F.when(c % 41 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(c % 43 == 0, None).otherwise(F.col("c_mktsegment")).alias("process_type"),
        F.explode(F.when(c % 37 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    p = F.col("p_partkey")
    parameters = table(spark, sf_dir, "part").select(
        F.when(p % 193 == 0, None).when(p % 97 == 0, F.concat(F.lit("x"), p.cast("string")))
        .otherwise(F.concat(F.lit("c"), (p % 101 + 1).cast("string"))).alias("plant_id"),
        F.when(p % 67 == 0, " ").otherwise(F.col("p_brand")).alias("parameter"),
        F.when(p % 31 == 0, F.lit(float("nan"))).when(p % 29 == 0, F.lit(float("inf"))).when(p % 23 == 0, None)
        .otherwise(F.col("p_retailprice")).alias("value"),
        F.when(p % 19 == 0, "").otherwise(F.col("p_type")).alias("unit"),
    )
    key = c * 6 + F.col("position")
    channels = F.array(
        *[
            F.struct(
                F.lit(n).alias("position"), F.lit(v).alias("v"), F.lit(kind).alias("kind"), F.lit(i).alias("i"),
                F.lit(u).alias("u"), F.lit(std).cast("double").alias("std"),
            )
            for n, (v, kind, i, u, std) in enumerate(CHANNELS)
        ]
    )
    measured = F.col("kind") == "measured"
    plant = F.concat(F.lit("c"), c.cast("string"))
    sensors = customer.select("c_custkey", F.inline(channels)).select(
        F.concat(plant, F.lit("."), "v").alias("sensor_id"),
        F.when(key % 97 == 0, F.concat(F.lit("x"), plant)).otherwise(plant).alias("plant_id"),
        F.when(key % 89 == 0, "T").otherwise(F.col("v")).alias("variable_name"),
        F.when(key % 47 == 0, "other").when(key % 53 == 0, None).otherwise(F.col("kind")).alias("channel_kind"),
        F.when(key % 83 == 0, 0).when(key % 107 == 0, None).otherwise(F.col("i")).alias("channel_index"),
        F.when(key % 79 == 0, "K*").otherwise(F.col("u")).alias("unit"),
        F.when(key % 67 == 0, 0.0).when(key % 71 == 0, F.lit(float("nan"))).when(key % 113 == 0, None)
        .otherwise(PERIOD_S).alias("sampling_period_s"),
        F.when(measured & (key % 59 == 0), None).when(measured, NOISE_MODEL)
        .when(key % 61 == 0, NOISE_MODEL).alias("noise_model"),
        F.when(measured & (key % 101 == 0), F.lit(float("inf"))).when(measured & (key % 103 == 0), -1.0)
        .otherwise(F.col("std")).alias("noise_std"),
        F.explode(F.when(key % 73 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    o, n = F.col("o_orderkey"), 1 + F.col("o_orderkey") % 500
    owner = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    run_id = F.concat(owner, F.lit(".p3.e"), o.cast("string"), F.lit(".x4.n0"))
    runs = table(spark, sf_dir, "orders").select(
        run_id.alias("run_id"),
        F.when(o % 97 == 0, None).when(o % 89 == 0, F.concat(F.lit("x"), owner)).otherwise(owner).alias("plant_id"),
        F.col("o_orderpriority").alias("dataset_id"),
        F.when(o % 83 == 0, "").otherwise(F.col("o_orderstatus")).alias("operating_mode"),
        F.when(o % 79 == 0, None).otherwise(F.lit("an order")).alias("description"),
        F.when(o % 73 == 0, F.lit(float("nan"))).when(o % 71 == 0, F.lit(1.0e9)).otherwise(0.0).alias("start_time_s"),
        (F.lit(PERIOD_S) * (n - 1)).alias("end_time_s"),
        F.when(o % 67 == 0, 0.0).when(o % 109 == 0, None).otherwise(PERIOD_S).alias("sampling_period_s"),
        F.when(o % 61 == 0, 0).otherwise(n).alias("n_samples"),
        F.when(o % 59 == 0, F.concat(F.sha2(run_id.cast("binary"), 256), F.lit("\n")))
        .when(o % 53 == 0, None).otherwise(F.sha2(run_id.cast("binary"), 256)).alias("content_sha256"),
        F.explode(F.when(o % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    no_measurements = spark.createDataFrame([], SCHEMAS["measurements"])
    return Tables(
        plants=conform(plants, "plants"),
        process_parameters=conform(parameters, "process_parameters"),
        sensors=conform(sensors, "sensors"),
        operating_runs=conform(runs, "operating_runs"),
        measurements=no_measurements,
    )


def rough_wide(wide: DataFrame) -> DataFrame:
    """The wide log with a few single rows at which an input is moved out of turn, so that
    some excursions have no context and some runs break their layout."""
    glitch = F.col("event_id") % 1009 == 0
    return wide.withColumn("q", F.when(glitch, F.lit(0.0019)).otherwise(F.col("q")))
