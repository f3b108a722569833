"""SQL of queries whose rule shows only where a log is long or broken in two places at once."""

import datetime

import duckdb

import __spark_entry__


def both(spark, folder, events, name):
    """Rows of a query and of its SQL over events (event_id, user_id, minute)."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(e, start + datetime.timedelta(minutes=minute), user, float(e % 50)) for e, user, minute in events]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = __spark_entry__.queries()[name](spark, str(folder))
    columns = ", ".join(found.columns)
    return [tuple(r) for r in found.collect()], con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()


def test_refused_models_count_every_excursion_that_is_left_out(spark, tmp_path):
    got, expected = both(spark, tmp_path, [(k, 0, k) for k in range(1000)], "score_refused_models")
    assert got == expected == [("fail", "readings without a prediction", 4 * 110)]  # excursions 2, 5, 8 and 7


def test_inputs_absent_on_both_plants_are_not_the_same(spark, tmp_path):
    events = [(89, 0, 0), (178, 1, 0)] + [(200 + 2 * k + user, user, 1 + k) for k in range(20) for user in (0, 1)]
    got, expected = both(spark, tmp_path, events, "series_compare_plants_with_gaps")
    assert [r[:8] for r in got] == [r[:8] for r in expected] and got[0][6] < got[0][3]


def test_a_mean_that_stands_on_a_bound_falls_on_the_same_side(spark, tmp_path):
    context = [31.74, 58.14, 69.33, 53.73, 45.74, 36.81, 50.09, 69.28, 60.82, 24.32]  # ticks 1 to 10; twice their mean is 100, less a rounding
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=k), 0, context[k - 1] if 1 <= k <= 10 else 60.0) for k in range(130)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = __spark_entry__.queries()["physics_bound_violations"](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()['physics_bound_violations']})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))  # as text, so the sign of a zero counts
    assert [r[5:] for r in got if r[:2] == ("hold", "source.p3.e0.x4.l60.a10.n0") and r[4] == "C_A below zero"] == [(0.0, 0.0)] * 110
