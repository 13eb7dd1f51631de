"""Streams with state against batch results: any batching, late copies, a restart between."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quorumspark.operators import panel
from quorumspark.plans import ORACLES, QUERIES
from quorumspark.streaming import state

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("per_trigger", [1, 10])
def test_last_copy_wins_after_a_restart(spark, tmp_path, per_trigger):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    part = lambda k: events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = lambda: state.last_written(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/log"), ["user_id", "event_type"], "event_id")
    with state.rocksdb(spark):
        for step in ((0, 1, 2), (3,), ()):
            for k in step:
                part(k)
            state.run(stream(), f"{tmp_path}/s")
            seen = spark.read.parquet(f"{tmp_path}/log")
            want = panel.last_written(seen, ["user_id", "event_type"], "event_id").select(*events.columns)
            assert rows_of(state.state_of(spark, f"{tmp_path}/s", "last").select(*events.columns)) == rows_of(want)
    # every change went out once, later ones with larger numbers
    given = state.out_of(spark, f"{tmp_path}/s").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"), F.count_distinct("event_id").alias("m"))
    assert given.where("n <> m").count() == 0 and rows_of(given.select("user_id", "event_type", "event_id")) == rows_of(want.select("user_id", "event_type", "event_id"))


def test_work_list_goes_on(spark, tmp_path):
    log = "k long, kind string"
    put = lambda *r: spark.createDataFrame(list(r), log).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    with state.rocksdb(spark):
        for rows, want in (([(1, "job"), (2, "job"), (3, "answer")], {1: (True, 0), 2: (True, 0), 3: (False, 1)}), ([(1, "answer"), (3, "job"), (1, "answer")], {1: (True, 2), 2: (True, 0), 3: (True, 1)})):
            put(*rows)
            state.run(state.work_list(spark.readStream.schema(log).parquet(f"{tmp_path}/log"), ["k"]), f"{tmp_path}/s")
            assert {r.k: (r.wanted, r.answers) for r in state.state_of(spark, f"{tmp_path}/s", "job").collect()} == want
    assert spark.conf.get(state.PROVIDER, None) != state.ROCKS


def test_unanswered_jobs_come_out_once_nothing_can_answer(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    jobs = [(1, at(0)), (2, at(1)), (3, at(2)), (4, at(80))]
    answers = [(1, at(5)), (2, at(40)), (3, at(1)), (4, at(79)), (9, at(90))]
    for name, rows in (("j", jobs), ("a", answers)):
        spark.createDataFrame(rows, "k long, ts timestamp").write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/{n}")
    state.run(state.unanswered(read("j"), read("a"), ["k"], "1 DAY", "1 hour"), f"{tmp_path}/s", "append")
    # 2 was answered too late, 3 too early; 4 may still be answered
    assert sorted(r.k for r in state.out_of(spark, f"{tmp_path}/s").collect()) == [2, 3]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    spark.createDataFrame([("a", at(m), 1.0) for m in (0, 10, 25, 60, 70)] + [("b", at(5), 2.0), ("z", at(500), 0.0)], "u string, ts timestamp, x double").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("u string, ts timestamp, x double").parquet(f"{tmp_path}/e")
    state.run(state.sessions(stream, ["u"], "20 minutes", "1 hour", total=F.col("x")), f"{tmp_path}/s", "append")
    got = sorted((r.u, r.start, r["last"], r.n, r.total) for r in state.out_of(spark, f"{tmp_path}/s").collect())
    assert got == [("a", at(0), at(25), 3, 3.0), ("a", at(60), at(70), 2, 2.0), ("b", at(5), at(5), 1, 2.0)]


@pytest.mark.parametrize("name", ["k1_latest_state", "k2_pending_state", "k3_unanswered_jobs", "k4_sessions"])
def test_registered_streams_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: [round(x, 4) if isinstance(x, float) else x for x in r]
    assert sorted(map(str, map(key, map(tuple, df.select(*cols).collect())))) == sorted(map(str, map(key, want)))
