"""Streams over the event log, each equal to a batch query: files that Spark writes in slices, worked off in batches and with a restart between."""

from pyspark.sql import functions as F

from quorumspark.plans.registry import query
from quorumspark.sources.views import scratch
from quorumspark.streaming import state as S

SLICES = 3
#: How far events may be late, and how long a job waits for its answer; a user's session ends after GAP.
LATE, WITHIN, GAP = "2 hours", "1 DAY", "12 hours"


def _sliced(v, rows, in_time=False):
    """`rows` as files in slices of the log, by event_id's hash, so out of order between slices, or by time; the folder and an opener of streams over it."""
    folder, names, schema = scratch(v.spark), rows.columns, rows.schema
    cut = F.pmod(F.xxhash64("event_id"), F.lit(SLICES)).cast("int")
    if in_time:
        ends = rows.agg(F.min("ts").cast("double").alias("_lo"), F.max("ts").cast("double").alias("_hi"))
        cut = F.least(F.floor((F.col("ts").cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLICES), F.lit(SLICES - 1))
        rows = rows.crossJoin(F.broadcast(ends))
    kept = rows.withColumn("_cut", cut)
    for k in range(SLICES):
        kept.where(F.col("_cut") == k).select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    read = lambda: v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    return folder, read


@query("k1_latest_state", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type", raw=True)
def _(v):
    folder, read = _sliced(v, v.table("events").select("user_id", "event_type", "event_id", "value"))
    with S.rocksdb(v.spark):
        S.run(S.last_written(read(), ["user_id", "event_type"], "event_id"), folder)
        return S.state_of(v.spark, folder, "last").select("user_id", "event_type", "event_id", "value")


@query("k2_pending_state", "SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AS wanted, count(*) FILTER (event_type = 'purchase') AS answers FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id", raw=True)
def _(v):
    kind = F.when(F.col("event_type") == "view", "job").otherwise("answer")
    folder, read = _sliced(v, v.table("events").where("event_type IN ('view', 'purchase')").select("user_id", kind.alias("kind"), "event_id"))
    with S.rocksdb(v.spark):
        S.run(S.work_list(read().drop("event_id"), ["user_id"]), folder)
        return S.state_of(v.spark, folder, "job").select("user_id", "wanted", "answers")


@query("k3_unanswered_jobs", "WITH j AS (SELECT user_id, ts AS job_ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT least((SELECT max(job_ts) FROM j), (SELECT max(ts) FROM a)) - INTERVAL 2 HOUR - INTERVAL 1 DAY AS upto) SELECT user_id, job_ts FROM j WHERE job_ts < (SELECT upto FROM w) AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = j.user_id AND a.ts BETWEEN job_ts AND job_ts + INTERVAL 1 DAY)", raw=True)
def _(v):
    folder, read = _sliced(v, v.table("events").where("event_type IN ('view', 'purchase')").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), in_time=True)
    S.run(S.unanswered(read().where("event_type = 'view'"), read().where("event_type = 'purchase'"), ["user_id"], WITHIN, LATE), folder, "append")
    return S.out_of(v.spark, folder).withColumn("job_ts", F.col("job_ts").cast("timestamp_ntz"))


@query("k4_sessions", "WITH e AS (SELECT user_id, ts, value, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR)::INT AS new FROM events)) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY user_id, coalesce(k, 0) HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR", raw=True)
def _(v):
    folder, read = _sliced(v, v.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value"), in_time=True)
    S.run(S.sessions(read(), ["user_id"], GAP, LATE, total=F.col("value")), folder, "append")
    return S.out_of(v.spark, folder).withColumns({"total": F.round("total", 6), **{c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")}})
