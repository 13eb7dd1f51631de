"""Keyed state and event time over append-only logs: last copy wins, resumable work lists, unanswered jobs, sessions.

State lives in RocksDB stores under the stream's checkpoint, so it outgrows no executor's memory and a stopped stream goes on where it was; what the state holds is read
back as a table. Each function takes a streaming DataFrame and gives one back, or runs it over what is there and stops.
"""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The session's state stores are RocksDB inside, and what they were before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _plain(x, kind):
    """A value of a pandas row as state takes it: missing is null, and whole numbers that were kept as floats are whole again."""
    import pandas as pd

    if x is None or pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(kind, T.IntegralType) else x


class _Last(StatefulProcessor):
    """Keeps a key's row with the largest sequence number; gives it out when it changes."""

    def __init__(self, schema: T.StructType, seq: str, ttl_ms: int | None):
        self.schema, self.seq, self.ttl = schema, seq, ttl_ms

    def init(self, handle):
        self.last = handle.getValueState("last", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        names = self.schema.fieldNames()
        best = self.last.get() if self.last.exists() else None
        changed, at = False, names.index(self.seq)
        for frame in rows:
            top = frame.loc[frame[self.seq].idxmax()]
            if best is None or top[self.seq] > best[at]:
                best, changed = tuple(_plain(x, f.dataType) for x, f in zip(top[names], self.schema.fields, strict=True)), True
        if changed:
            self.last.update(best)
            yield pd.DataFrame([best], columns=names)

    def close(self):
        pass


def last_written(log: DataFrame, keys: list[str], seq: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream of a log's newest rows by `keys`: a row goes out whenever a larger sequence number arrives, whatever the order of arrival. With a TTL a key that has not changed for so long is forgotten; without one state grows with the keys."""
    grouped = log.groupBy(*keys)
    mode = "ProcessingTime" if ttl_ms else "None"
    return grouped.transformWithStateInPandas(statefulProcessor=_Last(log.schema, seq, ttl_ms), outputStructType=log.schema, outputMode="Update", timeMode=mode)


class _Jobs(StatefulProcessor):
    """Remembers whether a job is wanted and how often it was answered."""

    def init(self, handle):
        self.job = handle.getValueState("job", "wanted boolean, answers long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        wanted, answers = self.job.get() if self.job.exists() else (False, 0)
        for frame in rows:
            wanted = bool(wanted or (frame["kind"] == "job").any())
            answers += int((frame["kind"] == "answer").sum())
        self.job.update((wanted, answers))
        yield pd.DataFrame([(*key, wanted, answers)])

    def close(self):
        pass


def work_list(log: DataFrame, keys: list[str]) -> DataFrame:
    """A stream (*keys, wanted, answers) over a log of jobs and answers (*keys, kind), in any order."""
    fields = [f"{c} {log.schema[c].dataType.simpleString()}" for c in keys]
    return log.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Jobs(), outputStructType=", ".join([*fields, "wanted boolean", "answers long"]), outputMode="Update", timeMode="None")


def run(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Work off what the sources hold and stop; called again after more files came, it goes on from the checkpoint. Batches go to Parquet by number, so one that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def out_of(spark: SparkSession, folder: str) -> DataFrame:
    """What the batches of a stream gave out."""
    return spark.read.parquet(f"{folder}/out").drop("batch")


def state_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows that a stream's state variable holds after its last batch."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint")
    return rows.select("key.*", "value.*") if name == "job" else rows.select("value.*")


def unanswered(jobs: DataFrame, answers: DataFrame, keys: list[str], within: str, late: str) -> DataFrame:
    """Jobs (*keys, ts) without an answer (*keys, ts) up to `within` later: an outer join of two streams, whose rows come out when the watermark, `late` behind both, has passed all answers that could still come."""
    j = jobs.withWatermark("ts", late).select(*keys, F.col("ts").alias("job_ts"))
    a = answers.withWatermark("ts", late).select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("ts").alias("answer_ts"))
    on = F.expr(f"answer_ts >= job_ts AND answer_ts <= job_ts + INTERVAL {within}")
    for c in keys:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return j.join(a, on, "leftOuter").where("answer_ts IS NULL").select(*keys, "job_ts")


def sessions(events: DataFrame, by: list[str], gap: str, late: str, **sums: Column) -> DataFrame:
    """(*by, start, last, n, *sums) of runs of events less than `gap` apart; a session comes out once, when the watermark has passed its end."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(*by, w.alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("n"), *(F.sum(c).alias(n) for n, c in sums.items()))
    return out.select(*by, F.col("w.start").alias("start"), "last", "n", *sums)
