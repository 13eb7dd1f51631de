"""Connected components of an edge table, in DataFrame operations only."""

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that the session names in spark.checkpoint.dir; one is set here only where the session has none and runs on one machine, as in tests."""
    context = spark.sparkContext._jsc.sc()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where or context.getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: its lineage is cut, and Catalyst knows its size, by which it broadcasts it to joins or not."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates the large-star and small-star steps: each joins an edge table with one minimum a
    node, so a hub of any degree is spread by rows and never gathered. Ends when a round changes
    nothing; nulls and loops are left out. Empty edges give an empty table.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = shared(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def state(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = shared(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()).distinct()


def small_batches(spark, size: str = "8m", rows: int = 1000) -> None:
    """Bound the Arrow batches that tasks exchange with Python, by bytes and rows, unless the session sets bounds of its own: texts are long, and workers share an executor's memory."""
    for name, value, default in (("maxBytesPerBatch", size, None), ("maxRecordsPerBatch", str(rows), "10000")):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) in (None, default) or name == "maxBytesPerBatch" and spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def dealt_by(df: DataFrame, *keys: str):
    """`df` grouped by `keys`, in as many partitions as the session shuffles to: groups that take long to work off are not put together in a few tasks because they are small."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)
