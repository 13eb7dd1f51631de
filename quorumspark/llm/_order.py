"""Running sums over a global order, without one task that sees all rows."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quorumspark.llm._arrow import tidy
from quorumspark.llm._graph import shared_folder, written


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list, sums: dict[str, str], n: int | None = None) -> DataFrame:
    """`df` as a written table with, for each new column of `sums`, the sum of its long column over all rows before this one by `order`.

    Rows are range-partitioned by `order` and summed within their partition as they stream by; the partitions' totals, a row
    a partition, are added in a second step. Rows that are equal in `order` follow each other in any order. A null counts as 0.
    """
    shared_folder(df.sparkSession)
    names = list(sums)

    def within(batches):
        part, total = TaskContext.get().partitionId(), dict.fromkeys(names, 0)
        for b in batches:
            out = []
            for name in names:
                x = b.column(sums[name]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(x) + total[name]
                out += [pa.array(upto - x), pa.array(upto)]
                total[name] = int(upto[-1]) if len(upto) else total[name]
            yield pa.record_batch([*b.columns, *out, pa.array(np.full(b.num_rows, part, np.int32))], [*b.schema.names, *(f"{x}{y}" for x in names for y in ("", "_upto")), "_part"])

    schema = StructType([*df.schema.fields, *(StructField(f"{x}{y}", LongType()) for x in names for y in ("", "_upto")), StructField("_part", IntegerType())])
    ranged = df.repartitionByRange(n or parts(df), *order).sortWithinPartitions(*order)
    out = written(ranged.mapInArrow(tidy(within), schema))
    # one row a partition
    totals = out.groupBy("_part").agg(*(F.max(f"{x}_upto").alias(f"{x}_upto") for x in names))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"{x}_upto").over(before), F.lit(0)).alias(f"{x}_base") for x in names))
    both = out.join(F.broadcast(totals), "_part")
    return both.select(*df.columns, *((F.col(x) + F.col(f"{x}_base")).alias(x) for x in names))


def followed(df: DataFrame, group: list[str], value: str, following: str, n: int | None = None) -> DataFrame:
    """`df` (columns without nulls in `group` and `value`) as a table sorted by group and value, with the next value of the same group, null for the last.

    Groups of any size are range-partitioned by value too; the link over the edge of a partition comes from the partitions' first rows, one a partition.
    """
    shared_folder(df.sparkSession)
    keys = [*group, value]
    schema = StructType([*df.schema.fields, StructField(following, df.schema[value].dataType), StructField("_part", IntegerType()), StructField("_first", IntegerType()), StructField("_last", IntegerType())])

    def within(batches):
        part, held, first = TaskContext.get().partitionId(), None, 1

        def out(t, nxt, last):
            nonlocal first
            flags = np.zeros(t.num_rows, np.int32)
            flags[0], first = first, 0
            ends = np.zeros(t.num_rows, np.int32)
            ends[-1] = last
            cols = [*t.columns, nxt, pa.array(np.full(t.num_rows, part, np.int32)), pa.array(flags), pa.array(ends)]
            return pa.Table.from_arrays(cols, names=schema.names).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            held = t.slice(t.num_rows - 1)
            if t.num_rows > 1:
                head, tail = t.slice(0, t.num_rows - 1), t.slice(1)
                same = np.ones(head.num_rows, bool)
                for c in group:
                    same &= head.column(c).to_numpy() == tail.column(c).to_numpy()
                v = pa.array(tail.column(value).to_numpy(), mask=~same)
                yield out(head, v, 0)
        if held is not None:
            yield out(held, pa.nulls(1, held.column(value).type), 1)

    table = written(df.repartitionByRange(n or parts(df), *keys).sortWithinPartitions(*keys).mapInArrow(tidy(within), schema))
    # one row a partition that has rows
    firsts = table.where("_first = 1").select((F.lag("_part").over(Window.orderBy("_part"))).alias("_part"), *(F.col(c).alias(f"_{c}") for c in group), F.col(value).alias("_value"), F.lit(1).alias("_last"))
    both = table.join(F.broadcast(firsts), ["_part", "_last"], "left")
    same = F.lit(True)
    for c in group:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return both.select(*df.columns, F.coalesce(F.col(following), F.when(same, F.col("_value"))).alias(following))
