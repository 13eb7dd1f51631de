"""Order statistics of groups of any size: exact quantiles and the k smallest, by counts of ranges and never by sorting or buffering a group."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.sources.views import kept

#: Ranges that an interval is cut into in each pass.
BINS = 4096


def _same(keys: list[str], left: str = "") -> Column:
    """Null-safe equality of `keys` with their copies _k0, _k1, ..."""
    out = F.lit(True)
    for i, c in enumerate(keys):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def quantiles(rows: DataFrame, by: list[str], value: Column, points: list[float]) -> DataFrame:
    """(*by, q array<double>): type-7 quantiles (linear between neighbours) of `value` in each group; nulls are left out, groups without values do not appear (without `by` there is one row, of nulls where there is no value).

    Each wanted rank has an interval of values. A pass counts the group's values in BINS ranges of it, and the range that holds the rank, from its least to its largest value, is the next interval, until
    it is one value. What meets in a task is a group's BINS counts a rank.
    """
    data = kept(rows.select(*by, value.cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)"))
    keyed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    ends = data.groupBy(*keyed).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n")).where("n > 0")
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in points]
    ranks = F.array(*(F.struct(F.lit(2 * j + side).alias("j"), (f(x)).cast("long").alias("r"), (x - F.floor(x)).alias("part")) for j, x in enumerate(place) for side, f in enumerate((F.floor, F.ceil))))
    now = kept(ends.select(*names, "lo", "hi", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("t")).select(*names, "lo", "hi", "before", "t.*"))
    cols = [*names, "lo", "hi", "before", "j", "r", "part"]
    done = None
    while True:
        still = now.where("lo < hi")
        done = now.where("lo = hi").select(*cols) if done is None else done.union(now.where("lo = hi").select(*cols))
        if not still.limit(1).count():
            break
        # halves, so that the width of an interval over all doubles is finite
        at = F.least(F.floor((F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        hits = data.join(still, _same(by) & F.col("_x").between(F.col("lo"), F.col("hi")))
        counts = hits.groupBy(*names, "j", "r", "part", "before", at.alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.col("before") + F.sum("c").over(W.partitionBy(*names, "j").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        now = kept(counts.withColumn("upto", upto).where("upto - c <= r AND r < upto").withColumn("before", F.col("upto") - F.col("c")).select(*cols))
    side = lambda k: F.max(F.when(F.col("j") == k, F.col("lo")))
    part = lambda k: F.max(F.when(F.col("j") == k, F.col("part")))
    q = F.array(*(side(2 * j) + (side(2 * j + 1) - side(2 * j)) * part(2 * j) for j in range(len(points))))
    return done.groupBy(*names).agg(q.alias("q")).select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), "q")


def with_quantiles(grouped: DataFrame, rows: DataFrame, by: list[str], value: Column, names: dict[str, float]) -> DataFrame:
    """`grouped` (one row a group) with a column for each named quantile."""
    q = quantiles(rows, by, value, list(names.values())).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), *(F.col("q")[i].alias(n) for i, n in enumerate(names)))
    return grouped.join(q, _same(by), "left").drop(*(f"_k{i}" for i in range(len(by))))


def mark_smallest(rows: DataFrame, by: list[str], k: DataFrame | int, order: str, keys: list[str], flag: str = "smallest") -> DataFrame:
    """`rows` with a boolean: whether a row is among the k smallest of its group by the 32-bit hash `order`, ties by `keys`.

    k: a number, or a table (*by, k). Histograms of the hash's first 12 bits tell the range in which a group's k-th smallest lies; rows of lower ranges are in, of higher ones out, and only that
    range, a 4096th of the group, is ranked. Groups that the table lacks, or whose k is 0, have none.
    """
    prefix = F.floor(F.col(order) / F.lit(1 << 20))
    names = [f"_k{i}" for i in range(len(by))]
    keyed = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    counts = rows.groupBy(*keyed, prefix.alias("_p")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(W.partitionBy(*names).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)))
    if isinstance(k, int):
        counts = counts.withColumn("k", F.lit(k))
    else:
        same = F.lit(True)
        for c, n in zip(by, names, strict=True):
            same = same & F.col(n).eqNullSafe(F.col(f"_t{c}"))
        counts = counts.join(k.select(*(F.col(c).alias(f"_t{c}") for c in by), "k"), same)
    # no cut where the whole group is taken: one beyond all ranges
    cut = counts.groupBy(*names).agg(F.first("k").alias("k"), F.min(F.when(F.col("upto") >= F.col("k"), F.struct("_p", (F.col("k") - F.col("upto") + F.col("c")).alias("need")))).alias("cut")).where("k > 0")
    cut = kept(cut.select(*names, F.coalesce(F.col("cut._p"), F.lit(1 << 12)).alias("_cut"), F.col("cut.need").alias("_need")))
    both = rows.withColumn("_p", prefix).join(cut, _same(by), "left")
    edge = F.coalesce(F.col("_p") == F.col("_cut"), F.lit(False))
    sure = both.where(~edge).withColumn(flag, F.coalesce(F.col("_p") < F.col("_cut"), F.lit(False)))
    near = both.where(edge).withColumn(flag, F.row_number().over(W.partitionBy(*names).orderBy(order, *keys)) <= F.col("_need"))
    return sure.union(near).drop("_p", "_cut", "_need", *names)
