"""Panel sizes, coder turnover and releases over time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import six
from quorumspark.operators.panel import common_scope
from quorumspark.operators.select import with_quantiles

BANDS = ((3, "1-3"), (4, "4"), (7, "5-7"), (10**9, "8+"))


def band(n: Column) -> Column:
    """Right-closed size bands."""
    out = F.lit(BANDS[-1][1])
    for top, name in reversed(BANDS[:-1]):
        out = F.when(n <= top, name).otherwise(out)
    return out


def era_bands(means: DataFrame, cut: int) -> DataFrame:
    era = F.when(F.col("year") <= cut, "early").otherwise("late")
    n = means.groupBy(era.alias("era"), band(F.col("n_coders")).alias("band")).agg(F.count("*").alias("n"))
    return n.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy("era"))))


def turnover(ratings: DataFrame, since: int) -> DataFrame:
    """Coders whose last year is each year from `since` on, in per cent of all coders whose last year is in that range, and whether it is the last year (whose coders are still active)."""
    last = ratings.groupBy("coder").agg(F.max("year").alias("year")).where(F.col("year") >= since)
    stops = last.groupBy("year").agg(F.count("*").alias("stops"))
    whole = stops.agg(F.sum("stops").alias("pool"), F.max("year").alias("end"))
    return stops.crossJoin(F.broadcast(whole)).select("year", "stops", "pool", F.round(100 * F.col("stops") / F.col("pool"), 2).alias("pct_of_pool"), (F.col("year") == F.col("end")).alias("still_active"))


def shortfall(counts: DataFrame, by: list[str], n: str = "n_coders") -> DataFrame:
    c = F.col(n)
    per = counts.groupBy(*by).agg(F.count("*").alias("cells"), F.round(F.avg(c), 3).alias("mean"), F.round(F.avg((c <= 3).cast("int")), 3).alias("le_3"), F.round(F.avg((c < 5).cast("int")), 3).alias("lt_5"))
    return with_quantiles(per, counts, by, c, {"_m": 0.5}).select(*by, "cells", "mean", F.round("_m", 3).alias("median"), "le_3", "lt_5")


def leading_edge(releases: DataFrame, min_fill: float = 0.5) -> DataFrame:
    """Latest year of each release in which at least `min_fill` of the grid is filled: the entities with rows in the year times the indicators, both of the scope that all releases share. The last year with any row can be nearly empty."""
    inds, ents = common_scope(releases, "indicator"), common_scope(releases, "entity")
    shared = releases.join(inds, "indicator", "left_semi").join(ents, "entity", "left_semi")
    fill = shared.groupBy("release", "year").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("rows"))
    size = inds.agg(F.count("*").alias("width"))
    return fill.crossJoin(F.broadcast(size)).where(F.col("n") >= min_fill * F.col("rows") * F.col("width")).groupBy("release").agg(F.max("year").alias("edge"))


def edge_series(releases: DataFrame, offsets: int = 3) -> DataFrame:
    edge = leading_edge(releases).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1)))).withColumn("year", F.col("edge") - F.col("offset"))
    return releases.join(F.broadcast(edge), ["release", "year"]).groupBy("release", "offset").agg(six(F.avg("n_coders")).alias("mean_nr"), F.count("*").alias("n"))


def backfill(releases: DataFrame) -> DataFrame:
    m = releases.groupBy("year", "release").agg(F.avg("n_coders").alias("mean_nr"))
    return m.withColumn("gain", F.col("mean_nr") - F.lag("mean_nr").over(W.partitionBy("year").orderBy("release")))


def mean_increment(filled: DataFrame, first: int, last: int) -> DataFrame:
    """Mean gain of a release over the one before, over the settled years first..last."""
    return filled.where(F.col("year").between(first, last) & F.col("gain").isNotNull()).groupBy("release").agg(F.round(F.avg("gain"), 3).alias("mean_increment"), F.count("*").alias("years"))


def fill_in(releases: DataFrame) -> DataFrame:
    """The edge year of release i as read in every release from i on (cycle 0, 1, ...)."""
    edge = leading_edge(releases).select(F.col("release").alias("first"), F.col("edge").alias("year"))
    rows = releases.join(F.broadcast(edge), "year").where(F.col("release") >= F.col("first"))
    return rows.groupBy("first", (F.col("release") - F.col("first")).alias("cycle")).agg(six(F.avg("n_coders")).alias("mean_nr"), six(F.avg((F.col("n_coders") < 5).cast("int"))).alias("lt_5"), F.count("*").alias("n"))


def before_after(releases: DataFrame, a: int, b: int) -> DataFrame:
    """Share of cells in every band in two releases, empty bands included."""
    names = releases.sparkSession.createDataFrame([(n,) for _, n in BANDS], "band string")
    n = releases.where(F.col("release").isin(a, b)).groupBy("release", band(F.col("n_coders")).alias("band")).agg(F.count("*").alias("n"))
    grid = releases.where(F.col("release").isin(a, b)).select("release").distinct().crossJoin(F.broadcast(names))
    out = grid.join(n, ["release", "band"], "left").na.fill(0, ["n"])
    return out.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy("release"))))


def first_and_now(filled: DataFrame, value: str = "lt_5") -> DataFrame:
    return filled.groupBy("first").agg(F.min_by(value, "cycle").alias("at_first"), F.max_by(value, "cycle").alias("now"), F.max("cycle").alias("cycles"))


def sd_by_size(releases: DataFrame) -> DataFrame:
    """Posterior SD by size band: median, quartiles, and the interval of the median, 1.253 sd / sqrt(n)."""
    rows = releases.where("posterior_sd IS NOT NULL").withColumn("band", band(F.col("n_coders")))
    out = rows.groupBy("band").agg(F.stddev_samp("posterior_sd").alias("s"), F.count("*").alias("n"))
    out = with_quantiles(out, rows, ["band"], F.col("posterior_sd"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return out.select("band", *(six(F.col(c)).alias(c) for c in ("q1", "median", "q3")), "n", six(1.253 * F.col("s") / F.sqrt("n")).alias("se_median"))


def reach(releases: DataFrame) -> DataFrame:
    e = leading_edge(releases)
    return e.agg(F.min("release").alias("first_release"), F.max("release").alias("last_release"), F.min_by("edge", "release").alias("first_edge"), F.max_by("edge", "release").alias("last_edge"), F.min("edge").alias("min_edge"), F.max("edge").alias("max_edge"))
