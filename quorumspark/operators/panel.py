"""Cleaning of rating tables, and statistics of panels (all ratings of one cell)."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import corr, half_even, ratio, six
from quorumspark.operators.select import with_quantiles

CELL = ["entity", "year", "indicator"]


def last_written(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row a key of an append-only log: the one written last. A grouped maximum, so repeated keys combine before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c != seq]
    return log.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("x")).select(*keys, "x.*")


def first_written(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in `order`."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*keys, "x.*")


def pending(grid: list[DataFrame], needed: DataFrame, needed_on: list[str], done: DataFrame) -> DataFrame:
    """The work list: every combination of the (small) dimensions in `grid` that has a row in `needed` and none in `done`."""
    work = needed
    for dim in grid:
        work = work.crossJoin(F.broadcast(dim))
    return work.join(done, [c for c in work.columns if c in done.columns], "left_anti")


def wide_to_long(rows: DataFrame, ids: list[str], columns: list[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """Unpivot; nulls are dropped."""
    return rows.unpivot(ids, columns, name, value).where(F.col(value).isNotNull())


def paired_to_long(rows: DataFrame, ids: list[str], names: list[str], suffixes: tuple = ("_nr", "_sd"), values: tuple = ("n_coders", "posterior_sd")) -> DataFrame:
    """Columns <name><suffix> to one row a name with a column for each suffix; rows without the first are dropped."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), *(F.col(n + s).alias(v) for s, v in zip(suffixes, values, strict=True))) for n in names))).alias("x")
    return rows.select(*ids, each).select(*ids, "x.*").where(F.col(values[0]).isNotNull())


def reduce_coders(rows: DataFrame, ids: list[str], date: str, indicators: list[str], first: int, last: int) -> DataFrame:
    """Year-end rows of the years first..last of a wide coder table, long, without nulls."""
    kept = rows.where((F.month(date) == 12) & (F.dayofmonth(date) == 31) & F.year(date).between(first, last))
    return wide_to_long(kept.withColumn("year", F.year(date)), [*ids, "year"], indicators, "indicator", "rating")


def coverage(scored: DataFrame, expected: list[str], min_frac: float = 0.9) -> DataFrame:
    """(model, condition, n, problem): expected models without a row, and cells with under min_frac of the median cell's rows."""
    counts = scored.groupBy("model", "condition").agg(F.count("*").alias("n"))
    middle = counts.agg(F.percentile("n", 0.5).alias("mid"))
    thin = counts.crossJoin(F.broadcast(middle)).where(F.col("n") < min_frac * F.col("mid")).select("model", "condition", "n", F.lit("thin").alias("problem"))
    names = scored.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    gone = names.join(counts, "model", "left_anti").select("model", F.lit(None).cast("string").alias("condition"), F.lit(0).cast("long").alias("n"), F.lit("missing").alias("problem"))
    return thin.union(gone)


def common_scope(rows: DataFrame, key: str, over: str = "release") -> DataFrame:
    """Values of `key` that occur in every value of `over`."""
    total = rows.agg(F.count_distinct(over).alias("r"))
    return rows.groupBy(key).agg(F.count_distinct(over).alias("n")).crossJoin(F.broadcast(total)).where("n = r").select(key)


def valid_rating(c, top: int = 5):
    return c.isNotNull() & (c == F.floor(c)) & c.between(0, top)


def off_scale(scored: DataFrame, col: str = "rating", top: int = 5) -> DataFrame:
    """Rows and off-scale rows of each (model, condition)."""
    bad = ~F.coalesce(valid_rating(F.col(col), top), F.lit(False))
    return scored.groupBy("model", "condition").agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("n_dropped"))


def corrected(rows: DataFrame, overrides: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Override columns by hand corrections: a small table keyed like `rows`; a null there leaves the value."""
    fix = overrides.select(*keys, *(F.col(c).alias(f"_fix_{c}") for c in cols))
    out = rows.join(fix, keys, "left")
    return out.select(*(F.coalesce(f"_fix_{c}", c).alias(c) if c in cols else c for c in rows.columns))


def panel_means(ratings: DataFrame, min_coders: int = 1) -> DataFrame:
    return ratings.groupBy(*CELL).agg(F.avg("rating").alias("raw_mean"), F.count("*").alias("n_coders")).where(F.col("n_coders") >= min_coders)


def human_loo(ratings: DataFrame, min_coders: int = 2) -> DataFrame:
    """Each rating against the mean of the panel's others: loo_mean = (sum - r) / (n - 1), e = |r - loo_mean|. One shuffle, no self-join."""
    w = W.partitionBy(*CELL)
    rows = ratings.withColumn("s", F.sum("rating").over(w)).withColumn("n", F.count("*").over(w)).where(F.col("n") >= min_coders)
    return rows.withColumn("loo_mean", (F.col("s") - F.col("rating")) / (F.col("n") - 1)).withColumn("e", F.abs(F.col("rating") - F.col("loo_mean"))).drop("s")


def human_mae(ratings: DataFrame, min_coders: int = 2) -> DataFrame:
    """(cell, h, n): the mean leave-one-out error of a cell, its difficulty."""
    return human_loo(ratings, min_coders).groupBy(*CELL).agg(F.avg("e").alias("h"), F.first("n").alias("n"))


def rounding_floor(means: DataFrame) -> DataFrame:
    gap = F.abs(half_even(F.col("raw_mean")) - F.col("raw_mean"))
    per = means.groupBy("year").agg(six(F.avg(gap)).alias("mean_floor"), F.count("*").alias("n"))
    return with_quantiles(per, means, ["year"], gap, {"median": 0.5}).select("year", "mean_floor", six(F.col("median")).alias("median_floor"), "n")


def sesoi(means: DataFrame) -> DataFrame:
    return means.agg(six(F.avg(F.abs(half_even(F.col("raw_mean")) - F.col("raw_mean"))) / 2).alias("sesoi"))


def persistence(means: DataFrame) -> DataFrame:
    """|round(last year's mean) - mean| of cells whose year before exists."""
    before = means.select("entity", (F.col("year") + 1).alias("year"), "indicator", F.col("raw_mean").alias("before"))
    return means.join(before, CELL).withColumn("pers", F.abs(half_even(F.col("before")) - F.col("raw_mean")))


def rails(means: DataFrame, ord_: DataFrame, scored: DataFrame) -> DataFrame:
    """What memory alone would score: rounding, last year's mean, the published ordinal and last year's; MAE, n, coverage, correlation with the mean, ratio to the observed MAE."""
    prev = means.select("entity", (F.col("year") + 1).alias("year"), "indicator", half_even(F.col("raw_mean")).alias("persist"))
    o_prev = ord_.select("entity", (F.col("year") + 1).alias("year"), "indicator", F.col("ord").cast("double").alias("ord_prev"))
    rows = means.join(prev, CELL, "left").join(ord_.withColumn("ord", F.col("ord").cast("double")), CELL, "left").join(o_prev, CELL, "left").withColumn("rounding", half_even(F.col("raw_mean")))
    long = rows.unpivot(["raw_mean"], ["rounding", "persist", "ord", "ord_prev"], "rail", "guess")
    seen = scored.agg(F.avg("abs_dev").alias("observed"))
    out = long.groupBy("rail").agg(F.avg(F.abs(F.col("guess") - F.col("raw_mean"))).alias("mae"), F.count("guess").alias("n"), six(F.count("guess") / F.count("*")).alias("coverage"), six(corr(F.col("guess"), F.col("raw_mean"))).alias("r"))
    return out.crossJoin(F.broadcast(seen)).select("rail", six(F.col("mae")).alias("mae"), "n", "coverage", "r", six(ratio(F.col("observed"), F.col("mae"))).alias("observed_ratio"))


def bridge_coders(ratings: DataFrame) -> DataFrame:
    """(coder, year, bridge): whether the coder rates more than one entity in the year."""
    return ratings.groupBy("coder", "year").agg((F.count_distinct("entity") > 1).alias("bridge"))


def anchor_mad(anchors: DataFrame, min_anchors: int = 5) -> DataFrame:
    """anchors: (coder, anchor, seq, rating). First rating of each anchor, its gap to the anchor's mean over coders; mean gap of coders with enough anchors."""
    first = anchors.where("rating IS NOT NULL").groupBy("coder", "anchor").agg(F.min_by("rating", "seq").alias("rating"))
    centre = first.groupBy("anchor").agg(F.avg("rating").alias("centre"))
    return first.join(centre, "anchor").groupBy("coder").agg(F.avg(F.abs(F.col("rating") - F.col("centre"))).alias("mad"), F.count("*").alias("n_anchors")).where(F.col("n_anchors") >= min_anchors)


def composition(ratings: DataFrame, bridges: DataFrame, mads: DataFrame) -> DataFrame:
    """Per cell: mean, distinct coders, share of bridge coders, mean anchor gap and how many coders have one."""
    rows = ratings.join(bridges, ["coder", "year"], "left").join(mads, "coder", "left")
    return rows.groupBy(*CELL).agg(F.avg("rating").alias("raw_mean"), F.count_distinct("coder").alias("n_coders"), F.avg(F.col("bridge").cast("int")).alias("bridge_share"), F.avg("mad").alias("mean_mad"), F.count("mad").alias("n_mad"))


def directions(ratings: DataFrame, covariates: DataFrame, cut: float = 0.1, min_n: int = 50, top: int = 4) -> DataFrame:
    """(indicator, r, ordinal, action): correlation of the entity means with the covariate decides keep or flip for ordinal indicators."""
    means = ratings.groupBy("entity", "indicator").agg(F.avg("rating").alias("m"))
    cov = covariates.groupBy("entity").agg(F.avg("covariate").alias("c"))
    r = means.join(cov, "entity").groupBy("indicator").agg(corr(F.col("m"), F.col("c")).alias("r"))
    checks = ratings.groupBy("indicator").agg(((F.count("*") >= min_n) & (F.max("rating") == top) & (F.min("rating") <= 1) & (F.count_distinct("rating") >= 4)).alias("ordinal"))
    action = F.when(~F.col("ordinal"), "drop").when(F.col("r") >= cut, "keep").when(F.col("r") <= -cut, "flip").otherwise("drop")
    return r.join(checks, "indicator").select("indicator", six(F.col("r")).alias("r"), "ordinal", action.alias("action"))


def volatility(means: DataFrame, split: int, min_years: int = 5) -> DataFrame:
    out = means.groupBy("entity", "indicator").agg(F.stddev_samp("raw_mean").alias("sd"), F.avg(F.when(F.col("year") < split, F.col("n_coders"))).alias("n_pre"), F.avg(F.when(F.col("year") >= split, F.col("n_coders"))).alias("n_post"), F.count_distinct("year").alias("years"))
    return out.where(F.col("years") >= min_years)


def first_differences(rows: DataFrame, cols: list[str], lagged: list[str] = ()) -> DataFrame:
    """Change of `cols` from the year before, and `lagged` as of then; years without the one before are left out."""
    w = W.partitionBy("entity", "indicator").orderBy("year")
    out = rows.withColumn("_y", F.lag("year").over(w))
    for c in cols:
        out = out.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(w))
    for c in lagged:
        out = out.withColumn(f"lag_{c}", F.lag(c).over(w))
    return out.where("_y = year - 1").drop("_y")


def entity_summary(entity_year: DataFrame) -> DataFrame:
    """Entity's mean covariate less the mean over entities, and its most frequent region (the smallest of ties)."""
    m = entity_year.groupBy("entity").agg(F.avg("covariate").alias("m"))
    counts = entity_year.groupBy("entity", "region").agg(F.count("*").alias("n")).groupBy("entity").agg(F.min(F.struct(-F.col("n"), F.col("region").alias("region"))).alias("x"))
    centre = m.agg(F.avg("m").alias("centre"))
    return m.crossJoin(F.broadcast(centre)).join(counts, "entity").select("entity", six(F.col("m") - F.col("centre")).alias("centred"), F.col("x.region").alias("region"))


def scale_width(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("indicator").agg(F.max("rating").alias("width")).where("width > 0")


def positions(rows: DataFrame, value: str) -> DataFrame:
    """`rows` with `_start` (rows of smaller value), `_same` (rows of this value) and `_total`, by a number of not too many distinct values, without one global sort: counts of values are cumulated by ranges of values, and ranges among themselves. Nulls drop out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_same")).withColumn("_chunk", F.floor(F.col(value) * 8))
    per = counts.groupBy("_chunk").agg(F.sum("_same").alias("_s"))
    per = per.withColumn("_base", F.sum("_s").over(W.partitionBy().orderBy("_chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).withColumn("_total", F.sum("_s").over(W.partitionBy()))
    upto = F.sum("_same").over(W.partitionBy("_chunk").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    start = counts.join(per, "_chunk").withColumn("_start", F.col("_base") + upto - F.col("_same"))
    return rows.join(start.select(value, "_start", "_same", "_total"), value)


def buckets(rows: DataFrame, n: int, by: list[str], order: list[str], name: str = "bucket") -> DataFrame:
    """n equal buckets in `order` within each group of `by` (over all rows, by the number order[0], if there is none), the first ones larger."""
    if by:
        return rows.withColumn(name, F.ntile(n).over(W.partitionBy(*by).orderBy(*order)))
    k = F.col("_start") + F.row_number().over(W.partitionBy(order[0]).orderBy(*order))
    small, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    tile = F.when(k <= extra * (small + 1), F.ceil(k / (small + 1))).otherwise(extra + F.ceil((k - extra * (small + 1)) / small))
    return positions(rows, order[0]).withColumn(name, tile.cast("int")).drop("_start", "_same", "_total")
