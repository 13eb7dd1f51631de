"""Errors and agreement of machine ratings with panels."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import half_even, half_up, ratio, six
from quorumspark.operators.panel import CELL, human_loo, positions

MC = ["model", "condition"]


def score(runs: DataFrame, means: DataFrame) -> DataFrame:
    return runs.join(means, CELL).withColumn("signed_dev", F.col("rating") - F.col("raw_mean")).withColumn("abs_dev", F.abs("signed_dev"))


def mad_table(scored: DataFrame) -> DataFrame:
    """MAE by indicator, and over all rows as _overall, in one pass."""
    out = scored.groupingSets([["condition", "model", "indicator"], ["condition", "model"]], "condition", "model", "indicator").agg(F.round(F.avg("abs_dev"), 3).alias("mae"), F.count("*").alias("n"))
    return out.withColumn("indicator", F.coalesce("indicator", F.lit("_overall")))


def best_cell(scored: DataFrame) -> DataFrame:
    overall = scored.groupBy(*MC).agg(six(F.avg("abs_dev")).alias("mae"))
    return overall.orderBy("mae", *MC).limit(1)


def bias_by(scored: DataFrame, bin_col: str, skip=0) -> DataFrame:
    return scored.where(F.col(bin_col) != skip).groupBy(*MC, bin_col).agg(six(F.avg("signed_dev")).alias("bias"), F.count("*").alias("n"))


def mae_with_humans(scored: DataFrame, ratings: DataFrame, models: list[str], condition: str) -> DataFrame:
    """One row an indicator, a column for each model and one for humans."""
    own = scored.where(F.col("condition") == condition).select("indicator", "model", F.col("abs_dev").alias("e"))
    human = human_loo(ratings).select("indicator", F.lit("human").alias("model"), "e")
    out = own.union(human).groupBy("indicator").pivot("model", [*models, "human"]).agg(six(F.avg("e")))
    return out.select("indicator", *(F.col(m).alias(m.replace("-", "_")) for m in [*models, "human"]))


def hits(scored: DataFrame, gold=half_even) -> DataFrame:
    g = gold(F.col("raw_mean"))
    gap = F.abs(F.col("rating") - g)
    return scored.groupBy(*MC).agg(six(F.avg((gap == 0).cast("int"))).alias("exact"), six(F.avg((gap <= 1).cast("int"))).alias("adjacent"), six(F.avg((F.col("rating") - g) ** 2)).alias("mse"), six(F.sqrt(F.avg(F.col("signed_dev") ** 2))).alias("rmse"), F.count("*").alias("n"))


def human_hits(ratings: DataFrame) -> DataFrame:
    g = half_up(F.col("loo_mean"))
    gap = F.abs(F.col("rating") - g)
    return human_loo(ratings).agg(six(F.avg((gap == 0).cast("int"))).alias("exact"), six(F.avg((gap <= 1).cast("int"))).alias("adjacent"), six(F.avg((F.col("rating") - g) ** 2)).alias("mse"), F.count("*").alias("n"))


def kappa(pairs: DataFrame, by: list[str], k: int = 6, weight: str = "n") -> DataFrame:
    """Quadratic weighted kappa from (by, gold, pred, n) counts: 1 - sum(w o) / sum(w e), by sums only (no k x k matrix leaves the engine)."""
    gap2 = (F.col("gold") - F.col("pred")) ** 2 / (k - 1) ** 2
    o = pairs.groupBy(*by).agg(F.sum(F.col(weight) * gap2).alias("o"), F.sum(weight).alias("n"), F.sum(F.col(weight) * F.col("gold")).alias("g1"), F.sum(F.col(weight) * F.col("gold") ** 2).alias("g2"), F.sum(F.col(weight) * F.col("pred")).alias("p1"), F.sum(F.col(weight) * F.col("pred") ** 2).alias("p2"))
    # sum over all pairs of (gold - pred)^2 under independence
    e = (F.col("g2") + F.col("p2") - 2 * F.col("g1") * F.col("p1") / F.col("n")) / (k - 1) ** 2
    return o.select(*by, six(1 - ratio(F.col("o"), e)).alias("kappa"), F.col("n").cast("long").alias("n"))


def gold_pred(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*MC, half_up(F.col("raw_mean")).alias("gold"), F.col("rating").alias("pred")).agg(F.count("*").alias("n"))


def alpha(values: DataFrame) -> DataFrame:
    """Ordinal Krippendorff's alpha from (grp, unit..., value): coincidences of value counts within units, on at most k x k cells."""
    keys = [c for c in values.columns if c != "value"]
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("c")).withColumn("m", F.sum("c").over(W.partitionBy(*keys))).where("m > 1")
    a, b = counts.alias("a"), counts.select(*keys, F.col("value").alias("v2"), F.col("c").alias("c2")).alias("b")
    both = a.join(b, keys).groupBy("grp", "value", "v2").agg(F.sum((F.col("c") * (F.col("c2") - (F.col("value") == F.col("v2")).cast("int"))) / (F.col("m") - 1)).alias("o"))
    n = both.groupBy("grp", "value").agg(F.sum("o").alias("nv"))
    w = W.partitionBy("grp").orderBy("value")
    n = n.withColumn("below", F.sum("nv").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("nv") / 2).withColumn("total", F.sum("nv").over(W.partitionBy("grp")))
    x = n.select("grp", F.col("value").alias("v1"), F.col("nv").alias("n1"), F.col("below").alias("b1"), "total")
    y = n.select("grp", F.col("value").alias("v2"), F.col("nv").alias("n2"), F.col("below").alias("b2"))
    d = x.join(y, "grp").withColumn("d", (F.col("b1") - F.col("b2")) ** 2)
    obs = both.withColumnRenamed("value", "v1").join(d.select("grp", "v1", "v2", "d"), ["grp", "v1", "v2"]).groupBy("grp").agg(F.sum(F.col("o") * F.col("d")).alias("do"))
    exp = d.groupBy("grp").agg(F.sum(F.col("n1") * F.col("n2") * F.col("d")).alias("de"), F.first("total").alias("total"))
    return obs.join(exp, "grp").select("grp", six(1 - ratio((F.col("total") - 1) * F.col("do"), F.col("de"))).alias("alpha"))


def confusion(scored: DataFrame) -> DataFrame:
    n = gold_pred(scored)
    return n.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy(*MC, "gold"))))


MOVES = (0.25, 0.5, 1.0, 2.0)


def movement_bin(c, edges=MOVES):
    """Left-closed bins 0, 1, ... of |change|."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(c < edges[i], i).otherwise(out)
    return F.when(c.isNotNull(), out)


def by_movement(scored: DataFrame, means: DataFrame) -> DataFrame:
    """Per bin of |change of the mean|: cells, persistence error (continuous and rounded) and MAE of each condition's rows."""
    before = means.select("entity", (F.col("year") + 1).alias("year"), "indicator", F.col("raw_mean").alias("before"))
    rows = scored.join(before, CELL).withColumn("bin", movement_bin(F.abs(F.col("raw_mean") - F.col("before"))))
    return rows.groupBy("condition", "bin").agg(F.count_distinct(*CELL).alias("n_cells"), six(F.avg(F.abs(F.col("before") - F.col("raw_mean")))).alias("pers"), six(F.avg(F.abs(half_even(F.col("before")) - F.col("raw_mean")))).alias("pers_rounded"), six(F.avg("abs_dev")).alias("mae"))


def exaggeration(scored: DataFrame, bin_col: str, low, high) -> DataFrame:
    """Mean signed deviation in the top bin less that in the bottom bin, and the pooled shift."""
    return scored.groupBy(*MC).agg(six(F.avg(F.when(F.col(bin_col) == high, F.col("signed_dev"))) - F.avg(F.when(F.col(bin_col) == low, F.col("signed_dev")))).alias("gap"), six(F.avg("signed_dev")).alias("pooled"))


def wide_by_condition(scored: DataFrame, conditions: list[str]) -> DataFrame:
    """One row a (model, cell), an error column for each condition (values given, so no extra job)."""
    return scored.groupBy("model", *CELL).pivot("condition", conditions).agg(F.first("abs_dev"))


def common_pool(scored: DataFrame, n: int) -> DataFrame:
    """Rows of cells that all n (model, condition) pairs have."""
    whole = scored.groupBy(*CELL).agg(F.count_distinct(*MC).alias("k")).where(F.col("k") == n).select(*CELL)
    return scored.join(whole, CELL, "left_semi")


def rank_bins(rows: DataFrame, value: str, n: int = 20) -> DataFrame:
    """`bin` 1..n of equal counts by value; ties go by cell."""
    k = F.col("_start") + F.row_number().over(W.partitionBy(value).orderBy(*CELL))
    return positions(rows, value).withColumn("bin", F.least(F.ceil(k * n / F.col("_total")), F.lit(n)).cast("int")).drop("_start", "_same", "_total")


def tracking_slope(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*by).agg(six(F.regr_slope(y, x)).alias("slope"), F.regr_count(y, x).alias("n"))


def histogram(rows: DataFrame, by: list[str], value: str, step: float, weight=None) -> DataFrame:
    return rows.groupBy(*by, F.floor(F.col(value) / step).cast("int").alias("b")).agg(F.sum(F.lit(1) if weight is None else weight).cast("double").alias("n"))


def wasserstein(a: DataFrame, b: DataFrame, by: list[str], step: float) -> DataFrame:
    """Wasserstein-1 between histograms a (by, b, n) and one reference b (b, n): step * sum |F - G| over bins."""
    groups = a.select(*by).distinct()
    ref = groups.crossJoin(F.broadcast(b.select(F.col("b"), F.col("n").alias("g"))))
    both = a.select(*by, "b", F.col("n").alias("f"), F.lit(0.0).alias("g")).union(ref.select(*by, "b", F.lit(0.0), "g")).groupBy(*by, "b").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    w, whole = W.partitionBy(*by).orderBy("b"), W.partitionBy(*by)
    cdf = lambda c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(c).over(whole)
    width = F.coalesce(F.lead("b").over(w) - F.col("b"), F.lit(0))
    return both.withColumn("d", F.abs(cdf("f") - cdf("g")) * width * step).groupBy(*by).agg(six(F.sum("d")).alias("w1"))


def concentration(ratings: DataFrame, min_n: int = 50) -> DataFrame:
    """Largest category share of each indicator."""
    n = ratings.groupBy("indicator", "rating").agg(F.count("*").alias("n"))
    return n.groupBy("indicator").agg(F.max("n").alias("top"), F.sum("n").alias("n")).where(F.col("n") >= min_n).select("indicator", (F.col("top") / F.col("n")).alias("share"), "n")


def concentration_verdict(shares: DataFrame) -> DataFrame:
    out = shares.agg(F.percentile("share", 0.5).alias("median"), F.sum((F.col("share") > 0.8).cast("long")).alias("over_80"), F.sum((F.col("share") > 0.95).cast("long")).alias("over_95"), F.count("*").alias("n"))
    return out.select(six(F.col("median")).alias("median"), "over_80", "over_95", "n", F.when(F.col("median") >= 0.6, "concentrated").when(F.col("median") >= 0.5, "borderline").otherwise("spread").alias("verdict"))
