"""Least squares from grouped sums."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import six
from quorumspark.operators.resample import resampled, sums


def wls_draws(rows: DataFrame, w: DataFrame, by: list[str], y: Column, terms: dict[str, Column], key: str = "entity") -> DataFrame:
    """(draw, *by, term, x): coefficients of y on an intercept and `terms` in every draw.

    The normal equations are linear in the rows: their entries are summed once a cluster, weighted a draw, and the k x k systems solved in vectorised batches. Singular systems give nulls.
    """
    names = ["intercept", *terms]
    cols = {"t0": F.lit(1.0), **{f"t{i + 1}": c.cast("double") for i, c in enumerate(terms.values())}, "t_y": y.cast("double")}
    ok = rows.select(key, *by, *(c.alias(n) for n, c in cols.items())).na.drop(subset=list(cols))
    k = len(names)
    cross = {f"m{i}_{j}": F.col(f"t{i}") * F.col(f"t{j}") for i in range(k) for j in range(i, k)} | {f"v{i}": F.col(f"t{i}") * F.col("t_y") for i in range(k)}
    m = resampled(sums(ok, by, key, **cross), w, by, key)

    def solve(frames):
        for f in frames:
            a = np.empty((len(f), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = f[f"m{i}_{j}"]
            b = f[[f"v{i}" for i in range(k)]].to_numpy()
            good = np.linalg.matrix_rank(a) == k if len(f) else np.zeros(0, bool)
            out = np.full((len(f), k), np.nan)
            if good.any():
                out[good] = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
            yield pd.concat([f[["draw", *by]].assign(term=n, x=np.where(good, out[:, i], None)) for i, n in enumerate(names)]).astype({"x": "float64"})

    types = dict(m.dtypes)
    return m.mapInPandas(solve, ", ".join([f"draw {types['draw']}", *(f"{c} {types[c]}" for c in by), "term string", "x double"])).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def by_group(rows: DataFrame, by: list[str], y: str, x: str, min_n: int = 20) -> DataFrame:
    """Slope, R2, n and means of y on x in each group with enough pairs."""
    out = rows.groupBy(*by).agg(six(F.regr_slope(y, x)).alias("slope"), six(F.regr_r2(y, x)).alias("r2"), F.regr_count(y, x).alias("n"), six(F.regr_avgx(y, x)).alias("mean_x"), six(F.regr_avgy(y, x)).alias("mean_y"))
    return out.where(F.col("n") >= min_n)


def line(rows: DataFrame, y: str, x: str) -> DataFrame:
    """Intercept, slope, their standard errors and R2 of one line, by aggregates."""
    m = rows.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mx"))
    s2 = (F.col("syy") - F.col("b") ** 2 * F.col("sxx")) / (F.col("n") - 2)
    return m.select(six(F.col("a")).alias("intercept"), six(F.col("b")).alias("slope"), six(F.sqrt(s2 * (1 / F.col("n") + F.col("mx") ** 2 / F.col("sxx")))).alias("se_intercept"), six(F.sqrt(s2 / F.col("sxx"))).alias("se_slope"), six(F.col("r2")).alias("r2"), "n")


def fitted(rows: DataFrame, y: str, x: str) -> DataFrame:
    m = rows.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    out = rows.crossJoin(F.broadcast(m)).withColumn("fit", F.col("_a") + F.col("_b") * F.col(x))
    return out.withColumn("residual", F.col(y) - F.col("fit")).drop("_a", "_b")


def ranked(groups: DataFrame, by: str, ties: list[str]) -> DataFrame:
    """`groups` (one row a group) with `rank`: 1 for the largest `by`, null last, ties by the group's keys. A group's rank is counted from ranges of 1/1024 between the ends of `by` and its place in
    its range, so a range is sorted in a task and never the table."""
    ends = groups.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    share = (F.col(by) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    rows = groups.crossJoin(F.broadcast(ends)).withColumn("_b", F.coalesce(F.when(F.col(by).isNotNull(), 1023 - F.floor(F.coalesce(share, F.lit(0.0)) * 1023)), F.lit(1024))).drop("_lo", "_hi")
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(W.partitionBy("_b").orderBy(F.desc_nulls_last(by), *ties))
    return rows.join(F.broadcast(per), "_b").withColumn("rank", (F.col("_first") + own).cast("long")).drop("_b", "_first")


def slope_grid(fit: DataFrame, x: str, interaction: str, low: float, high: float, step: float) -> DataFrame:
    """(at, slope, lo, hi): the slope of x at each value of its moderator, est(x) + est(interaction) * at, and the same with both coefficients 1.96 standard errors down and up."""
    pick = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    one = fit.agg(pick(x, "est").alias("b"), pick(x, "se").alias("sb"), pick(interaction, "est").alias("d"), pick(interaction, "se").alias("sd"))
    rows = one.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(round((high - low) / step))), lambda i: F.round(F.lit(low) + i * step, 9))))
    line = lambda z: (F.col("b") + z * F.col("sb")) + (F.col("d") + z * F.col("sd")) * F.col("at")
    return rows.select("at", line(0.0).alias("slope"), line(-1.96).alias("lo"), line(1.96).alias("hi"))
