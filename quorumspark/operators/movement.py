"""Movement of entities and modules, and its transforms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.operators.panel import positions


def yearly(entity_year: DataFrame) -> DataFrame:
    """(entity, year, m, sm): absolute and signed change of the covariate from the year before."""
    before = entity_year.select("entity", (F.col("year") + 1).alias("year"), F.col("covariate").alias("_b"))
    d = F.col("covariate") - F.col("_b")
    return entity_year.join(before, ["entity", "year"]).select("entity", "year", F.abs(d).alias("m"), d.alias("sm"))


def between_years(entity_year: DataFrame, base: int, year: int) -> DataFrame:
    """(entity, sm, m): signed and absolute change from `base` to `year`; null when one end is missing."""
    wide = entity_year.where(F.col("year").isin(base, year)).groupBy("entity").agg(F.max(F.when(F.col("year") == base, F.col("covariate"))).alias("a"), F.max(F.when(F.col("year") == year, F.col("covariate"))).alias("b"))
    return wide.select("entity", (F.col("b") - F.col("a")).alias("sm"), F.abs(F.col("b") - F.col("a")).alias("m"))


def scale_bounds(scale: Column) -> list[Column]:
    """Least and greatest value of a scale written like 0–4."""
    parts = F.split(scale, "[–-]")
    return [F.trim(parts[i]).cast("double") for i in (0, 1)]


def module_movement(means: DataFrame, modules: DataFrame, base: int, year: int) -> DataFrame:
    """modules: (indicator, module, scale). Change of the module's mean over the other indicators, each scaled to 0..1, for every (entity, indicator)."""
    low, high = scale_bounds(F.col("scale"))
    rows = means.where(F.col("year").isin(base, year)).join(modules, "indicator").withColumn("z", (F.col("raw_mean") - low) / (high - low))
    w = W.partitionBy("entity", "year", "module")
    others = (F.sum("z").over(w) - F.col("z")) / F.nullif(F.count("z").over(w) - 1, F.lit(0))
    rows = rows.withColumn("o", others).groupBy("entity", "indicator").agg(F.max(F.when(F.col("year") == base, F.col("o"))).alias("a"), F.max(F.when(F.col("year") == year, F.col("o"))).alias("b"))
    return rows.select("entity", "indicator", F.abs(F.col("b") - F.col("a")).alias("module_move"))


def mid_rank(rows: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Rank with ties averaged; nulls stay null."""
    ok = F.when(F.col(value).isNotNull(), 1)
    w = W.partitionBy(*by, ok).orderBy(value)
    ties = F.count("*").over(W.partitionBy(*by, value))
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2))


def transforms(rows: DataFrame, signed: str, absolute: str) -> DataFrame:
    """log1p of the size, its percentile rank, and the rank with the sign of the change; ties share their mean rank, nulls stay null."""
    known = positions(rows.where(F.col(absolute).isNotNull()), absolute).withColumn("_r", F.col("_start") + (F.col("_same") + 1) / 2)
    out = known.withColumns({"log1p": F.log1p(absolute), "pct": F.col("_r") / F.col("_total"), "signed_rank": F.signum(signed) * F.col("_r")}).drop("_start", "_same", "_total", "_r")
    rest = rows.where(F.col(absolute).isNull()).withColumns({c: F.lit(None).cast("double") for c in ("log1p", "pct", "signed_rank")})
    return out.unionByName(rest)


def episode_flags(entity_year: DataFrame) -> DataFrame:
    """in_ep and onset as booleans; null is false."""
    return entity_year.withColumn("in_ep", F.coalesce(F.col("dem_ep") == 1, F.lit(False))).withColumn("onset", F.coalesce(F.col("onset") == 1, F.lit(False)))
