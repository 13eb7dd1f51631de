"""Name swaps and re-identification."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import six, u
from quorumspark.operators.panel import last_written


def derangement(entities: DataFrame, attempts: int = 64, seed: str = "pair") -> DataFrame:
    """(source, named) from distinct (entity, region): within a region entities are named after each other, uniformly over all bijections without a fixed point.

    Rejection: each attempt is a shuffle by hash, and a region keeps its first attempt that leaves nobody at their own name; of 64 attempts all fail in one of 10^12 regions, which is an error, as is a
    region of one entity. A region's attempts are shuffled in tasks of their own.
    """
    own = entities.withColumn("_j", F.row_number().over(W.partitionBy("region").orderBy("entity")))
    tried = own.withColumn("_a", F.explode(F.sequence(F.lit(1), F.lit(attempts)))).withColumn("_h", u(seed, "_a", "entity"))
    one = W.partitionBy("region", "_a")
    tried = tried.withColumn("_k", F.row_number().over(one.orderBy("_h", "entity"))).withColumn("_fixed", F.sum((F.col("_k") == F.col("_j")).cast("int")).over(one))
    first = tried.groupBy("region").agg(F.min(F.when(F.col("_fixed") == 0, F.col("_a"))).alias("_a"))
    first = first.withColumn("_a", F.coalesce("_a", F.raise_error(F.lit("a region with one entity, or no attempt without a fixed point")).cast("int")))
    kept_ = tried.join(first, ["region", "_a"]).select("region", F.col("entity").alias("source"), F.col("_k").alias("_j"))
    return kept_.join(own.select("region", F.col("entity").alias("named"), "_j"), ["region", "_j"]).select("source", "named")


def eligible(entities: DataFrame, *needed: DataFrame, key: str = "entity") -> DataFrame:
    """Entities that every needed table has."""
    for df in needed:
        entities = entities.join(df.select(key), key, "left_semi")
    return entities


def tracking(swaps: DataFrame, means: DataFrame) -> DataFrame:
    """Per model and swapped cell: gap and signed gap between the two panels, errors to each, track = |r - named| - |r - source|, cue (swapped - correct rating), flip (|cue| of 1 or more)."""
    m = means.select("entity", "year", "indicator", "raw_mean")
    src, named = (m.select(F.col("entity").alias(k), "year", "indicator", F.col("raw_mean").alias(f"m_{k}")) for k in ("source", "named"))
    correct = swaps.where("arm = 'correct'").select("model", "source", "year", "indicator", F.col("rating").alias("r_correct"))
    rows = swaps.where("arm = 'swapped'").join(src, ["source", "year", "indicator"]).join(named, ["named", "year", "indicator"]).join(correct, ["model", "source", "year", "indicator"], "left")
    r = F.col("rating")
    rows = rows.withColumns({"signed_gap": F.col("m_named") - F.col("m_source"), "err_source": F.abs(r - F.col("m_source")), "err_named": F.abs(r - F.col("m_named")), "cue": r - F.col("r_correct")})
    return rows.withColumns({"gap": F.abs("signed_gap"), "track": F.col("err_named") - F.col("err_source"), "flip": (F.abs("cue") >= 1).cast("int")}).withColumn("entity", F.col("source"))


def rescaled(tracked: DataFrame, min_gap: float = 0.5) -> DataFrame:
    return tracked.where(F.col("gap") >= min_gap).withColumn("position", F.col("track") / F.col("gap")).withColumn("win", (F.col("track") > 0).cast("int"))


def demeaned(rows: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    w = W.partitionBy(*by)
    return rows.withColumns({f"{c}_d": F.col(c) - F.avg(c).over(w) for c in cols})


def variants(name: str, aliases: str | None = None):
    """Lower-case name, what stands before a comma, and lower-case aliases."""
    base = F.array(F.lower(name), F.trim(F.split(F.lower(name), ",")[0]))
    return F.array_distinct(F.array_union(base, F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)) if aliases else base)


def response_hits(rows: DataFrame, text: str, names: str) -> DataFrame:
    """top1: a variant in the first line that is not blank; top3: in the whole text."""
    low = F.lower(text)
    first = F.get(F.filter(F.split(low, "\n"), lambda x: F.trim(x) != ""), 0)
    return rows.withColumn("top1", F.coalesce(F.exists(names, lambda v: F.contains(first, v)), F.lit(False))).withColumn("top3", F.coalesce(F.exists(names, lambda v: F.contains(low, v)), F.lit(False)))


def guesses(rows: DataFrame, text: str) -> DataFrame:
    """guess1..guess3 (first line of each rank, cut at a bracket, dash or colon) and the reason."""
    one = lambda k: F.trim(F.regexp_extract(text, rf"(?m)^\s*{k}[.)]\s*([^\n(:–-]*)", 1))
    return rows.withColumns({**{f"guess{k}": F.nullif(one(k), F.lit("")) for k in (1, 2, 3)}, "reason": F.nullif(F.trim(F.regexp_extract(text, r"(?mi)^\s*reason:\s*(.*)$", 1)), F.lit(""))})


def coded(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Guesses to entity codes by a dimension (name, code); hit1 and hit3 against `iso`, missing guesses are no hits."""
    out = rows
    for k in (1, 2, 3):
        out = out.join(names.select(F.col("name").alias(f"guess{k}"), F.col("code").alias(f"code{k}")), f"guess{k}", "left")
    hit = lambda k: F.coalesce(F.col(f"code{k}") == F.col("iso"), F.lit(False))
    return out.withColumn("hit1", hit(1)).withColumn("hit3", hit(1) | hit(2) | hit(3))


def latest(log: DataFrame) -> DataFrame:
    return last_written(log, ["iso", "year", "indicator", "treatment", "model"])


def accuracy(rows: DataFrame, by: list[str], min_n: int = 1) -> DataFrame:
    out = rows.groupBy(*by).agg(six(F.avg(F.col("hit1").cast("int"))).alias("top1"), six(F.avg(F.col("hit3").cast("int"))).alias("top3"), F.count("*").alias("n"), F.count_distinct("iso").alias("n_entities"))
    return out.where(F.col("n") >= min_n)


def summary(rows: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    h1, h3 = F.col("hit1"), F.col("hit3")
    return rows.agg(n(h1).alias("top1"), n(h3).alias("top3"), n(h3 & ~h1).alias("in_3_not_1"), n(~h3).alias("none"), F.count("*").alias("n"))


def wrong_guesses(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    n = rows.where(~F.col("hit1") & F.col("guess1").isNotNull()).groupBy(*by, "guess1").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "guess1"))).where(F.col("k") <= top)


def cue_type(text, classes: list[tuple[str, str]], other: str = "other"):
    """Name of the first class whose pattern the text has."""
    out = F.lit(other)
    for name, pattern in reversed(classes):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def flip_category(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(*by, category, delta) of groups that both treatments have: both_correct (top-1 rates of 1), both_wrong (top-3 rates of 0), the treatment with the larger top-1 rate, or tied; delta is b - a."""
    rate = lambda hit, t: F.avg(F.when(F.col("treatment") == t, F.col(hit).cast("int")))
    w = rows.groupBy(*by).agg(rate("hit1", a).alias("_a"), rate("hit1", b).alias("_b"), rate("hit3", a).alias("_a3"), rate("hit3", b).alias("_b3")).where("_a IS NOT NULL AND _b IS NOT NULL")
    category = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both_correct").when((F.col("_a3") == 0) & (F.col("_b3") == 0), "both_wrong").when(F.col("_a") > F.col("_b"), f"{a}_only").when(F.col("_b") > F.col("_a"), f"{b}_only").otherwise("tied")
    return w.select(*by, category.alias("category"), (F.col("_b") - F.col("_a")).alias("delta"))


def region_rates(rows: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Exact top-1 rate, rates of the first and of any of three guesses in the right region, wrong rows, and the share of those whose first guess is in the region; a guess without a region is not."""
    out = rows.join(regions.select(F.col("entity").alias("iso"), F.col("region").alias("_r")), "iso")
    for k in (1, 2, 3):
        out = out.join(regions.select(F.col("entity").alias(f"code{k}"), F.col("region").alias(f"_r{k}")), f"code{k}", "left")
    inside = [F.coalesce(F.col(f"_r{k}") == F.col("_r"), F.lit(False)) for k in (1, 2, 3)]
    rate = lambda c: six(F.avg(c.cast("int")))
    any_ = inside[0] | inside[1] | inside[2]
    return out.groupBy(*by).agg(F.count("*").alias("n"), rate(F.col("hit1")).alias("exact"), rate(inside[0]).alias("top1_in_region"), rate(any_).alias("top3_in_region"), F.count_if(~F.col("hit1")).alias("n_wrong"), six(F.avg(F.when(~F.col("hit1"), inside[0].cast("int")))).alias("wrong_in_region"))


def side_by_side(rows: DataFrame, a: str, b: str) -> DataFrame:
    """For entities whose rate is larger under treatment a: the reasons of their hits there, and under b those of their misses with the wrong guess."""
    only = flip_category(rows, a, b, ["iso"]).where(F.col("category") == f"{a}_only").select("iso")
    own = rows.join(only, "iso", "left_semi")
    first, second = (F.col("treatment") == a) & F.col("hit1"), (F.col("treatment") == b) & ~F.col("hit1")
    return own.where(first | second).withColumn("wrong_guess", F.when(F.col("treatment") == b, F.col("guess1")))


def salience(cells: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """none, anon or summ: under which treatment a cell is identified; a cell without a log row counts as not identified."""
    w = rows.groupBy(*keys).pivot("treatment", ["anon", "summ"]).agg(F.max(F.col("hit1").cast("int")))
    out = cells.join(w, keys, "left").na.fill(0, ["anon", "summ"])
    return out.withColumn("salience", F.when(F.col("summ") == 1, "summ").when(F.col("anon") == 1, "anon").otherwise("none")).drop("anon", "summ")
