"""Machine-versus-human errors over the derived tables."""

from pyspark.sql import functions as F

from quorumspark.functions import core
from quorumspark.functions.core import half_even, half_up, six
from quorumspark.operators import metrics as M
from quorumspark.operators import panel as P
from quorumspark.plans.panels import LOO
from quorumspark.plans.registry import query
from quorumspark.sources.views import CONDITIONS, MODELS, _u

CELL, MC = P.CELL, M.MC
BEFORE = "b AS (SELECT entity, year + 1 AS year, indicator, raw_mean AS before FROM means)"
MAE = "mae AS (SELECT entity, year, indicator, avg(e) AS h, any_value(n) AS n FROM loo GROUP BY entity, year, indicator)"


@query("c1_scored", "SELECT model, condition, entity, year, indicator, rating, round(signed_dev, 6) AS signed_dev, round(abs_dev, 6) AS abs_dev FROM scored")
def _(v):
    return M.score(v.runs, v.means).select(*MC, *CELL, "rating", six(F.col("signed_dev")).alias("signed_dev"), six(F.col("abs_dev")).alias("abs_dev"))


@query("c2_mad_table", "SELECT condition, model, coalesce(indicator, '_overall') AS indicator, round(avg(abs_dev), 3) AS mae, count(*) AS n FROM scored GROUP BY GROUPING SETS ((condition, model, indicator), (condition, model))")
def _(v):
    return M.mad_table(v.scored)


@query("c3_best_cell", "SELECT model, condition, round(avg(abs_dev), 6) AS mae FROM scored GROUP BY ALL ORDER BY mae, model, condition LIMIT 1")
def _(v):
    return M.best_cell(v.scored)


@query("c4_bias_by_quintile", "SELECT model, condition, quintile, round(avg(signed_dev), 6) AS bias, count(*) AS n FROM scored WHERE quintile <> 0 GROUP BY ALL")
def _(v):
    return M.bias_by(v.scored, "quintile")


@query("c5_mae_with_humans", "SELECT indicator, round(avg(e) FILTER (m = 'base'), 6) AS base, round(avg(e) FILTER (m = 'base-ft'), 6) AS base_ft, round(avg(e) FILTER (m = 'other'), 6) AS other, round(avg(e) FILTER (m = 'human'), 6) AS human FROM (SELECT indicator, model AS m, abs_dev AS e FROM scored WHERE condition = 'correct' UNION ALL SELECT indicator, 'human', e FROM loo) GROUP BY indicator", LOO)
def _(v):
    return M.mae_with_humans(v.scored, v.ratings, list(MODELS), "correct")


_HITS = "SELECT model, condition, round(avg((abs(rating - g) = 0)::INT), 6) AS exact, round(avg((abs(rating - g) <= 1)::INT), 6) AS adjacent, round(avg((rating - g) ** 2), 6) AS mse, round(sqrt(avg(signed_dev ** 2)), 6) AS rmse, count(*) AS n FROM (SELECT *, {} AS g FROM scored) GROUP BY ALL"


@query("c6_hits_half_even", _HITS.format("round_even(raw_mean, 0)"))
def _(v):
    return M.hits(v.scored, half_even)


@query("c7_hits_gold", _HITS.format("floor(raw_mean + 0.5)"))
def _(v):
    return M.hits(v.scored, half_up)


@query("c7_human_hits", "SELECT round(avg((rating = g)::INT), 6) AS exact, round(avg((abs(rating - g) <= 1)::INT), 6) AS adjacent, round(avg((rating - g) ** 2), 6) AS mse, count(*) AS n FROM (SELECT *, floor(loo_mean + 0.5) AS g FROM loo)", LOO)
def _(v):
    return M.human_hits(v.ratings)


@query("c8_rmse", "SELECT model, condition, round(sqrt(avg((rating - floor(raw_mean + 0.5)) ** 2)), 6) AS rmse FROM scored GROUP BY ALL")
def _(v):
    return v.scored.groupBy(*MC).agg(six(F.sqrt(F.avg((F.col("rating") - half_up(F.col("raw_mean"))) ** 2))).alias("rmse"))


_KAPPA = "SELECT {by}round(1 - sum(n * (gold - pred) ** 2) / nullif(sum(n * gold ** 2) + sum(n * pred ** 2) - 2 * sum(n * gold) * sum(n * pred) / sum(n), 0), 6) AS kappa, sum(n)::BIGINT AS n FROM ({src}) {group}"


@query("c9_kappa", _KAPPA.format(by="model, condition, ", group="GROUP BY model, condition", src="SELECT model, condition, floor(raw_mean + 0.5) AS gold, rating AS pred, count(*) AS n FROM scored GROUP BY ALL"))
def _(v):
    return M.kappa(M.gold_pred(v.scored), MC)


@query("c9_human_kappa", _KAPPA.format(by="", group="", src="SELECT floor(loo_mean + 0.5) AS gold, rating AS pred, count(*) AS n FROM loo GROUP BY ALL"), LOO)
def _(v):
    pairs = P.human_loo(v.ratings).groupBy(half_up(F.col("loo_mean")).alias("gold"), F.col("rating").alias("pred")).agg(F.count("*").alias("n"))
    return M.kappa(pairs.withColumn("all", F.lit(1)), ["all"]).drop("all")


_ALPHA = """vals AS (SELECT 'humans' AS grp, entity, year, indicator, rating AS value FROM ratings UNION ALL SELECT 'with_machine', entity, year, indicator, rating FROM ratings UNION ALL SELECT 'with_machine', entity, year, indicator, rating FROM runs WHERE model = 'base' AND condition = 'correct'),
cc AS (SELECT *, sum(c) OVER (PARTITION BY grp, entity, year, indicator) AS m FROM (SELECT grp, entity, year, indicator, value, count(*) AS c FROM vals GROUP BY ALL)),
oo AS (SELECT a.grp, a.value AS v1, b.value AS v2, sum(a.c * (b.c - (a.value = b.value)::INT) / (a.m - 1)) AS o FROM cc a JOIN cc b USING (grp, entity, year, indicator) WHERE a.m > 1 GROUP BY ALL),
nn AS (SELECT *, sum(nv) OVER (PARTITION BY grp ORDER BY v1) - nv / 2 AS below, sum(nv) OVER (PARTITION BY grp) AS total FROM (SELECT grp, v1, sum(o) AS nv FROM oo GROUP BY ALL)),
dd AS (SELECT x.grp, x.v1, y.v1 AS v2, x.nv * y.nv AS nn, (x.below - y.below) ** 2 AS d, x.total FROM nn x JOIN nn y USING (grp)),
alphas AS (SELECT grp, 1 - (any_value(total) - 1) * (SELECT sum(o * d) FROM oo JOIN dd e USING (grp, v1, v2) WHERE e.grp = dd.grp) / sum(nn * d) AS alpha FROM dd GROUP BY grp)"""


@query("c10_alpha", "SELECT grp, round(alpha, 6) AS alpha FROM alphas", _ALPHA)
def _(v):
    own = v.ratings.select(*CELL, F.col("rating").alias("value"))
    ai = v.runs.where("model = 'base' AND condition = 'correct'").select(*CELL, F.col("rating").alias("value"))
    return M.alpha(own.select(F.lit("humans").alias("grp"), "*").union(own.union(ai).select(F.lit("with_machine"), "*")))


@query("c11_scaled_mae", "SELECT model, condition, round(avg(abs_dev / width), 6) AS nmae, round(avg(abs(round_even(raw_mean, 0) - raw_mean) / width), 6) AS nfloor, round(avg(abs(round_even(raw_mean, 0) - raw_mean) / width) / 2, 6) AS nsesoi, round(avg(h / width), 6) AS nhuman FROM scored JOIN (SELECT indicator, max(rating) AS width FROM ratings GROUP BY indicator) USING (indicator) JOIN mae USING (entity, year, indicator) GROUP BY ALL", LOO, MAE)
def _(v):
    rows = v.scored.join(P.scale_width(v.ratings), "indicator").join(P.human_mae(v.ratings).select(*CELL, "h"), CELL)
    floor = F.avg(F.abs(half_even(F.col("raw_mean")) - F.col("raw_mean")) / F.col("width"))
    return rows.groupBy(*MC).agg(six(F.avg(F.col("abs_dev") / F.col("width"))).alias("nmae"), six(floor).alias("nfloor"), six(floor / 2).alias("nsesoi"), six(F.avg(F.col("h") / F.col("width"))).alias("nhuman"))


@query("c12_confusion", "SELECT *, round(n / sum(n) OVER (PARTITION BY model, condition, gold), 6) AS share FROM (SELECT model, condition, floor(raw_mean + 0.5)::INT AS gold, rating AS pred, count(*) AS n FROM scored GROUP BY ALL)")
def _(v):
    return M.confusion(v.scored)


_EXP = "ex AS (SELECT *, CASE WHEN dist IS NOT NULL THEN list_sum(list_transform(dist, lambda x, i: x * (i - 1))) / list_sum(dist) END AS ev FROM dists)"


@query("c13_expectation", "SELECT entity, year, indicator, round(ev, 6) AS ev FROM ex", _EXP)
def _(v):
    return v.dists.select(*CELL, six(core.expectation(F.col("dist"))).alias("ev"))


@query("c14_missing_readout", "SELECT year, count(*) AS n, count(*) FILTER (ev IS NULL) AS n_missing FROM ex GROUP BY year", _EXP)
def _(v):
    ev = core.expectation(F.col("dist"))
    return v.dists.groupBy("year").agg(F.count("*").alias("n"), F.sum(ev.isNull().cast("long")).alias("n_missing"))


@query("c15_readout_gain", "SELECT year, round(avg(abs(rating - raw_mean)) - avg(abs(ev - raw_mean)), 6) AS gain, count(*) AS n FROM ex JOIN means USING (entity, year, indicator) WHERE ev IS NOT NULL GROUP BY year", _EXP, once=("means",))
def _(v):
    # means are written first: else the filter on ev, some hundred hashes of a cell's keys, is pushed below their aggregation and runs for every line item
    rows = v.dists.withColumn("ev", core.expectation(F.col("dist"))).where("ev IS NOT NULL").join(v.means, CELL)
    return rows.groupBy("year").agg(six(F.avg(F.abs(F.col("rating") - F.col("raw_mean"))) - F.avg(F.abs(F.col("ev") - F.col("raw_mean")))).alias("gain"), F.count("*").alias("n"))


@query("c16_temperatures", """SELECT t, round(avg(list_sum(list_transform(q, lambda p, i: p * abs(i - 1 - raw_mean)))), 6) AS abs_error, round(avg(list_sum(list_transform(q, lambda p, i: p * (i - 1 - raw_mean)))), 6) AS signed_error, count(*) AS n FROM (
  SELECT t, raw_mean, CASE WHEN t = 0 THEN list_transform(dist, lambda p, i: (i = list_position(dist, list_max(dist)))::INT::DOUBLE) ELSE list_transform(list_transform(dist, lambda p: exp((ln(p) - ln(list_max(dist))) / greatest(t, 0.001))), lambda x: x / list_sum(list_transform(dist, lambda p: exp((ln(p) - ln(list_max(dist))) / greatest(t, 0.001))))) END AS q
  FROM dists JOIN means USING (entity, year, indicator) CROSS JOIN (SELECT i / 10.0::DOUBLE AS t FROM range(11) r(i)) WHERE dist IS NOT NULL) GROUP BY t""")
def _(v):
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10.0))
    rows = v.dists.where((F.size("dist") >= 2) & (F.abs(F.aggregate("dist", F.lit(0.0), lambda s, x: s + x) - 1) < 0.05)).join(v.means, CELL).select("dist", "raw_mean", steps.alias("t"))
    rows = rows.select("t", "raw_mean", core.tempered(F.col("dist"), F.col("t")).alias("q"))
    return rows.groupBy("t").agg(six(F.avg(core.spread_error(F.col("q"), F.col("raw_mean")))).alias("abs_error"), six(F.avg(core.spread_error(F.col("q"), F.col("raw_mean"), True))).alias("signed_error"), F.count("*").alias("n"))


_BIN = "CASE WHEN g < 0.25 THEN 0 WHEN g < 0.5 THEN 1 WHEN g < 1 THEN 2 WHEN g < 2 THEN 3 ELSE 4 END"


@query("c17_movement_bins", f"SELECT condition, {_BIN} AS bin, count(DISTINCT (entity, year, indicator)) AS n_cells, round(avg(g), 6) AS pers, round(avg(abs(round_even(before, 0) - raw_mean)), 6) AS pers_rounded, round(avg(abs_dev), 6) AS mae FROM (SELECT *, abs(raw_mean - before) AS g FROM scored JOIN b USING (entity, year, indicator)) GROUP BY ALL", BEFORE)
def _(v):
    return M.by_movement(v.scored, v.means)


@query("c18_exaggeration", "SELECT model, condition, round(avg(signed_dev) FILTER (quintile = 5) - avg(signed_dev) FILTER (quintile = 1), 6) AS gap, round(avg(signed_dev), 6) AS pooled FROM scored GROUP BY ALL")
def _(v):
    return M.exaggeration(v.scored, "quintile", 1, 5)


@query("c18_ord_reference", "SELECT regime, round(avg(ord - raw_mean), 6) AS ord_bias, round(avg(signed_dev), 6) AS bias, round(avg(rating - ord), 6) AS against_ord FROM scored JOIN ord_ USING (entity, year, indicator) GROUP BY regime")
def _(v):
    return v.scored.join(v.ord, CELL).groupBy("regime").agg(six(F.avg(F.col("ord") - F.col("raw_mean"))).alias("ord_bias"), six(F.avg("signed_dev")).alias("bias"), six(F.avg(F.col("rating") - F.col("ord"))).alias("against_ord"))


@query("c19_net_of_rounding", "SELECT quintile, round(avg(round_even(raw_mean, 0) - raw_mean), 6) AS rounding_gap, round(avg(signed_dev) - avg(round_even(raw_mean, 0) - raw_mean), 6) AS net FROM scored WHERE model = 'base' AND condition = 'correct' GROUP BY quintile")
def _(v):
    gap = F.avg(half_even(F.col("raw_mean")) - F.col("raw_mean"))
    return v.scored.where("model = 'base' AND condition = 'correct'").groupBy("quintile").agg(six(gap).alias("rounding_gap"), six(F.avg("signed_dev") - gap).alias("net"))


@query("c20_evidence_gain", "SELECT model, round(avg(codebook - correct), 6) AS gain_correct, round(avg(codebook - anon), 6) AS gain_anon, round(avg(codebook - summ), 6) AS gain_summ, count(*) AS n FROM (SELECT model, entity, year, indicator, any_value(abs_dev) FILTER (condition = 'codebook') AS codebook, any_value(abs_dev) FILTER (condition = 'correct') AS correct, any_value(abs_dev) FILTER (condition = 'anon') AS anon, any_value(abs_dev) FILTER (condition = 'summ') AS summ FROM scored GROUP BY model, entity, year, indicator) GROUP BY model")
def _(v):
    w = M.wide_by_condition(v.scored, list(CONDITIONS))
    return w.groupBy("model").agg(*(six(F.avg(F.col("codebook") - F.col(c))).alias(f"gain_{c}") for c in CONDITIONS[1:]), F.count("*").alias("n"))


@query("c21_common_pool", "SELECT model, condition, count(*) AS n, round(avg(abs_dev), 6) AS mae FROM (SELECT * FROM scored WHERE NOT (model = 'other' AND rating = 3)) WHERE (entity, year, indicator) IN (SELECT (entity, year, indicator) FROM scored WHERE NOT (model = 'other' AND rating = 3) GROUP BY entity, year, indicator HAVING count(DISTINCT (model, condition)) = 12) GROUP BY ALL".replace("(entity, year, indicator) IN (SELECT (entity, year, indicator)", "(entity, year, indicator) IN (SELECT entity, year, indicator"))
def _(v):
    pool = M.common_pool(v.scored.where("NOT (model = 'other' AND rating = 3)"), 12)
    return pool.groupBy(*MC).agg(F.count("*").alias("n"), six(F.avg("abs_dev")).alias("mae"))


_CUTS = "cuts AS (SELECT quantile_cont(h, 0.2) AS q1, quantile_cont(h, 0.4) AS q2, quantile_cont(h, 0.6) AS q3, quantile_cont(h, 0.8) AS q4 FROM mae)"


@query("c22_difficulty_strata", "SELECT model, condition, (1 + (h > q1)::INT + (h > q2)::INT + (h > q3)::INT + (h > q4)::INT) AS stratum, round(avg(abs_dev), 6) AS mae, round(avg(h), 6) AS human, count(*) AS n FROM scored JOIN mae USING (entity, year, indicator) CROSS JOIN cuts GROUP BY ALL", LOO, "mae AS (SELECT entity, year, indicator, round(avg(e), 9) AS h FROM loo GROUP BY entity, year, indicator)", _CUTS)
def _(v):
    h = P.human_mae(v.ratings).select(*CELL, F.round("h", 9).alias("h"))
    cuts = h.agg(F.percentile("h", [0.2, 0.4, 0.6, 0.8]).alias("q"))
    rows = v.scored.join(h, CELL).crossJoin(F.broadcast(cuts)).withColumn("stratum", F.lit(1) + F.size(F.filter("q", lambda q: F.col("h") > q)))
    return rows.groupBy(*MC, "stratum").agg(six(F.avg("abs_dev")).alias("mae"), six(F.avg("h")).alias("human"), F.count("*").alias("n"))


@query("c23_difficulty_curve", "SELECT model, condition, bin, round(avg(h), 6) AS h, round(avg(abs_dev), 6) AS mae FROM scored JOIN (SELECT *, least(ceil(row_number() OVER (ORDER BY h, entity, year, indicator) * 20.0 / count(*) OVER ()), 20)::INT AS bin FROM mae) USING (entity, year, indicator) GROUP BY ALL", LOO, "mae AS (SELECT entity, year, indicator, round(avg(e), 9) AS h FROM loo GROUP BY entity, year, indicator)")
def _(v):
    h = P.human_mae(v.ratings).select(*CELL, F.round("h", 9).alias("h"))
    return v.scored.join(M.rank_bins(h, "h"), CELL).groupBy(*MC, "bin").agg(six(F.avg("h")).alias("h"), six(F.avg("abs_dev")).alias("mae"))


@query("c24_tracking_slope", "SELECT model, condition, round(regr_slope(abs_dev, h), 6) AS slope, regr_count(abs_dev, h)::BIGINT AS n FROM scored JOIN mae USING (entity, year, indicator) GROUP BY ALL", LOO, MAE)
def _(v):
    return M.tracking_slope(v.scored.join(P.human_mae(v.ratings), CELL), MC, "abs_dev", "h")


_W1 = """ha AS (SELECT {by}, floor(e9 / {step})::INT AS b, count(*)::DOUBLE AS f FROM ({a}) GROUP BY ALL), hb AS (SELECT floor(e9 / {step})::INT AS b, count(*)::DOUBLE AS g FROM ({b}) GROUP BY ALL),
hh AS (SELECT {by}, b, sum(f) AS f, sum(g) AS g FROM (SELECT {by}, b, f, 0.0::DOUBLE AS g FROM ha UNION ALL SELECT {by}, b, 0.0, g FROM hb CROSS JOIN (SELECT DISTINCT {by} FROM ha)) GROUP BY ALL),
w1 AS (SELECT {by}, round(sum(d), 6) AS w1 FROM (SELECT {by}, abs(sum(f) OVER w / sum(f) OVER v - sum(g) OVER w / sum(g) OVER v) * coalesce(lead(b) OVER w - b, 0) * {step} AS d FROM hh WINDOW w AS (PARTITION BY {by} ORDER BY b), v AS (PARTITION BY {by})) GROUP BY ALL)"""


@query("c25_wasserstein", "SELECT * FROM w1", LOO, _W1.format(by="model, condition", step="0.002", a="SELECT model, condition, abs_dev + 1e-9 AS e9 FROM scored", b="SELECT e + 1e-9 AS e9 FROM loo"))
def _(v):
    ai = M.histogram(v.scored.withColumn("x", F.col("abs_dev") + 1e-9), MC, "x", 0.002)
    human = M.histogram(P.human_loo(v.ratings).withColumn("x", F.col("e") + 1e-9), [], "x", 0.002)
    return M.wasserstein(ai, human, MC, 0.002)


@query("c26_w1_floor", "SELECT * FROM w1", LOO, _W1.format(by="rep", step="0.002", a=f"SELECT rep, e + 1e-9 AS e9 FROM (SELECT rep, e, row_number() OVER (PARTITION BY rep, entity, year, indicator ORDER BY {_u('one', 'rep', 'entity', 'year', 'indicator', 'coder')}, coder) AS k FROM loo CROSS JOIN range(5) r(rep)) WHERE k = 1", b="SELECT e + 1e-9 AS e9 FROM loo"))
def _(v):
    loo = P.human_loo(v.ratings)
    reps = loo.select(*CELL, "coder", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("rep"))
    one = reps.withColumn("h", core.u("one", "rep", *CELL, "coder")).groupBy("rep", *CELL).agg(F.min_by("e", F.struct("h", "coder")).alias("e"))
    hist = lambda rows, by: M.histogram(rows.withColumn("x", F.col("e") + 1e-9), by, "x", 0.002)
    return M.wasserstein(hist(one, ["rep"]), hist(loo, []), ["rep"], 0.002)


_CONC = "conc AS (SELECT indicator, max(n) / sum(n) AS share, sum(n)::BIGINT AS n FROM (SELECT indicator, rating, count(*) AS n FROM ratings GROUP BY ALL) GROUP BY indicator HAVING sum(n) >= 50)"


@query("c27_concentration", "SELECT indicator, round(share, 6) AS share, n FROM conc", _CONC)
def _(v):
    return M.concentration(v.ratings).withColumn("share", six(F.col("share")))


@query("c27_verdict", "SELECT round(quantile_cont(share, 0.5), 6) AS median, count(*) FILTER (share > 0.8) AS over_80, count(*) FILTER (share > 0.95) AS over_95, count(*) AS n, CASE WHEN quantile_cont(share, 0.5) >= 0.6 THEN 'concentrated' WHEN quantile_cont(share, 0.5) >= 0.5 THEN 'borderline' ELSE 'spread' END AS verdict FROM conc", _CONC)
def _(v):
    return M.concentration_verdict(M.concentration(v.ratings))
