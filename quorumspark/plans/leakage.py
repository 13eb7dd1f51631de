"""Identity, movement, workforce, texts and samples over the derived tables."""

from pyspark.sql import functions as F

from quorumspark.functions.core import half_even, six, u
from quorumspark.operators import evidence as E
from quorumspark.operators import identity as I
from quorumspark.operators import movement as V
from quorumspark.operators import panel as P
from quorumspark.operators import resample as R
from quorumspark.operators import texts as X
from quorumspark.operators import workforce as K
from quorumspark.plans.inference import NAMES, WEIGHTS, _boot, _ci, _mean, _slope
from quorumspark.plans.registry import query
from quorumspark.sources.views import _u

CELL = P.CELL
TRACK = """tr AS (SELECT s.model, s.source, s.source AS entity, s.named, s.year, s.indicator, s.rating, b.raw_mean - a.raw_mean AS signed_gap, abs(b.raw_mean - a.raw_mean) AS gap, abs(s.rating - a.raw_mean) AS err_source, abs(s.rating - b.raw_mean) AS err_named, abs(s.rating - b.raw_mean) - abs(s.rating - a.raw_mean) AS track, s.rating - c.rating AS cue, (abs(s.rating - c.rating) >= 1)::INT AS flip
FROM swaps s JOIN means a ON a.entity = s.source AND a.year = s.year AND a.indicator = s.indicator JOIN means b ON b.entity = s.named AND b.year = s.year AND b.indicator = s.indicator LEFT JOIN swaps c ON c.arm = 'correct' AND c.model = s.model AND c.source = s.source AND c.year = s.year AND c.indicator = s.indicator WHERE s.arm = 'swapped')"""
REID = r"""last_ AS (SELECT iso, year, indicator, treatment, model, arg_max(response, seq) AS response FROM log_ GROUP BY ALL),
coded AS (SELECT *, guess1 = iso AS hit1, guess1 = iso OR guess2 = iso AS hit3 FROM (SELECT *, trim(regexp_extract(response, '1\. ([^\n(:–-]*)', 1)) AS guess1, trim(regexp_extract(response, '2\. ([^\n(:–-]*)', 1)) AS guess2, trim(regexp_extract(response, '3\. ([^\n(:–-]*)', 1)) AS guess3, trim(regexp_extract(response, 'Reason: (.*)', 1)) AS reason FROM last_))"""

FLIPS = "flip_ AS (SELECT iso, avg(hit1::INT) FILTER (treatment = 'anon') AS a, avg(hit1::INT) FILTER (treatment = 'summ') AS b, avg(hit3::INT) FILTER (treatment = 'anon') AS a3, avg(hit3::INT) FILTER (treatment = 'summ') AS b3 FROM coded GROUP BY iso HAVING count(*) FILTER (treatment = 'anon') > 0 AND count(*) FILTER (treatment = 'summ') > 0)"


def _track(v):
    return I.tracking(v.swaps, v.means)


def _coded(v):
    names = v.orders.select(F.col("entity").alias("name"), F.col("entity").alias("code")).distinct()
    return I.coded(I.guesses(I.latest(v.log), "response"), names)


@query("g1_pairs", "SELECT source, named FROM pairs")
def _(v):
    return v.pairs


@query("g2_eligible", "SELECT DISTINCT entity FROM orders_ WHERE entity IN (SELECT entity FROM means) AND entity IN (SELECT entity FROM entity_year WHERE quintile >= 3)")
def _(v):
    return I.eligible(v.orders.select("entity").distinct(), v.means, v.entity_year.where("quintile >= 3"))


@query("g3_tracking", "SELECT model, source, named, year, indicator, round(gap, 6) AS gap, round(signed_gap, 6) AS signed_gap, round(err_source, 6) AS err_source, round(err_named, 6) AS err_named, round(track, 6) AS track, cue, flip FROM tr", TRACK)
def _(v):
    return _track(v).select("model", "source", "named", "year", "indicator", *(six(F.col(c)).alias(c) for c in ("gap", "signed_gap", "err_source", "err_named", "track")), "cue", "flip")


@query("g4_tracking_ci", _ci("model", _mean("model", "tr", "track")), TRACK, NAMES, WEIGHTS, once=('means', 'swaps'))
def _(v):
    return R.ci(R.boot_mean(_track(v), _boot(v), ["model"], F.col("track")), ["model"])


@query("g5_gap_terciles", "SELECT model, tercile, round(avg(track), 6) AS track, round(avg(gap), 6) AS gap, count(*) AS n FROM (SELECT *, ntile(3) OVER (PARTITION BY model ORDER BY round(gap, 9), source, year, indicator) AS tercile FROM tr) GROUP BY model, tercile", TRACK)
def _(v):
    t = P.buckets(_track(v).withColumn("g9", F.round("gap", 9)), 3, ["model"], ["g9", "source", "year", "indicator"], "tercile")
    return t.groupBy("model", "tercile").agg(six(F.avg("track")).alias("track"), six(F.avg("gap")).alias("gap"), F.count("*").alias("n"))


@query("g6_rescaled", "SELECT model, round(avg(track / gap), 6) AS position, round(avg((track > 0)::INT), 6) AS win, count(*) AS n, round(count(*) / any_value(total), 6) AS retained FROM (SELECT *, count(*) OVER (PARTITION BY model) AS total FROM tr) WHERE gap >= 0.5 GROUP BY model", TRACK)
def _(v):
    t = _track(v)
    total = t.groupBy("model").agg(F.count("*").alias("total"))
    out = I.rescaled(t).groupBy("model").agg(six(F.avg("position")).alias("position"), six(F.avg("win")).alias("win"), F.count("*").alias("n"))
    return out.join(total, "model").select("model", "position", "win", "n", six(F.col("n") / F.col("total")).alias("retained"))


@query("g7_channels", "SELECT model, round(avg(abs(cue)), 6) AS cue, round(avg(flip), 6) AS flip, round(regr_slope(rd, gd), 6) AS pull FROM (SELECT *, rating - avg(rating) OVER (PARTITION BY model, indicator) AS rd, signed_gap - avg(signed_gap) OVER (PARTITION BY model, indicator) AS gd FROM tr) GROUP BY model", TRACK, once=('means', 'swaps'))
def _(v):
    return I.demeaned(_track(v), ["rating", "signed_gap"], ["model", "indicator"]).groupBy("model").agg(six(F.avg(F.abs("cue"))).alias("cue"), six(F.avg("flip")).alias("flip"), six(F.regr_slope("rating_d", "signed_gap_d")).alias("pull"))


@query("g8_ladder", "SELECT model, round(avg(cue), 6) AS swapped_less_correct, round(avg(correct - none_), 6) AS correct_less_none, count(*) AS n FROM (SELECT tr.*, s.rating AS correct, r.rating AS none_ FROM tr JOIN swaps s ON s.arm = 'correct' AND s.model = tr.model AND s.source = tr.source AND s.year = tr.year AND s.indicator = tr.indicator JOIN runs r ON r.model = tr.model AND r.condition = 'codebook' AND r.entity = tr.source AND r.year = tr.year AND r.indicator = tr.indicator) GROUP BY model", TRACK)
def _(v):
    none = v.runs.where("condition = 'codebook'").select("model", "entity", "year", "indicator", F.col("rating").alias("none_"))
    t = _track(v).join(none, ["model", "entity", "year", "indicator"])
    return t.groupBy("model").agg(six(F.avg("cue")).alias("swapped_less_correct"), six(F.avg(F.col("r_correct") - F.col("none_"))).alias("correct_less_none"), F.count("*").alias("n"))


@query("g9_prior_reliance", _ci("part", "(SELECT draw, unnest(['compression', 'identity', 'interaction']) AS part, unnest([bc - ba, fc - bc, (fc - fa) - (bc - ba)]) AS x FROM (SELECT draw, max(x) FILTER (model = 'base' AND condition = 'anon') AS ba, max(x) FILTER (model = 'base' AND condition = 'summ') AS bc, max(x) FILTER (model = 'base-ft' AND condition = 'anon') AS fa, max(x) FILTER (model = 'base-ft' AND condition = 'summ') AS fc FROM " + _mean("model, condition", "scored", "abs_dev") + " GROUP BY draw))"), NAMES, WEIGHTS)
def _(v):
    pick = lambda m, c, n: F.max(F.when((F.col("model") == m) & (F.col("condition") == c), F.col("x"))).alias(n)
    d = R.boot_mean(v.scored, _boot(v), ["model", "condition"], F.col("abs_dev")).groupBy("draw").agg(pick("base", "anon", "ba"), pick("base", "summ", "bc"), pick("base-ft", "anon", "fa"), pick("base-ft", "summ", "fc"))
    parts = {"compression": F.col("bc") - F.col("ba"), "identity": F.col("fc") - F.col("bc"), "interaction": (F.col("fc") - F.col("fa")) - (F.col("bc") - F.col("ba"))}
    return R.ci(d.select("draw", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), x.alias("x")) for p, x in parts.items()))).alias("y")).select("draw", "y.*"), ["part"])


@query("g13_reid_rates", "SELECT model, treatment, round(avg(hit1::INT), 6) AS top1, round(avg(hit3::INT), 6) AS top3, count(*) AS n, count(DISTINCT iso) AS n_entities, round(1 / count(DISTINCT iso), 6) AS chance FROM coded GROUP BY ALL", REID)
def _(v):
    return I.accuracy(_coded(v), ["model", "treatment"]).withColumn("chance", six(1 / F.col("n_entities")))


@query("g14_response_hits", r"SELECT model, count(*) AS n, count(*) FILTER (contains(lower(split_part(response, chr(10), 1)), lower(iso))) AS top1, count(*) FILTER (contains(lower(response), lower(iso))) AS top3 FROM last_ GROUP BY model", REID)
def _(v):
    rows = I.response_hits(I.latest(v.log).withColumn("names", I.variants("iso")), "response", "names")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.col("top1").cast("long")).alias("top1"), F.sum(F.col("top3").cast("long")).alias("top3"))


@query("g16_guesses", "SELECT iso, year, indicator, treatment, model, guess1, guess2, guess3, reason FROM coded", REID)
def _(v):
    return I.guesses(I.latest(v.log), "response").select("iso", "year", "indicator", "treatment", "model", "guess1", "guess2", "guess3", "reason")


@query("g18_accuracy_by_entity", "SELECT iso, round(avg(hit1::INT), 6) AS top1, round(avg(hit3::INT), 6) AS top3, count(*) AS n, count(DISTINCT iso) AS n_entities FROM coded GROUP BY iso HAVING count(*) >= 2", REID)
def _(v):
    return I.accuracy(_coded(v), ["iso"], 2)


@query("g19_wrong_guesses", "SELECT treatment, guess1, n, k FROM (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY n DESC, guess1) AS k FROM (SELECT treatment, guess1, count(*) AS n FROM coded WHERE NOT hit1 GROUP BY ALL)) WHERE k <= 5", REID)
def _(v):
    return I.wrong_guesses(_coded(v), ["treatment"], 5)


@query("g20_wrong_by_region", "SELECT region, count(*) AS n, round(avg((NOT hit1)::INT), 6) AS wrong, round(avg((NOT hit1 AND g.region = p.region)::INT), 6) AS wrong_in_region FROM coded JOIN places p ON p.entity = iso LEFT JOIN (SELECT entity, region AS region FROM places) g ON g.entity = guess1 GROUP BY region".replace("SELECT region,", "SELECT p.region AS region,").replace("GROUP BY region", "GROUP BY p.region"), REID)
def _(v):
    r = v.orders.select("entity", "region").distinct()
    rows = _coded(v).join(F.broadcast(r.toDF("iso", "region")), "iso").join(F.broadcast(r.toDF("guess1", "g_region")), "guess1", "left")
    return rows.groupBy("region").agg(F.count("*").alias("n"), six(F.avg((~F.col("hit1")).cast("int"))).alias("wrong"), six(F.avg((~F.col("hit1") & F.coalesce(F.col("g_region") == F.col("region"), F.lit(False))).cast("int"))).alias("wrong_in_region"))


_CUES = [("people", "official|leader"), ("events", "elect|calendar"), ("places", "border|river")]


@query("g21_cue_types", "SELECT treatment, cue, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY treatment), 6) AS share FROM (SELECT treatment, CASE WHEN regexp_matches(reason, 'official|leader') THEN 'people' WHEN regexp_matches(reason, 'elect|calendar') THEN 'events' WHEN regexp_matches(reason, 'border|river') THEN 'places' ELSE 'other' END AS cue FROM coded) GROUP BY treatment, cue", REID)
def _(v):
    from pyspark.sql import Window as W

    n = _coded(v).groupBy("treatment", I.cue_type(F.col("reason"), _CUES).alias("cue")).agg(F.count("*").alias("n"))
    return n.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy("treatment"))))


@query("g23_flip_category", "SELECT iso, CASE WHEN a = 1 AND b = 1 THEN 'both_correct' WHEN a3 = 0 AND b3 = 0 THEN 'both_wrong' WHEN a > b THEN 'anon_only' WHEN b > a THEN 'summ_only' ELSE 'tied' END AS category, round(b - a, 6) AS delta FROM flip_", REID, FLIPS)
def _(v):
    return I.flip_category(_coded(v), "anon", "summ", ["iso"]).withColumn("delta", six(F.col("delta")))


@query("g23_flip_category_by_cell", "SELECT iso, year, indicator, CASE WHEN a = 1 AND b = 1 THEN 'both_correct' WHEN a3 = 0 AND b3 = 0 THEN 'both_wrong' WHEN a > b THEN 'anon_only' WHEN b > a THEN 'summ_only' ELSE 'tied' END AS category, round(b - a, 6) AS delta FROM flip_", REID, FLIPS.replace("SELECT iso,", "SELECT iso, year, indicator,").replace("GROUP BY iso", "GROUP BY iso, year, indicator"))
def _(v):
    return I.flip_category(_coded(v), "anon", "summ", ["iso", "year", "indicator"]).withColumn("delta", six(F.col("delta")))


_SAL = "sal AS (SELECT m.entity, m.year, m.indicator, CASE WHEN s = 1 THEN 'summ' WHEN a = 1 THEN 'anon' ELSE 'none' END AS salience FROM means m LEFT JOIN (SELECT iso, year, indicator, max(hit1::INT) FILTER (treatment = 'anon') AS a, max(hit1::INT) FILTER (treatment = 'summ') AS s FROM coded GROUP BY ALL) c ON c.iso = m.entity AND c.year = m.year AND c.indicator = m.indicator)"


def _sal(v):
    return I.salience(v.means.select(*CELL), _coded(v).withColumnRenamed("iso", "entity"), CELL)


@query("g24_salience", "SELECT salience, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sal GROUP BY salience", REID, _SAL)
def _(v):
    from pyspark.sql import Window as W

    n = _sal(v).groupBy("salience").agg(F.count("*").alias("n"))
    return n.withColumn("share", six(F.col("n") / F.sum("n").over(W.partitionBy())))


@query("g25_summary", "SELECT count(*) FILTER (hit1) AS top1, count(*) FILTER (hit3) AS top3, count(*) FILTER (hit3 AND NOT hit1) AS in_3_not_1, count(*) FILTER (NOT hit3) AS none, count(*) AS n FROM coded", REID)
def _(v):
    return I.summary(_coded(v))


@query("g26_mae_by_salience", "SELECT model, salience, round(avg(abs_dev), 6) AS mae, count(*) AS n FROM scored JOIN sal USING (entity, year, indicator) GROUP BY ALL", REID, _SAL)
def _(v):
    return v.scored.join(_sal(v), CELL).groupBy("model", "salience").agg(six(F.avg("abs_dev")).alias("mae"), F.count("*").alias("n"))


@query("g28_anchoring_ci", _ci("model", _slope("model", "tr", "cue", "signed_gap")), TRACK, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_slope(_track(v), _boot(v), ["model"], F.col("cue"), F.col("signed_gap")), ["model"])


@query("g29_identifiability", "SELECT iso, c.year, round(any_value(covariate), 6) AS covariate, any_value(regime) AS regime, any_value(region) AS region, round(avg(hit1::INT), 6) AS top1 FROM coded c JOIN entity_year y ON y.entity = iso AND y.year = c.year GROUP BY iso, c.year", REID)
def _(v):
    e = v.entity_year.select(F.col("entity").alias("iso"), "year", "covariate", "regime", "region")
    return _coded(v).join(e, ["iso", "year"]).groupBy("iso", "year").agg(six(F.first("covariate")).alias("covariate"), F.first("regime").alias("regime"), F.first("region").alias("region"), six(F.avg(F.col("hit1").cast("int"))).alias("top1"))


# movement
_BETWEEN = "bt AS (SELECT entity, b - a AS sm, abs(b - a) AS m FROM (SELECT entity, max(covariate) FILTER (year = 1996) AS a, max(covariate) FILTER (year = 1999) AS b FROM entity_year GROUP BY entity))"


@query("h1_movement", "SELECT entity, round(sm, 6) AS sm, round(m, 6) AS m FROM bt", _BETWEEN)
def _(v):
    return V.between_years(v.entity_year, 1996, 1999).select("entity", six(F.col("sm")).alias("sm"), six(F.col("m")).alias("m"))


@query("h2_module_movement", "SELECT entity, indicator, round(abs(b - a), 6) AS module_move FROM (SELECT entity, indicator, max(o) FILTER (year = 1996) AS a, max(o) FILTER (year = 1999) AS b FROM (SELECT *, (sum(raw_mean / 4) OVER w - raw_mean / 4) / nullif(count(*) OVER w - 1, 0) AS o FROM means WHERE year IN (1996, 1999) WINDOW w AS (PARTITION BY entity, year, substr(indicator, 1, 7))) GROUP BY entity, indicator)")
def _(v):
    modules = v.means.select("indicator").distinct().withColumn("module", F.substring("indicator", 1, 7)).withColumn("scale", F.lit("0–4"))
    return V.module_movement(v.means, modules, 1996, 1999).withColumn("module_move", six(F.col("module_move")))


@query("h4_transforms", "SELECT entity, round(ln(1 + m), 6) AS log1p, round(r / count(m) OVER (), 6) AS pct, sign(sm) * r AS signed_rank FROM (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS r FROM (SELECT entity, round(sm, 9) AS sm, round(m, 9) AS m FROM bt))", _BETWEEN)
def _(v):
    b = V.between_years(v.entity_year, 1996, 1999).withColumn("sm", F.round("sm", 9)).withColumn("m", F.round("m", 9))
    return V.transforms(b, "sm", "m").select("entity", six(F.col("log1p")).alias("log1p"), six(F.col("pct")).alias("pct"), "signed_rank")


@query("h5_episode_flags", "SELECT entity, year, coalesce(dem_ep = 1, false) AS in_ep, coalesce(onset = 1, false) AS onset FROM entity_year")
def _(v):
    return V.episode_flags(v.entity_year).select("entity", "year", "in_ep", "onset")


# workforce
_BAND = "CASE WHEN n_coders <= 3 THEN '1-3' WHEN n_coders <= 4 THEN '4' WHEN n_coders <= 7 THEN '5-7' ELSE '8+' END"
_EDGE = "inds_ AS (SELECT indicator FROM releases GROUP BY indicator HAVING count(DISTINCT release) = 4), ents_ AS (SELECT entity FROM releases GROUP BY entity HAVING count(DISTINCT release) = 4), edge AS (SELECT release, max(year) AS edge FROM (SELECT release, year, count(*) / (count(DISTINCT entity) * (SELECT count(*) FROM inds_)) AS fill FROM releases WHERE indicator IN (FROM inds_) AND entity IN (FROM ents_) GROUP BY release, year) WHERE fill >= 0.5 GROUP BY release)"


@query("i1_era_bands", f"SELECT era, band, n, round(n / sum(n) OVER (PARTITION BY era), 6) AS share FROM (SELECT CASE WHEN year <= 1997 THEN 'early' ELSE 'late' END AS era, {_BAND} AS band, count(*) AS n FROM means GROUP BY ALL)")
def _(v):
    return K.era_bands(v.means, 1997)


@query("i2_turnover", "SELECT year, stops, pool, round(100 * stops / pool, 2) AS pct_of_pool, year = max(year) OVER () AS still_active FROM (SELECT year, count(*) AS stops, sum(count(*)) OVER ()::BIGINT AS pool FROM (SELECT coder, max(year) AS year FROM ratings WHERE year <= 1995 + " + _u("exit", "coder") + " % 7 GROUP BY coder) WHERE year >= 1996 GROUP BY year)")
def _(v):
    # coders leave after a year of their own
    return K.turnover(v.ratings.where(F.col("year") <= 1995 + u("exit", "coder") % 7), 1996)


_SHORT = "count(*) AS cells, round(avg(n_coders), 3) AS mean, round(quantile_cont(n_coders, 0.5), 3) AS median, round(avg((n_coders <= 3)::INT), 3) AS le_3, round(avg((n_coders < 5)::INT), 3) AS lt_5"


@query("i3_shortfall", f"SELECT year, {_SHORT} FROM means GROUP BY year")
def _(v):
    return K.shortfall(v.means, ["year"])


@query("i4_leading_edge", "SELECT release, edge FROM edge", _EDGE, once=('releases',))
def _(v):
    return K.leading_edge(v.releases)


@query("i5_edge_series", "SELECT r.release, o AS offset, round(avg(n_coders), 6) AS mean_nr, count(*) AS n FROM releases r JOIN edge USING (release) CROSS JOIN (VALUES (0), (1), (2)) x(o) WHERE year = edge - o GROUP BY ALL".replace("AS offset", 'AS "offset"'), _EDGE, once=('releases',))
def _(v):
    return K.edge_series(v.releases)


@query("i6_backfill", "SELECT year, release, round(m, 6) AS mean_nr, round(m - lag(m) OVER (PARTITION BY year ORDER BY release), 6) AS gain FROM (SELECT year, release, avg(n_coders) AS m FROM releases GROUP BY ALL)", once=('releases',))
def _(v):
    return K.backfill(v.releases).select("year", "release", six(F.col("mean_nr")).alias("mean_nr"), six(F.col("gain")).alias("gain"))


@query("i7_edge_shortfall", f"SELECT release, {_SHORT} FROM releases JOIN edge USING (release) WHERE year = edge GROUP BY release", _EDGE, once=('releases',))
def _(v):
    at = v.releases.join(F.broadcast(K.leading_edge(v.releases)), "release").where("year = edge")
    return K.shortfall(at, ["release"])


_FILL = "fill AS (SELECT e.release AS first, r.release - e.release AS cycle, avg(n_coders) AS mean_nr, avg((n_coders < 5)::INT) AS lt_5, count(*) AS n FROM releases r JOIN edge e ON r.year = e.edge AND r.release >= e.release GROUP BY ALL)"


@query("i8_fill_in", "SELECT first, cycle, round(mean_nr, 6) AS mean_nr, round(lt_5, 6) AS lt_5, n FROM fill", _EDGE, _FILL, once=('releases',))
def _(v):
    return K.fill_in(v.releases)


@query("i9_before_after", f"SELECT release, band, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY release), 6) AS share FROM (SELECT * FROM (VALUES (0), (3)) r(release) CROSS JOIN (VALUES ('1-3'), ('4'), ('5-7'), ('8+')) b(band)) LEFT JOIN (SELECT release, {_BAND} AS band, count(*) AS n FROM releases GROUP BY ALL) USING (release, band)")
def _(v):
    return K.before_after(v.releases, 0, 3)


@query("i10_first_and_now", "SELECT first, round(arg_min(lt_5, cycle), 6) AS at_first, round(arg_max(lt_5, cycle), 6) AS now, max(cycle) AS cycles FROM fill GROUP BY first", _EDGE, _FILL, once=('releases',))
def _(v):
    return K.first_and_now(K.fill_in(v.releases))


@query("i11_settled", "SELECT round(avg(p), 6) AS settled FROM (SELECT year, avg((n_coders < 5)::INT) AS p FROM means WHERE year <= 1998 GROUP BY year)")
def _(v):
    return v.means.where("year <= 1998").groupBy("year").agg(F.avg((F.col("n_coders") < 5).cast("int")).alias("p")).agg(six(F.avg("p")).alias("settled"))


@query("i12_entity_ranking", "SELECT entity, round(m, 6) AS mean_n, round(p, 6) AS lt_5, row_number() OVER (ORDER BY round(m, 9), entity) AS rank FROM (SELECT entity, avg(n_coders) AS m, avg((n_coders < 5)::INT) AS p FROM means GROUP BY entity)")
def _(v):
    from pyspark.sql import Window as W

    e = v.means.groupBy("entity").agg(F.avg("n_coders").alias("m"), F.avg((F.col("n_coders") < 5).cast("int")).alias("p"))
    return e.select("entity", six(F.col("m")).alias("mean_n"), six(F.col("p")).alias("lt_5"), F.row_number().over(W.partitionBy().orderBy(F.round("m", 9), "entity")).alias("rank"))


@query("i13_regime_year", "SELECT regime, year, round(avg(n_coders), 6) AS mean_n FROM means GROUP BY ALL")
def _(v):
    return v.means.groupBy("regime", "year").agg(six(F.avg("n_coders")).alias("mean_n"))


@query("i14_surveys", "SELECT substr(indicator, 1, 7) AS survey, round(avg(n_coders), 6) AS mean_n, count(DISTINCT indicator) AS indicators, min(year) AS first_year, min(year) > 1996 AS late_start FROM means GROUP BY 1")
def _(v):
    return v.means.groupBy(F.substring("indicator", 1, 7).alias("survey")).agg(six(F.avg("n_coders")).alias("mean_n"), F.count_distinct("indicator").alias("indicators"), F.min("year").alias("first_year"), (F.min("year") > 1996).alias("late_start"))


@query("i15_sd_by_size", f"SELECT {_BAND} AS band, round(quantile_cont(posterior_sd, 0.25), 6) AS q1, round(quantile_cont(posterior_sd, 0.5), 6) AS median, round(quantile_cont(posterior_sd, 0.75), 6) AS q3, count(*) AS n, round(1.253 * stddev_samp(posterior_sd) / sqrt(count(*)), 6) AS se_median FROM releases WHERE posterior_sd IS NOT NULL GROUP BY 1")
def _(v):
    return K.sd_by_size(v.releases)


@query("i16_yearly_sizes", "SELECT year, round(avg(n_coders), 6) AS mean_n, round(quantile_cont(n_coders, 0.5), 6) AS median_n, round(avg(posterior_sd), 6) AS mean_sd FROM releases WHERE release = 3 GROUP BY year")
def _(v):
    return v.releases.where("release = 3").groupBy("year").agg(six(F.avg("n_coders")).alias("mean_n"), six(F.percentile("n_coders", 0.5)).alias("median_n"), six(F.avg("posterior_sd")).alias("mean_sd"))


@query("i17_mean_increment", "SELECT release, round(avg(gain), 3) AS mean_increment, count(*) AS years FROM (SELECT year, release, m - lag(m) OVER (PARTITION BY year ORDER BY release) AS gain FROM (SELECT year, release, avg(n_coders) AS m FROM releases GROUP BY ALL)) WHERE year BETWEEN 1995 AND 1998 AND gain IS NOT NULL GROUP BY release")
def _(v):
    return K.mean_increment(K.backfill(v.releases), 1995, 1998)


@query("i18_reach", "SELECT min(release) AS first_release, max(release) AS last_release, arg_min(edge, release) AS first_edge, arg_max(edge, release) AS last_edge, min(edge) AS min_edge, max(edge) AS max_edge FROM edge", _EDGE, once=('releases',))
def _(v):
    return K.reach(v.releases)


# texts and samples
@query("j13_training_records", "SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id", raw=True)
def _(v):
    c = v.table("conversations").where("text IS NOT NULL AND text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return c.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m.text)).alias("chars"), F.array_join(F.transform("messages", lambda m: m.role), ">").alias("roles"))


@query("j15_lengths", "SELECT source, n, a[least(floor(n * 0.5), n - 1)::INT + 1] AS p50, a[least(floor(n * 0.75), n - 1)::INT + 1] AS p75, a[least(floor(n * 0.9), n - 1)::INT + 1] AS p90, a[least(floor(n * 0.95), n - 1)::INT + 1] AS p95, a[least(floor(n * 0.99), n - 1)::INT + 1] AS p99, a[n] AS max, over_500, over_2000 FROM (SELECT source, list_sort(list(length(text) // 4)) AS a, count(*) AS n, count(*) FILTER (length(text) // 4 > 500) AS over_500, count(*) FILTER (length(text) // 4 > 2000) AS over_2000 FROM documents GROUP BY source)", raw=True)
def _(v):
    return X.lengths(v.table("documents"), "text", ["source"], [500, 2000])


@query("j15_over_limit", "SELECT doc_id, length(text) // 4 AS tokens, length(text) // 4 - 1000 AS over_by FROM documents WHERE length(text) // 4 > 1000", raw=True)
def _(v):
    return X.over_limit(v.table("documents"), ["doc_id"], "text", 1000)


def _with_documents(v):
    names = v.table("nation").select("n_nationkey", F.col("n_name").alias("entity"))
    shelf = v.shelf.select("source", (F.col("doc_id") % 25).alias("n_nationkey"), (1995 + F.col("doc_id") % 7).cast("int").alias("year")).join(names, "n_nationkey")
    plan = v.plan.where("indicator = 'belief_more'").drop("indicator").crossJoin(v.means.select("indicator").distinct())
    return E.available(shelf.select("source", "entity", "year"), plan, v.means.select("indicator").distinct(), ["entity", "year"])


_SHOTS = """av AS (SELECT n_name AS entity, year FROM (SELECT s, doc_id % 25 AS n_nationkey, (1995 + doc_id % 7)::INT AS year FROM documents CROSS JOIN (VALUES ('first'), ('second'), ('third')) s(s) WHERE text IS NOT NULL AND (s = 'first' OR (s = 'second' AND doc_id % 4 <> 1) OR (s = 'third' AND doc_id % 3 = 0))) JOIN nation USING (n_nationkey) GROUP BY ALL HAVING count(DISTINCT s) = 3),
cand AS (SELECT indicator, level, region, entity, arg_min(year, (dist, year)) AS year, min(dist) AS dist FROM (SELECT m.*, region, round_even(raw_mean, 0)::INT AS level, round(abs(raw_mean - round_even(raw_mean, 0)), 9) AS dist FROM means m SEMI JOIN av USING (entity, year) JOIN (SELECT DISTINCT entity, region FROM orders_) USING (entity)) WHERE level BETWEEN 0 AND 4 GROUP BY ALL),
pick AS (SELECT indicator, -1 AS level, []::VARCHAR[] AS ue, []::VARCHAR[] AS ur, NULL::STRUCT(o INT, dist DOUBLE, entity VARCHAR, year INT, region VARCHAR) AS c FROM (SELECT DISTINCT indicator FROM cand)
UNION ALL SELECT indicator, level, CASE WHEN c IS NULL THEN ue ELSE list_append(ue, c.entity) END, CASE WHEN c IS NULL THEN ur ELSE list_append(ur, c.region) END, c FROM (
  SELECT p.indicator, p.level + 1 AS level, ue, ur, min({'o': CASE WHEN list_contains(ue, entity) THEN 2 WHEN list_contains(ur, region::VARCHAR) THEN 1 ELSE 0 END, 'dist': dist, 'entity': entity, 'year': year, 'region': region::VARCHAR}) FILTER (entity IS NOT NULL) AS c
  FROM pick p LEFT JOIN cand b ON b.indicator = p.indicator AND b.level = p.level + 1 WHERE p.level < 4 GROUP BY ALL))"""


@query("j16_few_shot", "SELECT indicator, level, c.entity AS entity, c.year AS year FROM pick WHERE c IS NOT NULL", _SHOTS)
def _(v):
    # a cell has its documents if the reports of its entity and year have
    return X.few_shot(v.means, v.orders.select("entity", "region").distinct(), _with_documents(v))


@query("j18_level_coverage", "SELECT indicator, level FROM (SELECT DISTINCT indicator FROM means) CROSS JOIN range(5) l(level) WHERE (indicator, level) NOT IN (SELECT indicator, round_even(raw_mean, 0)::BIGINT FROM means)")
def _(v):
    grid = v.means.select("indicator").distinct().withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    have = v.means.select("indicator", half_even(F.col("raw_mean")).cast("long").alias("level")).distinct()
    return grid.join(have, ["indicator", "level"], "left_anti")


_KEYS = ["entity", "year", "indicator", "coder"]


def _pool(v):
    h = u("pool", *_KEYS)
    return X.intersection([v.ratings.where(h % 10 != k) for k in (1, 2, 3)], _KEYS, ["rating"])


_POOL = f"pool AS (SELECT * FROM ratings WHERE {_u('pool', *_KEYS)} % 10 NOT IN (1, 2, 3))"
_BUDGET = "bud AS (SELECT indicator, n, least(n, base + (row_number() OVER (ORDER BY round(exact - base, 9) DESC, indicator) <= 500 - sum(base) OVER ())::INT)::BIGINT AS budget FROM (SELECT *, floor(exact)::BIGINT AS base FROM (SELECT indicator, count(*) AS n, 500.0::DOUBLE * count(*) / sum(count(*)) OVER () AS exact FROM pool GROUP BY indicator)))"
_SAMPLE = f"samp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY (k > 2)::INT, h, entity, year, coder) AS r FROM (SELECT *, row_number() OVER (PARTITION BY indicator, rating ORDER BY h, entity, year, coder) AS k FROM (SELECT *, {_u('sample', *_KEYS)} AS h FROM pool))) JOIN bud USING (indicator) WHERE r <= budget)"


@query("j20_intersection", "SELECT entity, year, indicator, coder, rating FROM pool", _POOL, once=('ratings',))
def _(v):
    return _pool(v)


@query("j21_budgets", "SELECT indicator, n, budget FROM bud", _POOL, _BUDGET)
def _(v):
    return X.budgets(_pool(v), "indicator", 500)


def _sample(v):
    p = _pool(v)
    return X.stratified(p, X.budgets(p, "indicator", 500), "indicator", "rating", ["entity", "year", "indicator", "coder"], 2)


@query("j22_stratified_sample", "SELECT entity, year, indicator, coder, rating FROM samp", _POOL, _BUDGET, _SAMPLE, once=('ratings',))
def _(v):
    return _sample(v).select(*_KEYS, "rating")


@query("j25_coverage", "SELECT indicator, round(avg(rating), 6) AS mean_rating, count(DISTINCT rating) AS levels, count(DISTINCT entity) AS entities, count(*) AS n FROM samp GROUP BY indicator", _POOL, _BUDGET, _SAMPLE, once=('ratings',))
def _(v):
    return _sample(v).groupBy("indicator").agg(six(F.avg("rating")).alias("mean_rating"), F.count_distinct("rating").alias("levels"), F.count_distinct("entity").alias("entities"), F.count("*").alias("n"))


@query("j26_group_split", f"SELECT split, count(*) AS n, count(DISTINCT (entity, year, indicator)) AS cells FROM ratings JOIN (SELECT entity, year, indicator, CASE WHEN k > greatest(1, round_even(0.1 * g, 0)) THEN 'train' WHEN before < 3000 THEN 'validation' ELSE 'unused' END AS split FROM (SELECT *, row_number() OVER w AS k, count(*) OVER () AS g, coalesce(sum(n) OVER (ORDER BY h, entity, year, indicator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT entity, year, indicator, count(*) AS n, any_value({_u('split', *CELL)}) AS h FROM ratings GROUP BY entity, year, indicator) WINDOW w AS (ORDER BY h, entity, year, indicator))) USING (entity, year, indicator) GROUP BY split")
def _(v):
    s = X.group_split(v.ratings, CELL, 0.1, 3000)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(*CELL).alias("cells"))


@query("j28_hygiene", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 > 0) AS not_bare, count(*) FILTER (event_id % 3 = 1) AS unparseable FROM events GROUP BY event_type", raw=True)
def _(v):
    text = F.when(F.col("event_id") % 3 == 0, F.lit(" 4 ")).when(F.col("event_id") % 3 == 1, F.lit("none")).otherwise(F.lit("about 4"))
    return X.hygiene(v.table("events").withColumn("t", text), "t", ["event_type"])


@query("j30_random_cells", f"SELECT entity, year, indicator FROM means ORDER BY {_u('cells', *CELL)}, entity, year, indicator LIMIT 50")
def _(v):
    return X.random_rows(v.means.select(*CELL), 50, CELL, "cells")
