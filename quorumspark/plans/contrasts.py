"""Paired contrasts, moderators and distances of machine raters over the derived tables."""

from pyspark.sql import functions as F

from quorumspark.functions.core import six, u
from quorumspark.operators import identity as I
from quorumspark.operators import metrics as M
from quorumspark.operators import movement as V
from quorumspark.operators import panel as P
from quorumspark.operators import regress as G
from quorumspark.operators import resample as R
from quorumspark.plans.inference import _GAIN, _MOVE, H, NAMES, WEIGHTS, _boot, _ci, _h, _mean, _move, _slope, _w1, _W1D
from quorumspark.plans.leakage import _SAL, FLIPS, REID, TRACK, _coded, _sal, _track
from quorumspark.plans.panels import LOO
from quorumspark.plans.registry import query
from quorumspark.sources.views import _u

CELL, MC = P.CELL, M.MC
_HITS = "hits_ AS (SELECT *, iso AS entity FROM coded)"


def _hits(v):
    return _coded(v).withColumn("entity", F.col("iso"))


# D15-D17: salience, rates, treatments
_SALGAIN = "sgain_ AS (SELECT g.*, salience <> 'none' AS salient FROM gain g JOIN sal USING (entity, year, indicator))"


@query("d15_salience_did", _ci("model", "(SELECT draw, model, max(CASE WHEN NOT salient THEN x END) - max(CASE WHEN salient THEN x END) AS x FROM " + _mean("model, salient", "sgain_", "(-g)") + " GROUP BY ALL)"), REID, _SAL, _GAIN, _SALGAIN, NAMES, WEIGHTS)
def _(v):
    wide = M.wide_by_condition(v.scored, ["codebook", "correct"]).withColumn("g", F.col("correct") - F.col("codebook"))
    rows = wide.join(_sal(v).withColumn("plain", F.col("salience") == "none"), CELL)
    return R.ci(R.difference(R.boot_mean(rows, _boot(v), ["model", "plain"], F.col("g")), ["model"], "plain"), ["model"])


@query("d16_hit_rates", _ci("model, treatment, metric", _mean("model, treatment, metric", "(SELECT entity, model, treatment, unnest(['top1', 'top3']) AS metric, unnest([hit1::INT, hit3::INT]) AS hit FROM hits_)", "hit")), REID, _HITS, NAMES, WEIGHTS)
def _(v):
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("int").alias("hit")) for m, c in (("top1", "hit1"), ("top3", "hit3"))))).alias("x")
    return R.ci(R.boot_mean(_hits(v).select("entity", "model", "treatment", each).select("*", "x.*"), _boot(v), ["model", "treatment", "metric"], F.col("hit")), ["model", "treatment", "metric"])


@query("d17_treatment_contrast", _ci("contrast, grp", "pd_"), REID, _HITS, NAMES, WEIGHTS, f"""pairs_ AS (SELECT 'summ - anon' AS contrast, model AS grp, entity, max(hit1::INT) FILTER (treatment = 'summ') - max(hit1::INT) FILTER (treatment = 'anon') AS d FROM hits_ GROUP BY model, entity, year, indicator
UNION ALL SELECT 'base - base-ft', treatment, entity, max(hit1::INT) FILTER (model = 'base') - max(hit1::INT) FILTER (model = 'base-ft') FROM hits_ GROUP BY treatment, entity, year, indicator),
pd_ AS {_mean('contrast, grp', 'pairs_', 'd')}""")
def _(v):
    hits = _hits(v).withColumn("hit", F.col("hit1").cast("int"))
    one = R.paired_rows(hits, ["model", *CELL], "treatment", "summ", "anon", "hit").select(F.lit("summ - anon").alias("contrast"), F.col("model").alias("grp"), "entity", "d")
    two = R.paired_rows(hits, ["treatment", *CELL], "model", "base", "base-ft", "hit").select(F.lit("base - base-ft").alias("contrast"), F.col("treatment").alias("grp"), "entity", "d")
    return R.ci(R.boot_mean(one.union(two), _boot(v), ["contrast", "grp"], F.col("d")), ["contrast", "grp"])


@query("d19_two_sided_p", "SELECT model, condition, p_two FROM (" + _ci("model, condition", _mean("model, condition", "scored", "signed_dev")) + ")", NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_mean(v.scored, _boot(v), MC, F.col("signed_dev")), MC).select(*MC, "p_two")


# D22: subgroups of transitions, which overlap
SUBGROUPS = {"stable": "NOT (dem OR aut)", "in_ep": "dem OR aut", "in_dem": "dem", "in_aut": "aut", "onset": "on_dem OR on_aut", "on_dem": "on_dem", "on_aut": "on_aut"}
CELLS = ["base|codebook", "base|correct", "base-ft|correct", "other|correct"]
_EP = f"ep_ AS (SELECT entity, year, coalesce(dem_ep = 1, false) AS dem, a % 6 = 0 AS aut, coalesce(dem_ep = 1, false) AND onset = 1 AS on_dem, a % 6 = 0 AND a // 6 % 2 = 0 AS on_aut FROM (SELECT *, {_u('aut', 'entity', 'year')} AS a FROM entity_year)), subs_ AS (" + " UNION ALL ".join(f"SELECT entity, year, '{s}' AS sub FROM ep_ WHERE {c}" for s, c in SUBGROUPS.items()) + ")"
_AI = "ai7_ AS (SELECT entity, year, model || '|' || condition AS cell, greatest(1, least(400, round_even(abs_dev / 0.01, 0)))::INT AS b, signed_dev AS s FROM scored WHERE model || '|' || condition IN (" + ", ".join(f"'{c}'" for c in CELLS) + ") AND n_coders >= 2)"
_HORSE = """he7_ AS (SELECT entity, sub, cell, b, sum(f)::DOUBLE AS f, sum(g)::DOUBLE AS g FROM (SELECT entity, sub, cell, b, 1 AS f, 0 AS g FROM ai7_ JOIN subs_ USING (entity, year) UNION ALL SELECT entity, sub, cell, greatest(1, least(400, round_even(e / 0.01, 0)))::INT, 0, 1 FROM loo JOIN subs_ USING (entity, year) CROSS JOIN (SELECT DISTINCT cell FROM ai7_)) GROUP BY ALL),
hd7_ AS (SELECT draw, sub, cell, b, sum(w * f) AS f, sum(w * g) AS g FROM he7_ JOIN w_ USING (entity) GROUP BY ALL),
w7_ AS (SELECT draw, sub, cell, sum(d) AS x FROM (SELECT draw, sub, cell, abs(sum(f) OVER w / nullif(sum(f) OVER z, 0) - sum(g) OVER w / nullif(sum(g) OVER z, 0)) * coalesce(lead(b) OVER w - b, 0) * 0.01 AS d FROM hd7_ WINDOW w AS (PARTITION BY draw, sub, cell ORDER BY b), z AS (PARTITION BY draw, sub, cell)) GROUP BY ALL)"""


def _subgroups(v):
    a = u("aut", "entity", "year")
    dem = F.coalesce(F.col("dem_ep") == 1, F.lit(False))
    ep = v.entity_year.select("entity", "year", dem.alias("dem"), (a % 6 == 0).alias("aut"), (dem & (F.col("onset") == 1)).alias("on_dem"), ((a % 6 == 0) & (F.floor(a / 6) % 2 == 0)).alias("on_aut"))
    return ep.select("entity", "year", F.explode(F.array_compact(F.array(*(F.when(F.expr(c), s) for s, c in SUBGROUPS.items())))).alias("sub"))


def _raced(v):
    cell = F.concat_ws("|", *MC)
    return v.scored.withColumn("cell", cell).where(F.col("cell").isin(*CELLS) & (F.col("n_coders") >= 2)).join(_subgroups(v), ["entity", "year"])


@query("d22_horse_race_w1", _ci("sub, cell", "w7_"), LOO, NAMES, WEIGHTS, _EP, _AI, _HORSE)
def _(v):
    bins = lambda rows, c: rows.withColumn("b", F.greatest(F.lit(1), F.least(F.lit(400), F.rint(F.col(c) / 0.01).cast("int"))))
    ai = R.sums(bins(_raced(v), "abs_dev"), ["sub", "cell", "b"], n=F.lit(1))
    human = R.sums(bins(P.human_loo(v.ratings).join(_subgroups(v), ["entity", "year"]), "e"), ["sub", "b"], n=F.lit(1))
    return R.ci(R.boot_wasserstein(ai, human, _boot(v), ["sub", "cell"], 0.01, ["sub"]), ["sub", "cell"])


@query("d22_horse_race_shift", _ci("sub, cell", _mean("sub, cell", "(SELECT * FROM ai7_ JOIN subs_ USING (entity, year) WHERE sub NOT IN ('in_ep', 'onset'))", "s")), NAMES, WEIGHTS, _EP, _AI)
def _(v):
    return R.ci(R.boot_mean(_raced(v).where("sub NOT IN ('in_ep', 'onset')"), _boot(v), ["sub", "cell"], F.col("signed_dev")), ["sub", "cell"])


# D25: deltas of several measures between two cells
_MEASURES = f"""measures_ AS (SELECT 'w1' AS metric, draw, model, x FROM w1d UNION ALL SELECT 'slope', draw, model, x FROM {_slope('model', "(SELECT * FROM scored JOIN mae USING (entity, year, indicator) WHERE condition = 'correct')", 'abs_dev', 'h')}
UNION ALL SELECT 'gap', draw, model, max(CASE WHEN quintile = 5 THEN x END) - max(CASE WHEN quintile = 1 THEN x END) FROM {_mean('model, quintile', "(SELECT * FROM scored WHERE condition = 'correct')", 'signed_dev')} GROUP BY ALL
UNION ALL SELECT 'attitude', draw, model, x FROM {_mean('model', "(SELECT s.*, s.rating - o.ord AS d FROM scored s JOIN ord_ o USING (entity, year, indicator) WHERE condition = 'correct')", 'd')}),
deltas_ AS (SELECT a.metric, a.model || ' - ' || b.model AS contrast, a.draw, round(a.x - b.x, 9) AS x FROM measures_ a JOIN measures_ b ON a.metric = b.metric AND a.draw = b.draw AND (a.model, b.model) IN (('base-ft', 'base'), ('base-ft', 'other')))"""


@query("d25_paired_deltas", "SELECT *, lo > 0 OR hi < 0 AS excludes_0 FROM (" + _ci("metric, contrast", "deltas_") + ")", LOO, H, NAMES, WEIGHTS, _W1D, _MEASURES)
def _(v):
    own, w = v.scored.where("condition = 'correct'"), _boot(v)
    slope = R.boot_slope(_h(v).where("condition = 'correct'"), w, ["model"], F.col("abs_dev"), F.col("h")).select("draw", "model", "x")
    gap = R.difference(R.boot_mean(own.where("quintile IN (1, 5)"), w, ["model", "quintile"], F.col("signed_dev")).withColumn("top", F.col("quintile") == 5), ["model"], "top").select("draw", "model", "x")
    attitude = R.boot_mean(own.join(v.ord, CELL).withColumn("d", F.col("rating") - F.col("ord")), w, ["model"], F.col("d")).select("draw", "model", "x")
    every = None
    for name, d in (("w1", _w1(v).select("draw", "model", "x")), ("slope", slope), ("gap", gap), ("attitude", attitude)):
        d = d.withColumn("metric", F.lit(name))
        every = d if every is None else every.union(d)
    out = R.contrasts(every, ["metric"], "model", {"base-ft - base": {"base-ft": 1, "base": -1}, "base-ft - other": {"base-ft": 1, "other": -1}})
    return R.ci(out, ["metric", "contrast"]).withColumn("excludes_0", (F.col("lo") > 0) | (F.col("hi") < 0))


# E2, E3, E6: outcomes on a moderator
_RANKS = "ranks_ AS (SELECT entity, year, r / count(*) OVER (PARTITION BY year) AS pct, sign(sm) * r AS signed_rank FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY m) + (count(*) OVER (PARTITION BY year, m) - 1) / 2 AS r FROM (SELECT entity, year, round(sm, 9) AS sm, round(m, 9) AS m FROM move)))"
_BASE_HITS = "reid_ AS (SELECT iso AS entity, year, indicator, hit1::INT AS reid FROM coded WHERE model = 'base' AND treatment = 'anon')"


def _ranks(v):
    m = _move(v).withColumns({"m": F.round("m", 9), "sm": F.round("sm", 9)})
    r = V.mid_rank(m, "m", ["year"], "r")
    from pyspark.sql import Window as W

    return r.select("entity", "year", (F.col("r") / F.count("m").over(W.partitionBy("year"))).alias("pct"), (F.signum("sm") * F.col("r")).alias("signed_rank"))


def _reid(v):
    return _coded(v).where("model = 'base' AND treatment = 'anon'").select(F.col("iso").alias("entity"), "year", "indicator", F.col("hit1").cast("int").alias("reid"))


def _moderated(v, rows, by, y):
    one = R.boot_slope(rows.join(_ranks(v), ["entity", "year"]), _boot(v), by, y, F.col("pct")).withColumn("moderator", F.lit("movement"))
    two = R.boot_slope(rows.join(_reid(v), CELL), _boot(v), by, y, F.col("reid")).withColumn("moderator", F.lit("reid"))
    return R.ci(one.unionByName(two), ["moderator", *by])


def _moderated_sql(by, src, y):
    keys = f"moderator, {by}"
    both = f"SELECT 'movement' AS moderator, * FROM {_slope(by, f'(SELECT * FROM {src} JOIN ranks_ USING (entity, year))', y, 'pct')} UNION ALL SELECT 'reid', * FROM {_slope(by, f'(SELECT * FROM {src} JOIN reid_ USING (entity, year, indicator))', y, 'reid')}"
    return _ci(keys, f"({both})")


@query("e2_mae_on_moderator", _moderated_sql("model, condition", "scored", "abs_dev"), REID, _MOVE, _RANKS, _BASE_HITS, NAMES, WEIGHTS)
def _(v):
    return _moderated(v, v.scored, MC, F.col("abs_dev"))


@query("e3_bias_on_signed_movement", _ci("model, condition", _slope("model, condition", "(SELECT * FROM scored JOIN ranks_ USING (entity, year))", "signed_dev", "signed_rank")), _MOVE, _RANKS, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_slope(v.scored.join(_ranks(v), ["entity", "year"]), _boot(v), MC, F.col("signed_dev"), F.col("signed_rank")), MC)


@query("e6_tracking_on_moderator", _moderated_sql("model", "tr", "track"), REID, TRACK, _MOVE, _RANKS, _BASE_HITS, NAMES, WEIGHTS)
def _(v):
    return _moderated(v, _track(v), ["model"], F.col("track"))


@query("e7_slope_without_null_pairs", _ci("model", _slope("model", "(SELECT entity, model, CASE WHEN " + _u("gap", *CELL) + " % 5 > 0 THEN abs_dev END AS y, CASE WHEN " + _u("gap", *CELL) + " % 7 > 0 THEN n_coders END AS n FROM scored)", "y", "n")), NAMES, WEIGHTS)
def _(v):
    gap = u("gap", *CELL)
    return R.ci(R.boot_slope(v.scored, _boot(v), ["model"], F.when(gap % 5 > 0, F.col("abs_dev")), F.when(gap % 7 > 0, F.col("n_coders"))), ["model"])


# G10-G12: arms of one pool, three outcomes
ARMS = {"evidence": "codebook", "anon": "anon", "summ": "summ", "summid": "correct"}
_ARMS = "four_ AS (SELECT entity, year, indicator, model, CASE condition WHEN 'codebook' THEN 'evidence' WHEN 'correct' THEN 'summid' ELSE condition END AS arm, h, abs_dev AS a, signed_dev AS s FROM scored JOIN mae USING (entity, year, indicator)), named_ AS (SELECT w.source AS entity, w.year, w.indicator, w.model, 'corr' AS arm, h, abs(w.rating - raw_mean) AS a, w.rating - raw_mean AS s FROM swaps w JOIN means m ON m.entity = w.source AND m.year = w.year AND m.indicator = w.indicator JOIN mae x ON x.entity = w.source AND x.year = w.year AND x.indicator = w.indicator WHERE arm = 'correct')"
IDENTITY = {"compression": {"summid": 1, "evidence": -1}, "full_text": {"anon": 1, "evidence": -1}, "compressed": {"summ": 1, "summid": -1}, "full_text - compressed": {"anon": 1, "evidence": -1, "summ": -1, "summid": 1}}
SUMMARIES = {"anon": {"anon": 1, "evidence": -1}, "A": {"summid": 1, "evidence": -1}, "C": {"corr": 1, "evidence": -1}, "D": {"summ": 1, "evidence": -1}, "D-A": {"summ": 1, "summid": -1}, "C-D": {"corr": 1, "summ": -1}, "A-C": {"summid": 1, "corr": -1}, "D-anon": {"summ": 1, "anon": -1}}


def _arms_sql(name, src, n, by="model"):
    """Draws of each arm's three outcomes over the cells that all n arms have."""
    return f"{name}0 AS (SELECT entity, {by}, arm, count(*) AS n, sum(a) AS sa, sum(s) AS ss, sum(h) AS sh, sum(h * a) AS sha, sum(h * h) AS shh FROM (SELECT *, count(*) OVER (PARTITION BY {by}, entity, year, indicator) AS k FROM {src}) WHERE k = {n} GROUP BY ALL), {name}1 AS (SELECT draw, {by}, arm, sum(w * n) AS n, sum(w * sa) AS sa, sum(w * ss) AS ss, sum(w * sh) AS sh, sum(w * sha) AS sha, sum(w * shh) AS shh FROM {name}0 JOIN w_ USING (entity) GROUP BY ALL), {name} AS (SELECT draw, {by}, arm, unnest(['mae', 'signed', 'slope']) AS outcome, unnest([sa / n, ss / n, (sha - sh * sa / n) / nullif(shh - sh * sh / n, 0)]) AS x FROM {name}1)"


def _contrast_sql(name, spec, by):
    return "(" + " UNION ALL ".join(f"SELECT '{c}' AS contrast, draw, {by}, round(" + " + ".join(f"({w}) * max(x) FILTER (arm = '{a}')" for a, w in arms.items()) + f", 9) AS x FROM {name} GROUP BY draw, {by}" for c, arms in spec.items()) + ")"


def _four(v):
    arm = F.element_at(F.create_map(*(F.lit(x) for a, c in ARMS.items() for x in (c, a))), F.col("condition"))
    return _h(v).select(*CELL, "model", arm.alias("arm"), "h", F.col("abs_dev").alias("a"), F.col("signed_dev").alias("s"))


def _named(v):
    rows = v.swaps.where("arm = 'correct'").select(F.col("source").alias("entity"), "year", "indicator", "model", "rating").join(v.means.select(*CELL, "raw_mean"), CELL).join(P.human_mae(v.ratings).select(*CELL, "h"), CELL)
    d = F.col("rating") - F.col("raw_mean")
    return rows.select(*CELL, "model", F.lit("corr").alias("arm"), "h", F.abs(d).alias("a"), d.alias("s"))


@query("g10_identity_effect", _ci("contrast, model, outcome", _contrast_sql("arm_", IDENTITY, "model, outcome")), LOO, H, _ARMS, NAMES, WEIGHTS, _arms_sql("arm_", "four_", 4))
def _(v):
    d = R.arm_outcomes(R.in_all_arms(_four(v), ["model", *CELL], "arm", 4), _boot(v), ["model"])
    return R.ci(R.contrasts(d, ["model", "outcome"], "arm", IDENTITY), ["contrast", "model", "outcome"])


@query("g11_summary_arms", _ci("contrast, model, outcome", _contrast_sql("arm_", SUMMARIES, "model, outcome")), LOO, H, _ARMS, NAMES, WEIGHTS, "five_ AS (SELECT * FROM four_ UNION ALL SELECT * FROM named_)", _arms_sql("arm_", "five_", 5))
def _(v):
    d = R.arm_outcomes(R.in_all_arms(_four(v).union(_named(v)), ["model", *CELL], "arm", 5), _boot(v), ["model"])
    return R.ci(R.contrasts(d, ["model", "outcome"], "arm", SUMMARIES), ["contrast", "model", "outcome"])


_SPLIT = f"""frame_ AS (SELECT x.*, hit1 FROM (SELECT * FROM named_ UNION ALL SELECT * FROM four_ WHERE arm = 'summ') x JOIN coded c ON c.iso = x.entity AND c.year = x.year AND c.indicator = x.indicator AND c.model = x.model AND c.treatment = 'summ'),
strata_ AS (SELECT *, 'overall' AS stratum FROM frame_ UNION ALL SELECT *, CASE WHEN hit1 THEN 'identified' ELSE 'not' END FROM frame_),
{_arms_sql('arm_', 'strata_', 2, 'model, stratum')},
fr_ AS (SELECT draw, model, stratum, outcome, round(max(x) FILTER (arm = 'corr') - max(x) FILTER (arm = 'summ'), 9) AS x FROM arm_ GROUP BY ALL),
fr2_ AS (SELECT * FROM fr_ UNION ALL SELECT draw, model, 'difference', outcome, round(max(x) FILTER (stratum = 'identified') - max(x) FILTER (stratum = 'not'), 9) FROM fr_ GROUP BY ALL)"""


@query("g12_identified_split", _ci("model, stratum, outcome", "fr2_"), REID, LOO, H, _ARMS, NAMES, WEIGHTS, _SPLIT)
def _(v):
    reid = _coded(v).where("treatment = 'summ'").select(F.col("iso").alias("entity"), "year", "indicator", "model", "hit1")
    rows = _named(v).union(_four(v).where("arm = 'summ'")).join(reid, [*CELL, "model"])
    strata = F.explode(F.array(F.lit("overall"), F.when(F.col("hit1"), "identified").otherwise("not"))).alias("stratum")
    d = R.arm_outcomes(R.in_all_arms(rows.select("*", strata), ["model", "stratum", *CELL], "arm", 2), _boot(v), ["model", "stratum"])
    d = R.contrasts(d, ["model", "stratum", "outcome"], "arm", {"framing": {"corr": 1, "summ": -1}}).drop("contrast")
    split = R.contrasts(d.where("stratum <> 'overall'"), ["model", "outcome"], "stratum", {"difference": {"identified": 1, "not": -1}}).withColumnRenamed("contrast", "stratum")
    return R.ci(d.unionByName(split), ["model", "stratum", "outcome"])


# G15, G17, G22, G27, H3
@query("g15_name_variants", "SELECT n_name, list_sort(list_distinct([lower(n_name), trim(split_part(lower(n_name), ',', 1))] || CASE WHEN n_nationkey % 3 = 0 THEN [lower('Old ' || n_name), 'land ' || n_nationkey] ELSE [] END)) AS variants FROM (SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 4 = 0 THEN ', Republic of' ELSE '' END AS n_name FROM nation)", raw=True)
def _(v):
    k = F.col("n_nationkey")
    rows = v.table("nation").select(k, F.concat("n_name", F.when(k % 4 == 0, ", Republic of").otherwise("")).alias("n_name"))
    rows = rows.withColumn("aliases", F.when(k % 3 == 0, F.array(F.concat(F.lit("Old "), "n_name"), F.concat(F.lit("land "), k.cast("string")))))
    return rows.select("n_name", F.sort_array(I.variants("n_name", "aliases")).alias("variants"))


@query("g17_coded_guesses", "SELECT iso, year, indicator, treatment, model, a.entity AS code1, b.entity AS code2, c.entity AS code3, coalesce(a.entity = iso, false) AS hit1, coalesce(a.entity = iso, false) OR coalesce(b.entity = iso, false) OR coalesce(c.entity = iso, false) AS hit3 FROM coded LEFT JOIN places a ON a.entity = guess1 LEFT JOIN places b ON b.entity = guess2 LEFT JOIN places c ON c.entity = guess3", REID)
def _(v):
    return _coded(v).select("iso", "year", "indicator", "treatment", "model", "code1", "code2", "code3", "hit1", "hit3")


@query("g22_region_rates", "SELECT treatment, count(*) AS n, round(avg(hit1::INT), 6) AS exact, round(avg(in1::INT), 6) AS top1_in_region, round(avg((in1 OR in2 OR in3)::INT), 6) AS top3_in_region, count(*) FILTER (NOT hit1) AS n_wrong, round(avg(in1::INT) FILTER (NOT hit1), 6) AS wrong_in_region FROM (SELECT c.*, coalesce(a.region = o.region, false) AS in1, coalesce(b.region = o.region, false) AS in2, coalesce(d.region = o.region, false) AS in3 FROM coded c JOIN places o ON o.entity = iso LEFT JOIN places a ON a.entity = guess1 LEFT JOIN places b ON b.entity = guess2 LEFT JOIN places d ON d.entity = guess3) GROUP BY treatment", REID)
def _(v):
    return I.region_rates(_coded(v), v.orders.select("entity", "region").distinct(), ["treatment"])


@query("g27_reasons_side_by_side", "SELECT iso, year, indicator, model, treatment, reason, CASE WHEN treatment = 'anon' THEN NULL ELSE guess1 END AS wrong_guess FROM coded WHERE iso IN (SELECT iso FROM flip_ WHERE NOT (a = 1 AND b = 1) AND NOT (a3 = 0 AND b3 = 0) AND a > b) AND ((treatment = 'anon' AND hit1) OR (treatment = 'summ' AND NOT hit1))", REID, FLIPS)
def _(v):
    return I.side_by_side(_coded(v), "anon", "summ").select("iso", "year", "indicator", "model", "treatment", "reason", "wrong_guess")


@query("h3_scale_bounds", "SELECT indicator, trim(split_part(s, '–', 1))::DOUBLE AS low, trim(split_part(s, '–', 2))::DOUBLE AS high FROM (SELECT indicator, '0 – ' || max(rating) AS s FROM ratings GROUP BY indicator)")
def _(v):
    rows = v.ratings.groupBy("indicator").agg(F.concat(F.lit("0 – "), F.max("rating").cast("string")).alias("s"))
    low, high = V.scale_bounds(F.col("s"))
    return rows.select("indicator", low.alias("low"), high.alias("high"))
