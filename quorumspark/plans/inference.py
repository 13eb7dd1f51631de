"""Bootstrap, contrasts, regressions and seat swaps over the derived tables."""

from pyspark.sql import functions as F

from quorumspark.functions.core import half_even, half_up, six
from quorumspark.operators import metrics as M
from quorumspark.operators import panel as P
from quorumspark.operators import regress as G
from quorumspark.operators import resample as R
from quorumspark.operators import seats as S
from quorumspark.plans.errors import BEFORE
from quorumspark.plans.panels import LOO
from quorumspark.plans.registry import query
from quorumspark.sources.views import _u

CELL, MC = P.CELL, M.MC
#: Draws of the cluster bootstrap, of the seat swaps and of the replacement experiment.
B, SEATS, REPLACED = 2000, 30, 500
NAMES = "names_ AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM means))"
WEIGHTS = f"""w_ AS (SELECT draw, entity, count(*) AS w FROM (SELECT d.draw, {_u('boot', 'd.draw', 's.s')} % (SELECT any_value(n) FROM names_) AS k FROM range(1, {B + 1}) d(draw) CROSS JOIN (SELECT k AS s FROM names_) s) JOIN names_ USING (k) GROUP BY draw, entity UNION ALL SELECT 0, entity, 1 FROM names_)"""
H = "mae AS (SELECT entity, year, indicator, avg(e) AS h, any_value(n) AS n FROM loo GROUP BY entity, year, indicator)"


def _ci(by: str, src: str, x: str = "x") -> str:
    return f"SELECT {by + ', ' if by else ''}round(max(CASE WHEN draw = 0 THEN {x} END), 6) AS est, round(quantile_cont({x}, 0.025) FILTER (draw > 0), 6) AS lo, round(quantile_cont({x}, 0.975) FILTER (draw > 0), 6) AS hi, round(avg(({x} > 0)::INT) FILTER (draw > 0), 6) AS p_gt, round(least(1.0, 2 * least(avg(({x} <= 0)::INT) FILTER (draw > 0), avg(({x} >= 0)::INT) FILTER (draw > 0))), 6) AS p_two FROM {src}" + (f" GROUP BY {by}" if by else "")


def _mean(by: str, src: str, value: str) -> str:
    keys = f"draw, {by}" if by else "draw"
    return f"(SELECT {keys}, sum(w * {value}) / nullif(sum(w * ({value} IS NOT NULL)::INT), 0) AS x FROM {src} JOIN w_ USING (entity) GROUP BY {keys})"


def _boot(v):
    return R.weights(v.means.select("entity"), B)


def _h(v):
    return v.scored.join(P.human_mae(v.ratings).select(*CELL, "h"), CELL)


@query("d1_weights", "SELECT draw, entity, w FROM w_", NAMES, WEIGHTS)
def _(v):
    return _boot(v)


@query("d2_boot_means", f"SELECT draw, model, condition, round(x, 6) AS x FROM {_mean('model, condition', 'scored', 'abs_dev')}", NAMES, WEIGHTS)
def _(v):
    return R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")).withColumn("x", six(F.col("x")))


@query("d3_mae_ci", _ci("model, condition", _mean("model, condition", "scored", "abs_dev")), NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")), MC)


@query("d4_reference_ci", f"SELECT 'human' AS ref, * FROM ({_ci('', _mean('', 'loo', 'e'))}) UNION ALL SELECT 'persistence', * FROM ({_ci('', _mean('', '(SELECT entity, abs(round_even(before, 0) - raw_mean) AS p FROM means JOIN b USING (entity, year, indicator))', 'p'))})", LOO, BEFORE, NAMES, WEIGHTS)
def _(v):
    ref = P.human_loo(v.ratings).select("entity", F.lit("human").alias("ref"), "e").union(P.persistence(v.means).select("entity", F.lit("persistence"), "pers"))
    return R.ci(R.boot_mean(ref, _boot(v), ["ref"], F.col("e")), ["ref"])


_SPEC = [("ft_gain", "base", "correct", "base-ft", "correct"), ("names", "base", "codebook", "base", "correct"), ("summaries", "base", "anon", "base", "summ"), ("absent", "base", "correct", "nobody", "correct")]
_SPEC_SQL = "spec AS (SELECT * FROM (VALUES " + ", ".join(map(str, _SPEC)) + ") s(label, am, ac, bm, bc))"
_DR = f"dr AS {_mean('model, condition', 'scored', 'abs_dev')}"
_PAIRED = "(SELECT label, a.draw, a.x - b.x AS x FROM spec JOIN dr a ON a.model = am AND a.condition = ac JOIN dr b ON b.model = bm AND b.condition = bc AND b.draw = a.draw)"


def _spec(v):
    return v.spark.createDataFrame(_SPEC, "label string, a_model string, a_condition string, b_model string, b_condition string")


def _floor(v):
    return F.lit(float(P.sesoi(v.means).first()[0]))


@query("d5_contrasts", f"SELECT *, abs(est) > (SELECT round(avg(abs(round_even(raw_mean, 0) - raw_mean)) / 2, 6) FROM means) AS sesoi_out FROM ({_ci('label', _PAIRED)})", NAMES, WEIGHTS, _DR, _SPEC_SQL)
def _(v):
    return R.paired(R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")), _spec(v), MC, _floor(v))


@query("d6_skipped_contrasts", "SELECT label FROM spec WHERE (am, ac) NOT IN (SELECT model, condition FROM runs) OR (bm, bc) NOT IN (SELECT model, condition FROM runs)", _SPEC_SQL)
def _(v):
    have = v.runs.select(*MC).distinct()
    s = _spec(v)
    whole = s.join(have.toDF("a_model", "a_condition"), ["a_model", "a_condition"]).join(have.toDF("b_model", "b_condition"), ["b_model", "b_condition"])
    return s.join(whole, "label", "left_anti").select("label")


@query("d7_contrast_survival", "SELECT label, sign(a.x) = sign(b.x) AS same_sign, (abs(a.x) > 0.05) = (abs(b.x) > 0.05) AS same_verdict FROM (SELECT label, x FROM " + _PAIRED + " WHERE draw = 0) a JOIN (SELECT label, x FROM " + _PAIRED.replace("dr a", "dr2 a").replace("dr b", "dr2 b") + " WHERE draw = 0) b USING (label)", NAMES, WEIGHTS, _DR, _SPEC_SQL, f"dr2 AS {_mean('model, condition', 'scored', '((rating - floor(raw_mean + 0.5)) ** 2)')}")
def _(v):
    one = lambda value: R.boot_mean(v.scored, R.weights(v.means.select("entity"), 1).where("draw = 0"), MC, value)
    a, b = (R.paired(one(x), _spec(v), MC, F.lit(0.05)).select("label", F.col("est").alias(n)) for x, n in ((F.col("abs_dev"), "a"), ((F.col("rating") - half_up(F.col("raw_mean"))) ** 2, "b")))
    return a.join(b, "label").select("label", (F.signum("a") == F.signum("b")).alias("same_sign"), ((F.abs("a") > 0.05) == (F.abs("b") > 0.05)).alias("same_verdict"))


_POISSON = [0.36787944117144233]
for _k in range(1, 7):
    _POISSON.append(_POISSON[-1] + 0.36787944117144233 / __import__("math").factorial(_k))


@query("d8_row_boot", _ci("year", "(SELECT draw, year, sum(w * g) / nullif(sum(w), 0) AS x FROM (SELECT draw, year, g, " + " + ".join(f"(r >= {s!r})::INT" for s in _POISSON) + f" AS w FROM (SELECT draw, year, abs(round_even(raw_mean, 0) - raw_mean) AS g, {_u('row', 'draw', 'entity', 'year', 'indicator')} / 4294967296.0 AS r FROM means CROSS JOIN range(1, 2001) d(draw))) GROUP BY draw, year UNION ALL SELECT 0, year, avg(abs(round_even(raw_mean, 0) - raw_mean)) FROM means GROUP BY year)"))
def _(v):
    rows = v.means.withColumn("g", F.abs(half_even(F.col("raw_mean")) - F.col("raw_mean")))
    return R.ci(R.row_boot(rows, B, ["year"], "g", ["entity", "year", "indicator"]), ["year"])


@query("d8_multinomial_boot")
def _(v):
    return R.ci(R.count_boot(v.means, B, ["year"], F.abs(half_even(F.col("raw_mean")) - F.col("raw_mean"))), ["year"])


@query("d9_pool_boot", _ci("model", _mean("model", "(SELECT * FROM scored WHERE (entity, year, indicator) IN (SELECT entity, year, indicator FROM means WHERE n_coders >= 8))", "((rating = round_even(raw_mean, 0))::INT)")), NAMES, WEIGHTS)
def _(v):
    pool = v.scored.join(v.means.where("n_coders >= 8").select(*CELL), CELL, "left_semi")
    return R.ci(R.boot_mean(pool, _boot(v), ["model"], (F.col("rating") == half_even(F.col("raw_mean"))).cast("int")), ["model"])


def _slope(by, src, y, x):
    keys = f"draw, {by}" if by else "draw"
    return f"(SELECT {keys}, (sum(w * {x} * {y}) - sum(w * {x}) * sum(w * {y}) / sum(w)) / nullif(sum(w * {x} * {x}) - sum(w * {x}) ** 2 / sum(w), 0) AS x FROM {src} JOIN w_ USING (entity) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys})"


@query("d10_slope_ci", _ci("model, condition", _slope("model, condition", "(SELECT * FROM scored JOIN mae USING (entity, year, indicator))", "abs_dev", "h")), LOO, H, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_slope(_h(v), _boot(v), MC, F.col("abs_dev"), F.col("h")), MC)


@query("d11_curve_ci", _ci("bin", _mean("bin", "(SELECT entity, abs_dev, least(ceil(row_number() OVER (ORDER BY h, entity, year, indicator) * 20.0 / count(*) OVER ()), 20)::INT AS bin FROM scored JOIN (SELECT entity, year, indicator, round(h, 9) AS h FROM mae) USING (entity, year, indicator) WHERE model = 'base' AND condition = 'correct')", "abs_dev")), LOO, H, NAMES, WEIGHTS)
def _(v):
    rows = v.scored.where("model = 'base' AND condition = 'correct'").join(P.human_mae(v.ratings).select(*CELL, F.round("h", 9).alias("h")), CELL)
    return R.ci(R.boot_mean(M.rank_bins(rows, "h"), _boot(v), ["bin"], F.col("abs_dev")), ["bin"])


_W1D = """he AS (SELECT entity, model, b, sum(f)::DOUBLE AS f, sum(g)::DOUBLE AS g FROM (SELECT entity, model, floor((abs_dev + 1e-9) / 0.01)::INT AS b, 1 AS f, 0 AS g FROM scored UNION ALL SELECT entity, model, floor((e + 1e-9) / 0.01)::INT, 0, 1 FROM loo CROSS JOIN (SELECT DISTINCT model FROM grid_)) GROUP BY ALL),
hx AS (SELECT draw, model, b, sum(w * f) AS f, sum(w * g) AS g FROM he JOIN w_ USING (entity) GROUP BY ALL),
w1d AS (SELECT draw, model, sum(d) AS x FROM (SELECT draw, model, abs(sum(f) OVER w / sum(f) OVER z - sum(g) OVER w / sum(g) OVER z) * coalesce(lead(b) OVER w - b, 0) * 0.01 AS d FROM hx WINDOW w AS (PARTITION BY draw, model ORDER BY b), z AS (PARTITION BY draw, model)) GROUP BY ALL)"""


def _w1(v):
    ai = M.histogram(v.scored.withColumn("x", F.col("abs_dev") + 1e-9), ["entity", "model"], "x", 0.01)
    human = M.histogram(P.human_loo(v.ratings).withColumn("x", F.col("e") + 1e-9), ["entity"], "x", 0.01)
    return R.boot_wasserstein(ai, human, _boot(v), ["model"], 0.01)


@query("d12_w1_ci", _ci("model", "w1d"), LOO, NAMES, WEIGHTS, _W1D)
def _(v):
    return R.ci(_w1(v), ["model"])


@query("d13_exaggeration_ci", _ci("model, condition", "(SELECT draw, model, condition, max(CASE WHEN quintile = 5 THEN x END) - max(CASE WHEN quintile = 1 THEN x END) AS x FROM " + _mean("model, condition, quintile", "scored", "signed_dev") + " GROUP BY ALL)"), NAMES, WEIGHTS)
def _(v):
    d = R.boot_mean(v.scored.where("quintile IN (1, 5)"), _boot(v), [*MC, "quintile"], F.col("signed_dev")).withColumn("top", F.col("quintile") == 5)
    return R.ci(R.difference(d, MC, "top"), MC)


_GAIN = "gain AS (SELECT s.entity, s.year, s.indicator, s.model, c.abs_dev - s.abs_dev AS g, coalesce(dem_ep, 0) = 1 AS in_ep, coalesce(onset, 0) = 1 AS onset FROM scored s JOIN scored c ON c.condition = 'codebook' AND c.model = s.model AND c.entity = s.entity AND c.year = s.year AND c.indicator = s.indicator LEFT JOIN entity_year y ON y.entity = s.entity AND y.year = s.year WHERE s.condition = 'correct')"


def _gain(v):
    wide = M.wide_by_condition(v.scored, ["codebook", "correct"]).withColumn("g", F.col("codebook") - F.col("correct"))
    flags = v.entity_year.select("entity", "year", (F.coalesce("dem_ep", F.lit(0)) == 1).alias("in_ep"), (F.coalesce("onset", F.lit(0)) == 1).alias("onset"))
    return wide.join(flags, ["entity", "year"], "left").na.fill({"in_ep": False, "onset": False})


@query("d14_did", _ci("model", "(SELECT draw, model, max(CASE WHEN in_ep THEN x END) - max(CASE WHEN NOT in_ep THEN x END) AS x FROM " + _mean("model, in_ep", "gain", "g") + " GROUP BY ALL)"), _GAIN, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.difference(R.boot_mean(_gain(v), _boot(v), ["model", "in_ep"], F.col("g")), ["model"], "in_ep"), ["model"])


@query("d15_onset_did", _ci("model", "(SELECT draw, model, max(CASE WHEN onset THEN x END) - max(CASE WHEN NOT onset THEN x END) AS x FROM " + _mean("model, onset", "gain", "g") + " GROUP BY ALL)"), _GAIN, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.difference(R.boot_mean(_gain(v), _boot(v), ["model", "onset"], F.col("g")), ["model"], "onset"), ["model"])


@query("d18_kappa_ci", _ci("model", "(SELECT draw, model, 1 - sum(w * (gold - rating) ** 2) / nullif(sum(w * gold ** 2) + sum(w * rating ** 2) - 2 * sum(w * gold) * sum(w * rating) / sum(w), 0) AS x FROM (SELECT *, floor(raw_mean + 0.5) AS gold FROM scored) JOIN w_ USING (entity) GROUP BY draw, model)"), NAMES, WEIGHTS)
def _(v):
    g, p = half_up(F.col("raw_mean")).cast("double"), F.col("rating").cast("double")
    m = R.resampled(R.sums(v.scored, ["model"], n=F.lit(1), o=(g - p) ** 2, g1=g, g2=g**2, p1=p, p2=p**2), _boot(v), ["model"])
    return R.ci(m.withColumn("x", 1 - F.col("o") / F.nullif(F.col("g2") + F.col("p2") - 2 * F.col("g1") * F.col("p1") / F.col("n"), F.lit(0.0))), ["model"])


@query("d20_levels", _ci("model, level", _mean("model, level", "(SELECT entity, model, unnest(CASE WHEN onset THEN ['in-episode', 'onset'] WHEN in_ep THEN ['in-episode'] ELSE ['stable'] END) AS level, g FROM gain)", "g")), _GAIN, NAMES, WEIGHTS)
def _(v):
    levels = F.when(F.col("onset"), F.array(F.lit("in-episode"), F.lit("onset"))).when(F.col("in_ep"), F.array(F.lit("in-episode"))).otherwise(F.array(F.lit("stable")))
    return R.ci(R.boot_mean(_gain(v).withColumn("level", F.explode(levels)), _boot(v), ["model", "level"], F.col("g")), ["model", "level"])


@query("d21_two_by_two", _ci("part", "(SELECT draw, unnest(['evidence', 'interaction', 'weights']) AS part, unnest([bc - bk, (fc - fk) - (bc - bk), fk - bk]) AS x FROM (SELECT draw, max(x) FILTER (model = 'base' AND condition = 'codebook') AS bk, max(x) FILTER (model = 'base' AND condition = 'correct') AS bc, max(x) FILTER (model = 'base-ft' AND condition = 'codebook') AS fk, max(x) FILTER (model = 'base-ft' AND condition = 'correct') AS fc FROM dr GROUP BY draw))"), NAMES, WEIGHTS, _DR)
def _(v):
    pick = lambda m, c, n: F.max(F.when((F.col("model") == m) & (F.col("condition") == c), F.col("x"))).alias(n)
    d = R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")).groupBy("draw").agg(pick("base", "codebook", "bk"), pick("base", "correct", "bc"), pick("base-ft", "codebook", "fk"), pick("base-ft", "correct", "fc"))
    parts = {"evidence": F.col("bc") - F.col("bk"), "weights": F.col("fk") - F.col("bk"), "interaction": (F.col("fc") - F.col("fk")) - (F.col("bc") - F.col("bk"))}
    return R.ci(d.select("draw", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), x.alias("x")) for p, x in parts.items()))).alias("y")).select("draw", "y.*"), ["part"])


_MOVE = "move AS (SELECT a.entity, a.year, abs(a.covariate - b.covariate) AS m, a.covariate - b.covariate AS sm FROM entity_year a JOIN entity_year b ON b.entity = a.entity AND b.year = a.year - 1)"


def _move(v):
    from quorumspark.operators.movement import yearly

    return yearly(v.entity_year)


@query("d23_movement_slopes", _ci("model, condition", _slope("model, condition", "(SELECT * FROM scored JOIN move USING (entity, year))", "abs_dev", "m")), _MOVE, NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_slope(v.scored.join(_move(v), ["entity", "year"]), _boot(v), MC, F.col("abs_dev"), F.col("m")), MC)


@query("d24_line_band", "SELECT i / 100.0::DOUBLE AS at, round(max(a + x * i / 100.0) FILTER (draw = 0), 6) AS fit, round(quantile_cont(a + x * i / 100.0, 0.025) FILTER (draw > 0), 6) AS lo, round(quantile_cont(a + x * i / 100.0, 0.975) FILTER (draw > 0), 6) AS hi FROM (SELECT draw, x, (sy - x * sx) / n AS a FROM (SELECT draw, sum(w) AS n, sum(w * m) AS sx, sum(w * abs_dev) AS sy, (sum(w * m * abs_dev) - sum(w * m) * sum(w * abs_dev) / sum(w)) / (sum(w * m * m) - sum(w * m) ** 2 / sum(w)) AS x FROM scored JOIN move USING (entity, year) JOIN w_ USING (entity) WHERE model = 'base' AND condition = 'correct' GROUP BY draw)) CROSS JOIN range(0, 21, 5) g(i) GROUP BY i", _MOVE, NAMES, WEIGHTS)
def _(v):
    rows = v.scored.where("model = 'base' AND condition = 'correct'").join(_move(v), ["entity", "year"])
    d = R.boot_slope(rows, _boot(v), [], F.col("abs_dev"), F.col("m")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(5))))
    d = d.withColumn("at", F.col("i") / 100.0).withColumn("y", F.col("a") + F.col("x") * F.col("at"))
    q = F.percentile(F.when(F.col("draw") > 0, F.col("y")), [0.025, 0.975])
    return d.groupBy("at").agg(six(F.max(F.when(F.col("draw") == 0, F.col("y")))).alias("fit"), six(q[0]).alias("lo"), six(q[1]).alias("hi"))


@query("d26_human_gap", _ci("model, condition", f"(SELECT d.draw, model, condition, h.x - d.x AS x FROM dr d JOIN {_mean('', 'loo', 'e')} h ON h.draw = d.draw)"), LOO, NAMES, WEIGHTS, _DR)
def _(v):
    human = R.boot_mean(P.human_loo(v.ratings), _boot(v), [], F.col("e")).withColumnRenamed("x", "hx")
    d = R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")).join(human, "draw")
    return R.ci(d.withColumn("x", F.col("hx") - F.col("x")), MC)


@query("d27_carried_cell", f"SELECT model, condition, est, lo, hi FROM ({_ci('model, condition', 'dr')}) WHERE condition IN ('correct', 'anon') ORDER BY est, model, condition LIMIT 1", NAMES, WEIGHTS, _DR)
def _(v):
    return R.ci(R.boot_mean(v.scored, _boot(v), MC, F.col("abs_dev")), MC).where("condition IN ('correct', 'anon')").orderBy("est", *MC).limit(1).select(*MC, "est", "lo", "hi")


@query("e1_wls_two_terms", _ci("model, condition", _slope("model, condition", "(SELECT * FROM scored JOIN move USING (entity, year))", "signed_dev", "sm")).replace("SELECT model", "SELECT 'sm' AS term, model", 1), _MOVE, NAMES, WEIGHTS)
def _(v):
    d = G.wls_draws(v.scored.join(_move(v), ["entity", "year"]), _boot(v), MC, F.col("signed_dev"), {"sm": F.col("sm")})
    return R.ci(d.where("term = 'sm'"), ["term", *MC])


def _wls_sql(by: str, src: str, y: str, terms: dict[str, str]) -> list[str]:
    """Common table expressions that end in wls_ (draw, by, term, x): normal equations in every draw, solved by elimination, one expression a pivot."""
    names, k = ["intercept", *terms], len(terms) + 1
    t = ["1.0", *terms.values()]
    cols = [(i, j) for i in range(k) for j in range(i, k + 1)]
    value = lambda i, j: f"({t[i]}) * ({y if j == k else t[j]})"
    out = [f"pre_ AS (SELECT entity, {by}, " + ", ".join(f"sum({value(i, j)})::DOUBLE AS m{i}_{j}" for i, j in cols) + f" FROM {src} WHERE {y} IS NOT NULL AND " + " AND ".join(f"({x}) IS NOT NULL" for x in terms.values()) + " GROUP BY ALL)"]
    out.append(f"p0_ AS (SELECT draw, {by}, " + ", ".join(f"sum(w * m{i}_{j}) AS m{i}_{j}" for i, j in cols) + " FROM pre_ JOIN w_ USING (entity) GROUP BY ALL)")
    for p in range(k - 1):  # rows below the pivot; the matrix stays symmetric
        out.append(f"p{p + 1}_ AS (SELECT draw, {by}, " + ", ".join(f"m{i}_{j} - m{p}_{i} * m{p}_{j} / m{p}_{p} AS m{i}_{j}" if i > p else f"m{i}_{j}" for i, j in cols) + f" FROM p{p}_)")
    out.append(f"b{k}_ AS (SELECT * FROM p{k - 1}_)")
    for i in range(k - 1, -1, -1):
        known = "".join(f" - m{i}_{j} * b{j}" for j in range(i + 1, k))
        out.append(f"b{i}_ AS (SELECT *, (m{i}_{k}{known}) / m{i}_{i} AS b{i} FROM b{i + 1}_)")
    out.append(f"wls_ AS (SELECT draw, {by}, unnest([{', '.join(repr(n) for n in names)}]) AS term, unnest([{', '.join(f'b{i}' for i in range(k))}]) AS x FROM b0_)")
    return out


@query("e4_slope_modifier", _ci("model, condition, term", "wls_"), LOO, H, _MOVE, NAMES, WEIGHTS, *_wls_sql("model, condition", "(SELECT * FROM scored JOIN mae USING (entity, year, indicator) JOIN move USING (entity, year))", "abs_dev", {"h": "h", "m": "m", "h_m": "h * m"}))
def _(v):
    rows = _h(v).join(_move(v), ["entity", "year"])
    d = G.wls_draws(rows, _boot(v), MC, F.col("abs_dev"), {"h": F.col("h"), "m": F.col("m"), "h_m": F.col("h") * F.col("m")})
    return R.ci(d, [*MC, "term"])


@query("e5_three_way", _ci("model, term", "wls_"), LOO, H, _MOVE, NAMES, WEIGHTS, *_wls_sql("model", "(SELECT s.*, h, m, covariate AS c FROM scored s JOIN mae USING (entity, year, indicator) JOIN move USING (entity, year) JOIN entity_year USING (entity, year))", "abs_dev", {"h": "h", "m": "m", "c": "c", "hm": "h * m", "hc": "h * c", "mc": "m * c", "hmc": "h * m * c"}))
def _(v):
    rows = _h(v).join(_move(v), ["entity", "year"]).join(v.entity_year.select("entity", "year", "covariate"), ["entity", "year"])
    h, m, c = F.col("h"), F.col("m"), F.col("covariate")
    return R.ci(G.wls_draws(rows, _boot(v), ["model"], F.col("abs_dev"), {"h": h, "m": m, "c": c, "hm": h * m, "hc": h * c, "mc": m * c, "hmc": h * m * c}), ["model", "term"])


@query("e11_entity_lines", "SELECT *, row_number() OVER (ORDER BY r2 DESC NULLS LAST, entity) AS rank FROM (SELECT entity, round(regr_slope(raw_mean, n_coders), 6) AS slope, round(regr_r2(raw_mean, n_coders), 6) AS r2, regr_count(raw_mean, n_coders)::BIGINT AS n, round(regr_avgx(raw_mean, n_coders), 6) AS mean_x, round(regr_avgy(raw_mean, n_coders), 6) AS mean_y FROM means GROUP BY entity HAVING regr_count(raw_mean, n_coders) >= 20)")
def _(v):
    return G.ranked(G.by_group(v.means, ["entity"], "raw_mean", "n_coders"), "r2", ["entity"])


@query("e12_line", "SELECT round(a, 6) AS intercept, round(b, 6) AS slope, round(sqrt(s2 * (1 / n + mx ** 2 / sxx)), 6) AS se_intercept, round(sqrt(s2 / sxx), 6) AS se_slope, round(r2, 6) AS r2, n::BIGINT AS n FROM (SELECT *, (syy - b ** 2 * sxx) / (n - 2) AS s2 FROM (SELECT regr_slope(raw_mean, year) AS b, regr_intercept(raw_mean, year) AS a, regr_r2(raw_mean, year) AS r2, regr_count(raw_mean, year) AS n, regr_sxx(raw_mean, year) AS sxx, regr_syy(raw_mean, year) AS syy, regr_avgx(raw_mean, year) AS mx FROM means))")
def _(v):
    return G.line(v.means, "raw_mean", "year")


@query("e12_fitted", "SELECT entity, year, indicator, round(a + b * year, 6) AS fit, round(raw_mean - a - b * year, 6) AS residual FROM means CROSS JOIN (SELECT regr_slope(raw_mean, year) AS b, regr_intercept(raw_mean, year) AS a FROM means)")
def _(v):
    return G.fitted(v.means, "raw_mean", "year").select(*CELL, six(F.col("fit")).alias("fit"), six(F.col("residual")).alias("residual"))


# seat swaps
def _order(rows: str, seed: str, ids: str, draw_seed: str, draws: int, where: str = "true") -> str:
    """Seats in each draw's order (k), as operators.seats orders them."""
    a = _u(seed, "entity", "year", "indicator", *ids.split(", "))
    r = f"('0x' || substr(md5('{draw_seed}|' || draw), 1, 8))::BIGINT % 2147483646 + 1"
    return f"SELECT *, row_number() OVER (PARTITION BY entity, year, indicator, draw ORDER BY a * r % 2147483647, id) AS k FROM (SELECT *, {a} % 2147483646 + 1 AS a, concat_ws('|', {ids}) AS id, count(*) OVER (PARTITION BY entity, year, indicator) AS n FROM {rows} WHERE {where}) CROSS JOIN (SELECT draw, {r} AS r FROM range(1, {draws + 1}) d(draw))"


def _sums(order: str, name: str, top: int, more: str = "") -> str:
    return f"{name} AS (SELECT entity, year, indicator, draw, n, k, sum(rating) OVER (PARTITION BY entity, year, indicator, draw ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM ({order}) WHERE k <= {top}{more})"


_R = ", ".join(f"('0x' || substr(md5('seat{j}|' || draw), 1, 8))::BIGINT % 2147483646 + 1 AS r{j}" for j in (1, 2, 3))
_REP = f"""ai AS (SELECT entity, year, indicator, row_number() OVER w AS k, sum(rating) OVER w AS s_ai FROM runs WHERE condition = 'correct' WINDOW w AS (PARTITION BY entity, year, indicator ORDER BY list_position(['other', 'base-ft', 'base'], model))),
panel AS (SELECT entity, year, indicator, list(rating ORDER BY coder::VARCHAR) AS l, count(*) AS n, sum(rating) AS s, any_value({_u('cell', 'entity', 'year', 'indicator')}) % 2147483646 + 1 AS c FROM ratings GROUP BY ALL HAVING count(*) >= 2),
at1 AS (SELECT *, c * r1 % 2147483647 % n AS i, c * r2 % 2147483647 % (n - 1) AS x2, CASE WHEN n > 2 THEN c * r3 % 2147483647 % (n - 2) END AS x3 FROM panel CROSS JOIN (SELECT draw, {_R} FROM range(1, {REPLACED + 1}) d(draw))),
at2 AS (SELECT *, x2 + (x2 >= i)::INT AS j FROM at1), at3 AS (SELECT *, x3 + (x3 >= least(i, j))::INT AS y FROM at2),
gone AS (SELECT *, unnest([1, 2, 3]) AS k, unnest([l[i + 1], l[i + 1] + l[j + 1], l[i + 1] + l[j + 1] + l[y + (y >= greatest(i, j))::INT + 1]]) AS gone FROM at3),
dd AS (SELECT entity, year, indicator, k, abs((s - gone + s_ai) / n - s / n) AS d FROM gone JOIN ai USING (entity, year, indicator, k) WHERE k < n),
rep AS (SELECT entity, year, indicator, k, avg(d) AS mean, quantile_cont(d, 0.5) AS median, list_sort(list(d))[greatest(0, floor(count(*) * 0.025) - 1)::INT + 1] AS lo, list_sort(list(d))[least(count(*) - 1, floor(count(*) * 0.975))::INT + 1] AS hi FROM dd GROUP BY entity, year, indicator, k)"""


def _rep(v):
    return S.replacement(v.ratings, v.runs.where("condition = 'correct'"), REPLACED, [1, 2, 3], ["other", "base-ft", "base"])


@query("f1_replacement", "SELECT entity, year, indicator, k, round(mean, 6) AS mean, round(median, 6) AS median, round(lo, 6) AS lo, round(hi, 6) AS hi FROM rep", _REP)
def _(v):
    return _rep(v).withColumns({c: six(F.col(c)) for c in ("mean", "median", "lo", "hi")})


@query("f2_divergence", "SELECT k, round(avg(mean), 6) AS mean, round(avg(lo), 6) AS lo, round(avg(hi), 6) AS hi, count(*) AS n_cells FROM rep GROUP BY k", _REP)
def _(v):
    return S.divergence(_rep(v))


@query("f3_augmentation_ci", _ci("model, condition", _mean("model, condition", "(SELECT * FROM scored WHERE n_coders BETWEEN 2 AND 8)", "(signed_dev / (n_coders + 1))")), NAMES, WEIGHTS)
def _(v):
    return R.ci(R.boot_mean(S.augmentation(v.scored), _boot(v), MC, F.col("shift")), MC)


@query("f4_degradation_ci", _ci("model, condition", "(SELECT draw, model, condition, sum(w * s) / sum(w * n) AS x FROM (SELECT entity, model, condition, sum((r.rating - h.rating) / n_coders) AS s, count(*) AS n FROM scored r JOIN ratings h USING (entity, year, indicator) WHERE n_coders >= 9 GROUP BY ALL) JOIN w_ USING (entity) GROUP BY ALL)"), NAMES, WEIGHTS)
def _(v):
    rows = S.degradation(v.scored)
    m = R.resampled(R.sums(rows, MC, s=F.col("shift") * F.col("n_coders"), n=F.col("n_coders")), _boot(v), MC)
    return R.ci(m.withColumn("x", F.col("s") / F.col("n")), MC)


_DOSE = ["same_ai", "mixed_ft", "mixed_pool"]
_DEG = f"""{_sums(_order('ratings', 'deg', 'coder', 'deg', SEATS), 'hh', 6, ' AND n >= 9')}, {_sums(_order('runs', 'deg_ai', 'model, condition', 'deg', SEATS), 'mm', 6)}, {_sums(_order('runs', 'deg_ai', 'model, condition', 'deg', SEATS, "model <> 'base'"), 'ff', 6)},
deg AS (SELECT entity, year, indicator, k, avg((k * a1.rating - hh.s) / hh.n) AS same_ai, avg((ff.s - hh.s) / hh.n) AS mixed_ft, avg((mm.s - hh.s) / hh.n) AS mixed_pool FROM hh JOIN mm USING (entity, year, indicator, draw, k) JOIN ff USING (entity, year, indicator, draw, k) JOIN (SELECT * FROM runs WHERE model = 'other' AND condition = 'correct') a1 USING (entity, year, indicator) GROUP BY ALL),
deg_ AS (SELECT * FROM (UNPIVOT deg ON {', '.join(_DOSE)} INTO NAME regime VALUE shift))"""


@query("f5_dose_degradation", _ci("regime, k", _mean("regime, k", "deg_", "shift")), NAMES, WEIGHTS, _DEG)
def _(v):
    d = S.dose_degradation(v.ratings, v.runs, SEATS, 6, ("other", "correct"), ["base-ft", "other"])
    return R.ci(R.boot_mean(d.unpivot([*CELL, "k"], _DOSE, "regime", "shift"), _boot(v), ["regime", "k"], F.col("shift")), ["regime", "k"])


_AUG = f"{_sums(_order('runs', 'aug', 'model, condition', 'aug', SEATS), 'mm', 4)}, aug AS (SELECT entity, k, avg((s - k * raw_mean) / (n_coders + k)) AS shift, avg(abs((s - k * raw_mean) / (n_coders + k))) AS size FROM mm JOIN means USING (entity, year, indicator) WHERE n_coders BETWEEN 2 AND 8 GROUP BY entity, year, indicator, k)"


@query("f6_dose_augmentation", "SELECT a.*, b.size, b.n FROM (" + _ci("k", _mean("k", "aug", "shift")) + ") a JOIN (SELECT k, round(avg(size), 6) AS size, count(*) AS n FROM aug GROUP BY k) b USING (k)", NAMES, WEIGHTS, _AUG)
def _(v):
    d = S.dose_augmentation(v.means.where("n_coders BETWEEN 2 AND 8"), v.runs, SEATS, 4)
    whole = d.groupBy("k").agg(six(F.avg("size")).alias("size"), F.count("*").alias("n"))
    return R.ci(R.boot_mean(d, _boot(v), ["k"], F.col("shift")), ["k"]).join(whole, "k")


_FLIP = f"""hh AS ({_order('ratings', 'flip', 'coder', 'flip', SEATS)}), {_sums(_order('runs', 'flip_ai', 'model, condition', 'flip', SEATS), 'mm', 4)},
wide AS (SELECT entity, year, indicator, draw, sum(rating) FILTER (k <= 4) AS s, [sum(rating) FILTER (k <= 1), sum(rating) FILTER (k <= 2), sum(rating) FILTER (k <= 3), sum(rating) FILTER (k <= 4)] AS gone, [sum(rating) FILTER (k = 5), sum(rating) FILTER (k BETWEEN 5 AND 6), sum(rating) FILTER (k BETWEEN 5 AND 7), sum(rating) FILTER (k BETWEEN 5 AND 8)] AS held FROM hh WHERE k <= 8 AND n >= 8 GROUP BY ALL),
arms AS (SELECT entity, year, indicator, k, floor(wide.s / 4 + 0.5) AS was, unnest(['add_ai', 'add_human', 'replace_ai', 'replace_human']) AS arm, unnest([floor((wide.s + mm.s) / (4 + k) + 0.5), floor((wide.s + held[k]) / (4 + k) + 0.5), floor((wide.s - gone[k] + mm.s) / 4 + 0.5), floor((wide.s - gone[k] + held[k]) / 4 + 0.5)]) AS is_ FROM wide JOIN mm USING (entity, year, indicator, draw) WHERE k <= 4),
flips AS (SELECT entity, year, indicator, arm, k, avg((is_ <> was)::INT) AS flip, avg(sign(was - is_)) AS net FROM arms GROUP BY ALL)"""


@query("f7_flips", "SELECT arm, k, round(avg(flip), 6) AS flip, round(avg(net), 6) AS net, count(*) AS n_panels FROM flips GROUP BY arm, k", _FLIP)
def _(v):
    return S.flips(v.ratings, v.runs, SEATS).groupBy("arm", "k").agg(six(F.avg("flip")).alias("flip"), six(F.avg("net")).alias("net"), F.count("*").alias("n_panels"))


@query("f8_complete_panels", "SELECT count(*) AS n FROM (SELECT entity, year, indicator FROM runs WHERE NOT (model = 'other' AND rating = 3) GROUP BY entity, year, indicator HAVING count(*) = 12)")
def _(v):
    return M.common_pool(v.runs.where("NOT (model = 'other' AND rating = 3)"), 12).select(*CELL).distinct().agg(F.count("*").alias("n"))


@query("f9_net_of_churn", "SELECT kind, k, round(avg(flip_d), 6) AS flip_d, round(avg(net_d), 6) AS net_d FROM (SELECT split_part(a.arm, '_', 1) AS kind, a.k, a.flip - h.flip AS flip_d, a.net - h.net AS net_d FROM flips a JOIN flips h ON h.entity = a.entity AND h.year = a.year AND h.indicator = a.indicator AND h.k = a.k AND h.arm = split_part(a.arm, '_', 1) || '_human' WHERE a.arm LIKE '%ai') GROUP BY kind, k", _FLIP)
def _(v):
    return S.net_of_churn(S.flips(v.ratings, v.runs, SEATS)).groupBy("kind", "k").agg(six(F.avg("flip_d")).alias("flip_d"), six(F.avg("net_d")).alias("net_d"))
