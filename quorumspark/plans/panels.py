"""Cleaning and panel statistics over the derived tables."""

from pyspark.sql import functions as F

from quorumspark.functions.core import expectation, six, u
from quorumspark.operators import panel as P
from quorumspark.plans.registry import query
from quorumspark.sources.views import CONDITIONS, MODELS, _u, read_reports, read_runs, read_table, scratch, write_bundle, write_reports

CELL = P.CELL
LOO = "loo AS (SELECT *, abs(rating - loo_mean) AS e FROM (SELECT *, (sum(rating) OVER w - rating) / (count(*) OVER w - 1) AS loo_mean, count(*) OVER w AS n FROM ratings WINDOW w AS (PARTITION BY entity, year, indicator)) WHERE n >= 2)"
INDICATORS = [f"Brand#{a}{b}" for a in range(1, 6) for b in range(1, 6)]


def _run_files(v):
    """The runs as JSONL: models of even ratings under a local name, zero-shot conditions, and here and there a broken line, one without a key or a blank one."""
    rows = v.runs.join(v.dists.select(*CELL, "dist").withColumns({"model": F.lit("base"), "condition": F.lit("codebook")}), [*CELL, "model", "condition"], "left")
    line = F.to_json(F.struct(F.col("entity").alias("country"), "year", "indicator", F.concat("condition", F.when(F.col("rating") == 1, "-zeroshot").otherwise("")).alias("condition"), F.concat("model", F.when(F.col("rating") % 2 == 0, "-local").otherwise("")).alias("model_key"), "rating", F.col("dist").alias("rating_dist")))
    h = u("line", *CELL, "model", "condition") % 50
    folder = scratch(v.spark)
    rows.select(F.when(h == 0, F.concat(F.lit("{broken "), line)).when(h == 1, F.lit('{"country": "no year"}')).when(h == 2, F.lit("")).otherwise(line).alias("value")).write.text(folder)
    return folder


_GOOD = _u("line", *CELL, "model", "condition") + " % 50 > 2"


@query("a1_runs_by_model", f"SELECT model, condition, count(*) AS n, sum(rating)::BIGINT AS total FROM runs WHERE {_GOOD} GROUP BY ALL")
def _(v):
    return read_runs(v.spark, _run_files(v)).groupBy(F.col("model_key").alias("model"), "condition").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


@query("a2_runs_with_distributions", f"SELECT d.entity, d.year, d.indicator, d.rating, len(dist) AS n, round(list_sum(list_transform(dist, lambda x, i: x * (i - 1))), 6) AS readout FROM dists d JOIN (SELECT * FROM runs WHERE model = 'base' AND condition = 'codebook' AND {_GOOD}) r USING (entity, year, indicator)")
def _(v):
    rows = read_runs(v.spark, _run_files(v), ("country", "year", "indicator", "condition", "model_key", "rating", "rating_dist")).where("model_key = 'base' AND condition = 'codebook'")
    n = F.when(F.col("rating_dist").isNotNull(), F.size("rating_dist")).cast("long")
    return rows.select(F.col("country").alias("entity"), "year", "indicator", "rating", n.alias("n"), six(expectation(F.col("rating_dist"))).alias("readout"))


@query("a3_filtered_means", "SELECT entity, year, indicator, round(raw_mean, 6) AS raw_mean, n_coders FROM means WHERE year IN (1996, 1997) AND indicator IN ('Brand#1', 'Brand#3', 'Brand#5')")
def _(v):
    folder = scratch(v.spark)
    write_bundle({"means": v.means.select(*CELL, "raw_mean", "n_coders")}, folder, formats={"means": "csv"})
    rows = read_table(v.spark, f"{folder}/means", "entity string, year int, indicator string, raw_mean double, n_coders long", [1996, 1997], ["Brand#1", "Brand#3", "Brand#5"])
    return rows.select(*CELL, six(F.col("raw_mean")).alias("raw_mean"), "n_coders")


@query("a4_tolerant_json", f"SELECT year, count(*) FILTER (h > 2) AS kept, count(*) FILTER (h = 0 OR h = 1) AS skipped FROM (SELECT *, {_u('line', *CELL, 'model', 'condition')} % 50 AS h FROM runs) GROUP BY year".replace("SELECT year, count(*) FILTER (h > 2) AS kept, count(*) FILTER (h = 0 OR h = 1) AS skipped", "SELECT CASE WHEN h > 2 THEN year END AS year, count(*) FILTER (h > 2) AS kept, count(*) FILTER (h = 0 OR h = 1) AS skipped").replace("GROUP BY year", "WHERE h <> 2 GROUP BY ALL"))
def _(v):
    rows = read_runs(v.spark, _run_files(v), ("year",), skipped=True)
    return rows.groupBy("year").agg(F.count("year").alias("kept"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped")).where("kept + skipped > 0")


_REPORTS = "SELECT CASE region WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END AS source, year, replace(lower(entity), ' ', '-') AS slug, 'Orders of ' || entity || chr(10) || chr(10) || 'count ' || count(*) || chr(10) || 'customers ' || sum(o_orderkey % 7) AS text FROM orders_ GROUP BY region, entity, year"


@query("a5_reports", f"SELECT source, year, slug, md5(text) AS digest FROM ({_REPORTS})")
def _(v):
    source = F.when(F.col("region") == 0, "first").when(F.col("region") == 1, "second").otherwise("third")
    text = F.concat(F.lit("Orders of "), "entity", F.lit("\n\ncount "), F.col("n").cast("string"), F.lit("\ncustomers "), F.col("s").cast("string"))
    rows = v.orders.groupBy("region", "entity", "year").agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey") % 7).alias("s"))
    folder = scratch(v.spark)
    write_reports(rows.select(source.alias("source"), "year", F.replace(F.lower("entity"), F.lit(" "), F.lit("-")).alias("slug"), text.alias("text")), folder)
    return read_reports(v.spark, folder).select("source", "year", "slug", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("a6_written_bundle", "SELECT 'ids' AS member, count(*) AS n, sum(hash_) AS checks FROM (SELECT DISTINCT entity, year, indicator, year AS hash_ FROM ratings) UNION ALL SELECT 'results', count(*), sum(rating) FROM scored UNION ALL SELECT 'training', count(*), sum(rating) FROM ratings")
def _(v):
    folder = scratch(v.spark)
    records = v.ratings.select(F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.concat_ws(" ", *CELL).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("rating").cast("string").alias("content"))).alias("messages"), *CELL, "coder")).alias("value"))
    write_bundle({"ids": v.ratings.select(*CELL).distinct(), "results": v.scored, "training": records}, folder, {"results": ["model"]}, {"ids": "csv", "training": "text"})
    one = lambda name, df, c: df.agg(F.lit(name).alias("member"), F.count("*").alias("n"), F.sum(c).cast("long").alias("checks"))
    ids = one("ids", read_table(v.spark, f"{folder}/ids", "entity string, year int, indicator string"), "year")
    results = one("results", v.spark.read.parquet(f"{folder}/results"), "rating")
    training = v.spark.read.schema("messages array<struct<role: string, content: string>>, coder long").json(f"{folder}/training")
    return ids.union(results).union(one("training", training, F.get("messages", F.lit(1)).content.cast("int")))


@query("a7_last_written", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id, event_type", raw=True)
def _(v):
    return P.last_written(v.table("events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id").withColumn("value", six(F.col("value")))


@query("a7_dropped_copies", "SELECT treatment, model, count(*) AS n_written, count(DISTINCT (iso, year, indicator)) AS n_kept, count(*) - count(DISTINCT (iso, year, indicator)) AS n_dropped FROM log_ GROUP BY ALL")
def _(v):
    kept = P.last_written(v.log, ["iso", "year", "indicator", "treatment", "model"]).groupBy("treatment", "model").agg(F.count("*").alias("n_kept"))
    return v.log.groupBy("treatment", "model").agg(F.count("*").alias("n_written")).join(kept, ["treatment", "model"]).withColumn("n_dropped", F.col("n_written") - F.col("n_kept"))


@query("a8_first_written", "SELECT iso, year, indicator, treatment, model, arg_min(response, seq) AS response, min(seq) AS seq FROM log_ GROUP BY iso, year, indicator, treatment, model")
def _(v):
    return P.first_written(v.log, ["iso", "year", "indicator", "treatment", "model"], ["seq"])


@query("a9_pending_jobs", "SELECT entity, year, indicator, condition, model FROM means CROSS JOIN grid_ WHERE (entity, year, indicator, condition, model) NOT IN (SELECT entity, year, indicator, condition, model FROM runs WHERE rating <> 4)")
def _(v):
    grid = v.spark.createDataFrame([(c, m) for c in CONDITIONS for m in MODELS], "condition string, model string")
    return P.pending([grid], v.means.select(*CELL), CELL, v.runs.where("rating <> 4").select(*CELL, "condition", "model"))


@query("a10_wide_to_long", "SELECT entity, year, name AS indicator, value FROM (UNPIVOT (SELECT entity, year, sum(rating) FILTER (indicator = 'Brand#11')::BIGINT AS b11, sum(rating) FILTER (indicator = 'Brand#22')::BIGINT AS b22, sum(rating) FILTER (indicator = 'Brand#33')::BIGINT AS b33 FROM ratings GROUP BY entity, year) ON b11, b22, b33 INTO NAME name VALUE value)")
def _(v):
    wide = v.ratings.groupBy("entity", "year").agg(*(F.sum(F.when(F.col("indicator") == f"Brand#{k}", F.col("rating"))).alias(f"b{k}") for k in (11, 22, 33)))
    return P.wide_to_long(wide, ["entity", "year"], ["b11", "b22", "b33"])


@query("a11_paired_unpivot", "SELECT entity, year, 'b' || right(indicator, 2) AS indicator, count(*) AS n_coders, round(stddev_samp(rating), 6) AS posterior_sd FROM ratings WHERE indicator IN ('Brand#11', 'Brand#22') GROUP BY entity, year, indicator")
def _(v):
    is_ = lambda k: F.col("indicator") == f"Brand#{k}"
    wide = v.ratings.groupBy("entity", "year").agg(*(x for k in (11, 22) for x in (F.nullif(F.count(F.when(is_(k), 1)), F.lit(0)).alias(f"b{k}_nr"), six(F.stddev_samp(F.when(is_(k), F.col("rating")))).alias(f"b{k}_sd"))))
    return P.paired_to_long(wide, ["entity", "year"], ["b11", "b22"])


@query("a12_reduced_coders", "SELECT coder, year(o_orderdate)::INT AS year, name AS indicator, value::BIGINT AS rating FROM (UNPIVOT (SELECT l_suppkey AS coder, o_orderdate, l_orderkey, l_linenumber, l_quantity::INT % 5 AS q, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE month(o_orderdate) = 12 AND day(o_orderdate) = 31 AND year(o_orderdate) BETWEEN 1996 AND 1999) ON q, line INTO NAME name VALUE value)", raw=True)
def _(v):
    rows = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("coder"), F.to_date("o_orderdate").alias("day"), (F.col("l_quantity").cast("int") % 5).cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("line"))
    return P.reduce_coders(rows, ["coder"], "day", ["q", "line"], 1996, 1999)


@query("a13_coverage", "SELECT model, condition, n, 'thin' AS problem FROM (SELECT *, quantile_cont(n, 0.5) OVER () AS mid FROM (SELECT model, condition, count(*) AS n FROM runs WHERE NOT (model = 'other' AND rating = 1) GROUP BY ALL)) WHERE n < 0.9 * mid UNION ALL SELECT 'absent', NULL, 0, 'missing'")
def _(v):
    return P.coverage(v.runs.where("NOT (model = 'other' AND rating = 1)"), [*MODELS, "absent"])


@query("a14_scored_indicators", "SELECT DISTINCT indicator FROM runs WHERE indicator IN (SELECT indicator FROM releases)")
def _(v):
    return v.runs.select("indicator").distinct().join(v.releases.select("indicator"), "indicator", "left_semi")


@query("a15_common_scope", "SELECT 'indicator' AS kind, indicator AS key FROM releases GROUP BY indicator HAVING count(DISTINCT release) = 4 UNION ALL SELECT 'entity', entity FROM releases GROUP BY entity HAVING count(DISTINCT release) = 4")
def _(v):
    return P.common_scope(v.releases, "indicator").select(F.lit("indicator").alias("kind"), F.col("indicator").alias("key")).union(P.common_scope(v.releases, "entity").select(F.lit("entity"), "entity"))


@query("a16_off_scale", "SELECT model, condition, count(*) AS n, count(*) FILTER (NOT coalesce(r BETWEEN 0 AND 5, false)) AS n_dropped FROM (SELECT model, condition, CASE WHEN h % 11 = 0 THEN NULL WHEN h % 13 = 0 THEN 7 ELSE rating END AS r FROM (SELECT *, " + _u("off", "model", "condition", "entity", "year", "indicator") + " AS h FROM runs)) GROUP BY ALL")
def _(v):
    h = u("off", "model", "condition", "entity", "year", "indicator")
    return P.off_scale(v.runs.withColumn("rating", F.when(h % 11 == 0, None).when(h % 13 == 0, 7).otherwise(F.col("rating"))))


@query("a17_corrections", "SELECT entity, year, indicator, CASE WHEN entity = (SELECT min(entity) FROM means) AND year = 1997 THEN 9 ELSE ord END AS ord FROM ord_")
def _(v):
    first = v.means.agg(F.min("entity").alias("entity"))
    fix = v.ord.where("year = 1997").join(F.broadcast(first), "entity").select(*CELL, F.lit(9).alias("ord"))
    return P.corrected(v.ord, fix, CELL, ["ord"])


@query("a18_swap_work", "SELECT source, named, arm, year, indicator FROM (SELECT source, named, 'swapped' AS arm FROM pairs UNION ALL SELECT source, source, 'correct' FROM pairs) CROSS JOIN (SELECT DISTINCT year, indicator FROM means) WHERE (source, arm, year, indicator) NOT IN (SELECT source, arm, year, indicator FROM swaps WHERE model = 'base' AND rating <> 2)")
def _(v):
    arms = v.pairs.withColumn("arm", F.lit("swapped")).union(v.pairs.select("source", "source", F.lit("correct")))
    done = v.swaps.where("model = 'base' AND rating <> 2").select("source", "arm", "year", "indicator")
    return P.pending([arms], v.means.select("year", "indicator").distinct(), ["year", "indicator"], done).select("source", "named", "arm", "year", "indicator")


@query("b1_panel_means", "SELECT entity, year, indicator, round(raw_mean, 6) AS raw_mean, n_coders FROM means WHERE n_coders >= 5")
def _(v):
    return P.panel_means(v.ratings, 5).withColumn("raw_mean", six(F.col("raw_mean")))


@query("b2_human_loo", "SELECT entity, year, indicator, coder, rating, round(loo_mean, 6) AS loo_mean, round(e, 6) AS e, n FROM loo", LOO)
def _(v):
    return P.human_loo(v.ratings).withColumns({"loo_mean": six(F.col("loo_mean")), "e": six(F.col("e"))})


@query("b3_human_mae", "SELECT entity, year, indicator, round(avg(e), 6) AS h, any_value(n) AS n FROM loo GROUP BY entity, year, indicator", LOO)
def _(v):
    return P.human_mae(v.ratings).withColumn("h", six(F.col("h")))


@query("b4_rounding_floor", "SELECT year, round(avg(g), 6) AS mean_floor, round(quantile_cont(g, 0.5), 6) AS median_floor, count(*) AS n FROM (SELECT year, abs(round_even(raw_mean, 0) - raw_mean) AS g FROM means) GROUP BY year")
def _(v):
    return P.rounding_floor(v.means)


@query("b5_sesoi", "SELECT round(avg(abs(round_even(raw_mean, 0) - raw_mean)) / 2, 6) AS sesoi FROM means")
def _(v):
    return P.sesoi(v.means)


@query("b6_persistence", "SELECT m.entity, m.year, m.indicator, round(abs(round_even(p.raw_mean, 0) - m.raw_mean), 6) AS pers FROM means m JOIN means p ON p.entity = m.entity AND p.indicator = m.indicator AND p.year = m.year - 1")
def _(v):
    return P.persistence(v.means).select(*CELL, six(F.col("pers")).alias("pers"))


@query("b7_rails", "SELECT rail, round(avg(abs(guess - raw_mean)), 6) AS mae, count(guess) AS n, round(count(guess) / count(*), 6) AS coverage, round(corr(guess, raw_mean), 6) AS r, round((SELECT avg(abs_dev) FROM scored) / nullif(avg(abs(guess - raw_mean)), 0), 6) AS observed_ratio FROM long_ GROUP BY rail", "long0 AS (SELECT m.raw_mean, round_even(m.raw_mean, 0) AS rounding, round_even(p.raw_mean, 0) AS persist, o.ord::DOUBLE AS ord, q.ord::DOUBLE AS ord_prev FROM means m LEFT JOIN means p ON p.entity = m.entity AND p.indicator = m.indicator AND p.year = m.year - 1 LEFT JOIN ord_ o ON o.entity = m.entity AND o.indicator = m.indicator AND o.year = m.year LEFT JOIN ord_ q ON q.entity = m.entity AND q.indicator = m.indicator AND q.year = m.year - 1)", "long_ AS (" + " UNION ALL ".join(f"SELECT raw_mean, '{c}' AS rail, {c} AS guess FROM long0" for c in ("rounding", "persist", "ord", "ord_prev")) + ")")
def _(v):
    return P.rails(v.means, v.ord, v.scored)


ANCHORS = "anchors AS (SELECT coder, anchor, rating FROM (SELECT coder, indicator AS anchor, rating, row_number() OVER (PARTITION BY coder, indicator ORDER BY year, entity) AS k FROM ratings WHERE indicator IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#21')) WHERE k = 1), mads AS (SELECT coder, avg(abs(rating - centre)) AS mad, count(*) AS n_anchors FROM anchors JOIN (SELECT anchor, avg(rating) AS centre FROM anchors GROUP BY anchor) USING (anchor) GROUP BY coder HAVING count(*) >= 5), bridges AS (SELECT coder, year, count(DISTINCT entity) > 1 AS bridge FROM ratings GROUP BY coder, year)"


def _anchors(v):
    return v.ratings.where(F.col("indicator").isin("Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15", "Brand#21")).select("coder", F.col("indicator").alias("anchor"), F.struct("year", "entity").alias("seq"), "rating")


@query("b8_composition", "SELECT entity, year, indicator, round(avg(rating), 6) AS raw_mean, count(DISTINCT coder) AS n_coders, round(avg(bridge::INT), 6) AS bridge_share, round(avg(mad), 6) AS mean_mad, count(mad) AS n_mad FROM ratings LEFT JOIN bridges USING (coder, year) LEFT JOIN mads USING (coder) GROUP BY entity, year, indicator", ANCHORS)
def _(v):
    out = P.composition(v.ratings, P.bridge_coders(v.ratings), P.anchor_mad(_anchors(v)))
    return out.withColumns({c: six(F.col(c)) for c in ("raw_mean", "bridge_share", "mean_mad")})


@query("b9_bridge_coders", "SELECT * FROM bridges", ANCHORS)
def _(v):
    return P.bridge_coders(v.ratings)


@query("b10_anchor_mad", "SELECT coder, round(mad, 6) AS mad, n_anchors FROM mads", ANCHORS)
def _(v):
    return P.anchor_mad(_anchors(v)).withColumn("mad", six(F.col("mad")))


@query("b11_direction", "SELECT indicator, round(r, 6) AS r, ordinal, CASE WHEN NOT ordinal THEN 'drop' WHEN r >= 0.1 THEN 'keep' WHEN r <= -0.1 THEN 'flip' ELSE 'drop' END AS action FROM (SELECT indicator, corr(m, c) AS r FROM (SELECT entity, indicator, avg(rating) AS m FROM ratings GROUP BY ALL) JOIN (SELECT entity, avg(covariate) AS c FROM entity_year GROUP BY entity) USING (entity) GROUP BY indicator) JOIN (SELECT indicator, count(*) >= 50 AND max(rating) = 4 AND min(rating) <= 1 AND count(DISTINCT rating) >= 4 AS ordinal FROM ratings GROUP BY indicator) USING (indicator)")
def _(v):
    return P.directions(v.ratings, v.entity_year)


@query("b12_volatility", "SELECT entity, indicator, round(stddev_samp(raw_mean), 6) AS sd, round(avg(n_coders) FILTER (year < 1998), 6) AS n_pre, round(avg(n_coders) FILTER (year >= 1998), 6) AS n_post, count(DISTINCT year) AS years FROM means GROUP BY ALL HAVING count(DISTINCT year) >= 5")
def _(v):
    return P.volatility(v.means, 1998).withColumns({c: six(F.col(c)) for c in ("sd", "n_pre", "n_post")})


@query("b13_first_differences", "SELECT entity, year, indicator, round(raw_mean - pm, 6) AS d_raw_mean, n_coders - pn AS d_n_coders, pr AS lag_regime FROM (SELECT *, lag(raw_mean) OVER w AS pm, lag(n_coders) OVER w AS pn, lag(regime) OVER w AS pr, lag(year) OVER w AS py FROM means WINDOW w AS (PARTITION BY entity, indicator ORDER BY year)) WHERE py = year - 1")
def _(v):
    return P.first_differences(v.means, ["raw_mean", "n_coders"], ["regime"]).select(*CELL, six(F.col("d_raw_mean")).alias("d_raw_mean"), "d_n_coders", "lag_regime")


@query("b14_entity_summary", "SELECT entity, round(m - avg(m) OVER (), 6) AS centred, region FROM (SELECT entity, avg(covariate) AS m, any_value(region) AS region FROM entity_year GROUP BY entity)")
def _(v):
    return P.entity_summary(v.entity_year)


@query("b15_scale_width", "SELECT indicator, max(rating) AS width FROM ratings GROUP BY indicator HAVING max(rating) > 0")
def _(v):
    return P.scale_width(v.ratings)


@query("b16_quintiles", "SELECT entity, year, quintile, ntile(5) OVER (ORDER BY covariate, entity, year) AS overall FROM entity_year")
def _(v):
    return P.buckets(v.entity_year, 5, [], ["covariate", "entity", "year"], "overall").select("entity", "year", "quintile", "overall")
