"""Rating tables derived from the star schema, and readers of the formats that panels come in.

Grain: entity = nation, year = order year, indicator = part brand, coder = supplier. Machine ratings, readouts, name-swap arms,
re-identification logs and releases are hash-made from the panels, so they grow with the tables.
"""

import json
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumspark.functions.core import u
from quorumspark.sources import files

MODELS = ("base", "base-ft", "other")
CONDITIONS = ("codebook", "correct", "anon", "summ")
#: Headers that the derived reports have, and which sections the indicators read of each source.
PART_NAMES = ("Women", "National/Racial/Ethnic Minorities", "Trafficking in Persons", "Members of National/Racial/Ethnic Minority Groups", "Children")
INDICATORS = ("rights", "belief", "belief_more", "groups", "women", "unmapped", "rare")
PLAN = [("rights", "first", 0, "1", None), ("rights", "first", 1, "2a", None), ("rights", "second", 0, "A", None), ("rights", "second", 1, "C", None), ("belief", "first", 0, "2c", None), ("belief", "second", 0, "B", None), ("belief_more", "first", 0, "2c", None), ("belief_more", "first", 1, "3", None), ("groups", "first", 0, "6", "minorities"), ("groups", "first", 1, "1b", None), ("groups", "second", 0, "G", None), ("women", "first", 0, "6", "women"), ("rare", "first", 0, "9", None), ("rare", "first", 1, "1a", None), ("rare", "second", 0, "D", None)]

RUNS_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("indicator", T.StringType()),
    T.StructField("condition", T.StringType()), T.StructField("model_key", T.StringType()), T.StructField("rating", T.IntegerType()),
    T.StructField("rating_dist", T.ArrayType(T.DoubleType())), T.StructField("raw_mean", T.DoubleType()), T.StructField("justification", T.StringType()),
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("section_keys", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("tokens", T.StructType([T.StructField("input", T.IntegerType()), T.StructField("output", T.IntegerType())])),
    T.StructField("raw_response", T.StringType()),
])


def _source(spark: SparkSession, name: str, paths):
    files.register(spark)
    return spark.read.format(name).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("parallel", spark.sparkContext.defaultParallelism)


def read_runs(spark: SparkSession, paths, cols=("country", "year", "indicator", "condition", "model_key", "rating"), schema=RUNS_SCHEMA, skipped: bool = False) -> DataFrame:
    """JSONL run files with a declared schema, of which only `cols` are built; malformed and blank lines, and lines without a key, are skipped; a -local suffix of the model and a -zeroshot suffix of the condition are dropped.

    Filters on columns reach the reader. skipped: a column of that name, set only in one more row of each task, with the lines that it skipped.
    """
    keys = ("country", "year", "indicator")
    more = [T.StructField("skipped", T.LongType())] if skipped else []
    rows = _source(spark, "panel_runs", paths).schema(T.StructType([*(schema[c] for c in dict.fromkeys((*keys, *cols))), *more]))
    return rows.option("required", ",".join(keys)).option("drop_suffix", "model_key=-local,condition=-zeroshot").load().select(*cols, *(f.name for f in more))


def read_table(spark: SparkSession, path: str, schema, years=None, indicators=None) -> DataFrame:
    """A CSV table with a declared schema; year and indicator filters reach the scan."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    rows = rows.where(F.col("year").isin(*years)) if years else rows
    return rows.where(F.col("indicator").isin(*indicators)) if indicators else rows


def read_reports(spark: SparkSession, paths) -> DataFrame:
    """(source, year, slug, text) of whole text files laid out as source/year/slug.txt, or as Spark writes them, source=.../year=.../slug=.../part; filters on source, year and slug leave files unopened."""
    return _source(spark, "panel_reports", paths).load()


def write_reports(reports: DataFrame, folder: str) -> None:
    """One text file for each (source, year, slug, text)."""
    reports.repartition("source", "year", "slug").select("source", "year", "slug", "text").write.mode("overwrite").partitionBy("source", "year", "slug").text(folder)


def write_bundle(tables: dict, folder: str, partition_by: dict | None = None, formats: dict | None = None) -> None:
    """One table for each member of a bundle: Parquet, or what `formats` says (csv with a header, json lines)."""
    for name, df in tables.items():
        kind = (formats or {}).get(name, "parquet")
        df.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, ())).format(kind).options(**({"header": True} if kind == "csv" else {})).save(f"{folder}/{name}")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir; where the session names none, a temporary one on a single machine and the warehouse on a cluster."""
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (context.get() if context.isDefined() else None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` written to a new shared folder: what follows starts from the table, whose size decides how it is joined."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Views:
    """The derived tables over a folder of Parquet files; nothing runs before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def once(self, *names: str) -> "Views":
        """Write the named derived tables to the shared folder, for queries that read them several times; what derives from them starts there."""
        for name in names:
            self.__dict__[name] = kept(getattr(self, name))
        return self

    @cached_property
    def orders(self):
        return self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.col("n_name").alias("entity"), F.col("n_regionkey").alias("region"))

    @cached_property
    def ratings(self):
        """(entity, year, indicator, coder, rating)."""
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        parts = self.table("part").select("p_partkey", F.col("p_brand").alias("indicator"))
        rows = items.join(self.orders.select("o_orderkey", "year", "entity"), F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        return rows.groupBy("entity", "year", "indicator", F.col("l_suppkey").alias("coder")).agg(F.max(F.col("l_quantity").cast("int") % 5).alias("rating"))

    @cached_property
    def entity_year(self):
        """(entity, year, region, covariate, dem_ep, onset, quintile, regime); dem_ep has nulls."""
        from pyspark.sql import Window as W

        rows = self.orders.groupBy("entity", "year").agg(F.first("region").alias("region"), F.round(F.avg("o_totalprice") / 400000, 4).alias("covariate"))
        ep = u("ep", "entity", "year")
        rows = rows.withColumn("dem_ep", F.when(ep % 7 == 0, None).otherwise((ep % 5 == 0).cast("int"))).withColumn("onset", F.when(F.col("dem_ep") == 1, F.floor(ep / 5) % 2).otherwise(0).cast("int"))
        rows = rows.withColumn("quintile", F.ntile(5).over(W.partitionBy("year").orderBy("covariate", "entity")))
        return rows.withColumn("regime", F.least(F.col("quintile") - 1, F.lit(3)))

    @cached_property
    def means(self):
        """(entity, year, indicator, raw_mean, n_coders, quintile, regime)."""
        m = self.ratings.groupBy("entity", "year", "indicator").agg(F.avg("rating").alias("raw_mean"), F.count("*").alias("n_coders"))
        return m.join(self.entity_year.select("entity", "year", "quintile", "regime"), ["entity", "year"])

    @cached_property
    def scored(self):
        """Every machine rater over every cell: runs with raw_mean, n_coders, quintile, regime, signed_dev, abs_dev. The panel's columns go through the grid, so nothing is joined back."""
        grid = self.spark.createDataFrame([(m, c) for m in MODELS for c in CONDITIONS], "model string, condition string")
        rows = self.means.crossJoin(F.broadcast(grid)).withColumn("h", u("ai", "model", "condition", "entity", "year", "indicator"))
        rating = F.when(F.col("h") % 3 == 0, F.floor(F.col("h") / 3) % 5).otherwise(F.floor(F.col("raw_mean") + 0.5)).cast("int")
        return rows.withColumn("rating", rating).drop("h").withColumn("signed_dev", F.col("rating") - F.col("raw_mean")).withColumn("abs_dev", F.abs("signed_dev"))

    @cached_property
    def runs(self):
        """(model, condition, entity, year, indicator, rating) of every machine rater over every cell."""
        return self.scored.select("model", "condition", "entity", "year", "indicator", "rating")

    @cached_property
    def ord(self):
        """(entity, year, indicator, ord): the published ordinal."""
        h = u("ord", "entity", "year", "indicator")
        gold = F.floor(F.col("raw_mean") + 0.5)
        return self.means.select("entity", "year", "indicator", F.greatest(F.lit(0), F.least(F.lit(4), F.when(h % 7 == 0, gold + 1).when(h % 7 == 1, gold - 1).otherwise(gold))).cast("int").alias("ord"))

    @cached_property
    def dists(self):
        """base model, codebook: (entity, year, indicator, rating, dist array<double>); every ninth is null."""
        rows = self.runs.where("model = 'base' AND condition = 'codebook'").select("entity", "year", "indicator", "rating")
        p = [(1 + F.pmod(u(f"dist{i}", "entity", "year", "indicator"), F.lit(9))).cast("double") for i in range(5)]
        total = sum(p[1:], p[0])
        return rows.withColumn("dist", F.when(u("nodist", "entity", "year", "indicator") % 9 > 0, F.array(*(x / total for x in p))))

    @cached_property
    def pairs(self):
        """(source, named): entities named after each other within their region, nobody after themselves."""
        from quorumspark.operators.identity import derangement

        return derangement(self.orders.select("entity", "region").distinct())

    @cached_property
    def swaps(self):
        """(model, source, named, year, indicator, arm, rating): arm correct (named = source) or swapped."""
        years = self.means.select(F.col("entity").alias("source"), "year", "indicator", "raw_mean")
        arms = self.pairs.select("source", "named", F.lit("swapped").alias("arm")).union(self.pairs.select("source", F.col("source").alias("named"), F.lit("correct").alias("arm")))
        models = self.spark.createDataFrame([(m,) for m in MODELS], "model string")
        rows = years.join(arms, "source").crossJoin(F.broadcast(models)).withColumn("h", u("swap", "model", "source", "named", "year", "indicator"))
        return rows.select("model", "source", "named", "year", "indicator", "arm", F.when(F.col("h") % 3 == 0, F.floor(F.col("h") / 3) % 5).otherwise(F.floor(F.col("raw_mean") + 0.5)).cast("int").alias("rating"))

    @cached_property
    def log(self):
        """An append-only log with repeated keys: (seq, iso, year, indicator, treatment, model, response)."""
        names = self.orders.select(F.col("entity").alias("guess"), "region").distinct()
        cells = self.means.select(F.col("entity").alias("iso"), "year", "indicator")
        arms = self.spark.createDataFrame([(t, m) for t in ("anon", "summ") for m in MODELS[:2]], "treatment string, model string")
        copies = self.spark.createDataFrame([(0,), (1,)], "copy int")
        rows = cells.crossJoin(F.broadcast(arms)).crossJoin(F.broadcast(copies)).withColumn("h", u("reid", "iso", "year", "indicator", "treatment", "model", "copy")).where((F.col("copy") == 0) | (F.col("h") % 10 == 0))
        rows = rows.join(self.orders.select(F.col("entity").alias("iso"), "region").distinct(), "iso")
        near = names.withColumn("slot", F.row_number().over(_by_region()) - 1)
        picked = rows.withColumn("slot", F.col("h") % 5).join(near, ["region", "slot"])
        first = F.when(F.floor(F.col("h") / 8) % 3 == 0, F.col("iso")).otherwise(F.col("guess"))
        second = F.when(F.floor(F.col("h") / 32) % 2 == 0, F.col("iso")).otherwise(F.lit("NOWHERE"))
        cue = F.element_at(F.array(*map(F.lit, ("named officials", "the electoral calendar", "a border dispute", "unclear"))), (F.floor(F.col("h") / 64) % 4 + 1).cast("int"))
        text = F.concat(F.lit("1. "), first, F.lit(" (likely)\n2. "), second, F.lit("\n3. NOWHERE\nReason: "), cue)
        seq = F.col("copy").cast("long") * 10_000_000_000 + F.col("h")
        return picked.select(seq.alias("seq"), "iso", "year", "indicator", "treatment", "model", text.alias("response"))

    @cached_property
    def releases(self):
        """(release, entity, year, indicator, n_coders, posterior_sd) for releases 0..3: release r has the ratings of coders whose hash is at most r."""
        rel = self.spark.range(4).select(F.col("id").cast("int").alias("release"))
        seen = self.ratings.withColumn("h", u("rel", "coder") % 4).crossJoin(F.broadcast(rel)).where("h <= release AND year <= 1998 + release")
        return seen.groupBy("release", "entity", "year", "indicator").agg(F.count("*").alias("n_coders"), F.stddev_samp("rating").alias("posterior_sd"))

    @cached_property
    def reports(self):
        """(doc_id, source, text): documents with headers of sections, of parts and of lettered parts before every other line."""
        return self._headed(lambda k, line: F.when(k % 6 == 3, F.concat(F.lit("Section "), (F.floor(k / 6) % 7 + 1).cast("string"), F.lit(". Head\n"), line)).when(k % 6 == 5, F.concat(F.lit(" "), _pick("abcdefg", k / 6), F.lit(". Part\n"), line)).when(k % 6 == 4, F.concat(_pick(PART_NAMES, k / 6), F.lit("\n"), line)).otherwise(line))

    def _headed(self, head):
        # a document is one row, so its lines get their headers where they lie
        lines = F.transform(F.split("text", "\n", -1), lambda line, k: head(k, line))
        return self.table("documents").where("text IS NOT NULL").select("doc_id", "source", F.array_join(lines, "\n").alias("text"))

    @cached_property
    def shelf(self):
        """(source, doc_id, year, text): a numbered report of every document, a lettered one of most, and the document itself as the third source of some."""
        year = (2016 + F.col("doc_id") % 8).cast("int").alias("year")
        second = self._headed(lambda k, line: F.when(k == 20, F.concat(F.lit("## Country Facts\n"), line)).when(k % 5 == 2, F.concat(F.lit("## "), F.when(k % 10 == 7, "header2 ").otherwise(""), _pick("ABCDEFG", k / 5), F.lit(" Title\n"), line)).when(k % 5 == 4, F.concat(F.lit("Score Change: moved\n"), line, F.lit("\n"))).when(k % 7 == 6, F.concat(F.lit("## PR Divider\n"), line)).otherwise(line))
        out = self.reports.select(F.lit("first").alias("source"), "doc_id", year, "text").union(second.where("doc_id % 4 <> 1").select(F.lit("second"), "doc_id", year, "text"))
        return out.union(self.table("documents").where("doc_id % 3 = 0 AND text IS NOT NULL").select(F.lit("third"), "doc_id", year, "text"))

    @cached_property
    def plan(self):
        """(indicator, source, pos, section, part) of the indicators below."""
        return self.spark.createDataFrame(PLAN, "indicator string, source string, pos int, section string, part string")

    @cached_property
    def indicators(self):
        """(indicator, source), sources without a section included."""
        return self.spark.createDataFrame([(i, s) for i in INDICATORS for s in ("first", "second")], "indicator string, source string")


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(k) % len(names) + 1).cast("int"))


def _by_region():
    from pyspark.sql import Window as W

    return W.partitionBy("region").orderBy("guess")


def _u(seed, *cols):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 8))::BIGINT"


#: The same tables for DuckDB, to stand before a query.
SQL = f"""
orders_ AS (SELECT o_orderkey, o_totalprice, year(o_orderdate)::INT AS year, n_name AS entity, n_regionkey AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ratings AS (SELECT entity, year, p_brand AS indicator, l_suppkey AS coder, max(trunc(l_quantity)::INT % 5) AS rating FROM lineitem JOIN orders_ ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
entity_year0 AS (SELECT entity, year, any_value(region) AS region, round(avg(o_totalprice) / 400000, 4) AS covariate, any_value({_u('ep', 'entity', 'year')}) AS h FROM orders_ GROUP BY entity, year),
entity_year1 AS (SELECT *, CASE WHEN h % 7 <> 0 THEN (h % 5 = 0)::INT END AS dem_ep, ntile(5) OVER (PARTITION BY year ORDER BY covariate, entity)::INT AS quintile FROM entity_year0),
entity_year AS (SELECT entity, year, region, covariate, dem_ep, CASE WHEN dem_ep = 1 THEN (h // 5 % 2)::INT ELSE 0 END AS onset, quintile, least(quintile - 1, 3)::INT AS regime FROM entity_year1),
means0 AS (SELECT entity, year, indicator, avg(rating) AS raw_mean, count(*) AS n_coders FROM ratings GROUP BY ALL),
means AS (SELECT m.*, quintile, regime FROM means0 m JOIN entity_year USING (entity, year)),
grid_ AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{c}')" for m in MODELS for c in CONDITIONS)}) g(model, condition)),
runs AS (SELECT model, condition, entity, year, indicator, (CASE WHEN h % 3 = 0 THEN h // 3 % 5 ELSE floor(raw_mean + 0.5) END)::INT AS rating FROM (SELECT *, {_u('ai', 'model', 'condition', 'entity', 'year', 'indicator')} AS h FROM means CROSS JOIN grid_)),
scored AS (SELECT r.*, raw_mean, n_coders, quintile, regime, rating - raw_mean AS signed_dev, abs(rating - raw_mean) AS abs_dev FROM runs r JOIN means USING (entity, year, indicator)),
ord_ AS (SELECT entity, year, indicator, greatest(0, least(4, floor(raw_mean + 0.5) + CASE h % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END))::INT AS ord FROM (SELECT *, {_u('ord', 'entity', 'year', 'indicator')} AS h FROM means)),
dists AS (SELECT entity, year, indicator, rating, CASE WHEN {_u('nodist', 'entity', 'year', 'indicator')} % 9 > 0 THEN list_transform(w, lambda x: x / list_sum(w)) END AS dist FROM (SELECT *, [{', '.join(f"(1 + {_u(f'dist{i}', 'entity', 'year', 'indicator')} % 9)::DOUBLE" for i in range(5))}] AS w FROM runs WHERE model = 'base' AND condition = 'codebook')),
order_ AS (SELECT entity, region, row_number() OVER (PARTITION BY region ORDER BY entity) AS j FROM (SELECT DISTINCT entity, region FROM orders_)),
tried_ AS (SELECT *, sum((k = j)::INT) OVER (PARTITION BY region, a) AS fixed FROM (SELECT *, row_number() OVER (PARTITION BY region, a ORDER BY {_u('pair', 'a', 'entity')}, entity) AS k FROM order_ CROSS JOIN range(1, 65) t(a))),
pairs AS (SELECT t.entity AS source, o.entity AS named FROM tried_ t JOIN order_ o ON o.region = t.region AND o.j = t.k WHERE t.a = (SELECT min(a) FROM tried_ f WHERE f.region = t.region AND f.fixed = 0)),
swaps AS (SELECT model, source, named, year, indicator, arm, (CASE WHEN h % 3 = 0 THEN h // 3 % 5 ELSE floor(raw_mean + 0.5) END)::INT AS rating FROM (
  SELECT *, {_u('swap', 'model', 'source', 'named', 'year', 'indicator')} AS h FROM (SELECT entity AS source, year, indicator, raw_mean FROM means)
  JOIN (SELECT source, named, 'swapped' AS arm FROM pairs UNION ALL SELECT source, source, 'correct' FROM pairs) USING (source) CROSS JOIN (SELECT DISTINCT model FROM grid_))),
log0 AS (SELECT m.entity AS iso, year, indicator, treatment, model, copy, {_u('reid', 'm.entity', 'm.year', 'indicator', 'treatment', 'model', 'copy')} AS h FROM means m
  CROSS JOIN (VALUES ('anon'), ('summ')) t(treatment) CROSS JOIN (VALUES ('{MODELS[0]}'), ('{MODELS[1]}')) mm(model) CROSS JOIN (VALUES (0), (1)) c(copy)),
places AS (SELECT entity, region, row_number() OVER (PARTITION BY region ORDER BY entity) - 1 AS slot FROM (SELECT DISTINCT entity, region FROM orders_)),
log_ AS (SELECT copy::BIGINT * 10000000000 + h AS seq, iso, year, indicator, treatment, model,
  '1. ' || CASE WHEN h // 8 % 3 = 0 THEN iso ELSE g.entity END || ' (likely)' || chr(10) || '2. ' || CASE WHEN h // 32 % 2 = 0 THEN iso ELSE 'NOWHERE' END || chr(10) || '3. NOWHERE' || chr(10) || 'Reason: ' || ['named officials', 'the electoral calendar', 'a border dispute', 'unclear'][h // 64 % 4 + 1] AS response
  FROM log0 JOIN places o ON o.entity = iso JOIN places g ON g.region = o.region AND g.slot = h % 5 WHERE copy = 0 OR h % 10 = 0),
releases AS (SELECT release, entity, year, indicator, count(*) AS n_coders, stddev_samp(rating) AS posterior_sd FROM ratings CROSS JOIN (VALUES (0), (1), (2), (3)) r(release) WHERE {_u('rel', 'coder')} % 4 <= release AND year <= 1998 + release GROUP BY release, entity, year, indicator)
"""

_LINES = "(SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"
_NL = "chr(10)"


def _sql_pick(names, k):
    return f"[{', '.join(repr(n) for n in names)}][({k}) % {len(names)} + 1]"


def _strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_part(text, target):
    """What stands under a header, in DuckDB."""
    from quorumspark.operators.texts import HEADER

    cut = f"string_split(regexp_replace({text}, '(?m){HEADER}', chr(3) || '\\1' || chr(4), 'g'), chr(3))"
    return f"nullif({_strip(f'split_part(list_filter({cut}, lambda x: starts_with(x, {target} || chr(4)))[1], chr(4), 2)')}, '')"


#: The reports and their sections for DuckDB, to stand before a query over texts.
TEXT_SQL = rf"""
reports_ AS (SELECT doc_id, source, string_agg(CASE k % 6 WHEN 3 THEN 'Section ' || (k // 6 % 7 + 1) || '. Head' || {_NL} WHEN 5 THEN ' ' || {_sql_pick('abcdefg', 'k // 6')} || '. Part' || {_NL} WHEN 4 THEN {_sql_pick(PART_NAMES, 'k // 6')} || {_NL} ELSE '' END || line, {_NL} ORDER BY k) AS text FROM {_LINES} GROUP BY ALL),
second_ AS (SELECT doc_id, (2016 + doc_id % 8)::INT AS year, string_agg(CASE WHEN k = 20 THEN '## Country Facts' || {_NL} || line WHEN k % 5 = 2 THEN '## ' || CASE WHEN k % 10 = 7 THEN 'header2 ' ELSE '' END || {_sql_pick('ABCDEFG', 'k // 5')} || ' Title' || {_NL} || line WHEN k % 5 = 4 THEN 'Score Change: moved' || {_NL} || line || {_NL} WHEN k % 7 = 6 THEN '## PR Divider' || {_NL} || line ELSE line END, {_NL} ORDER BY k) AS text FROM {_LINES} WHERE doc_id % 4 <> 1 GROUP BY ALL),
third_ AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0 AND text <> ''),
blocks_ AS (SELECT doc_id, pos, block, regexp_extract(block, '^Section\s+(\d+)\s*\.', 1) AS num FROM (SELECT doc_id, unnest(l) AS block, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(Section\s+\d+\s*\.)', chr(1) || '\1', 'g'), chr(1)) AS l FROM reports_))),
parts_ AS (SELECT doc_id, pos, sub, num || regexp_extract(part, '^ *([a-g])\.', 1) AS section, part AS text FROM (SELECT doc_id, pos, num, unnest(l) AS part, generate_subscripts(l, 1) AS sub FROM (SELECT *, string_split(regexp_replace(block, '(?m)^( *[a-g]\.[ ]?[A-Z])', chr(2) || '\1', 'g'), chr(2)) AS l FROM blocks_ WHERE num <> '')) WHERE regexp_matches(part, '^ *[a-g]\.')),
secs_ AS (SELECT doc_id, section, arg_max(text, pos * 100000 + sub) AS text FROM (SELECT doc_id, pos, 0 AS sub, CASE WHEN num <> '' THEN num ELSE 'exec_summary' END AS section, {_strip('block')} AS text FROM blocks_ WHERE num <> '' OR (pos = 1 AND NOT regexp_matches(block, '^Section\s+\d+')) UNION ALL SELECT doc_id, pos, sub, section, {_strip('text')} FROM parts_) WHERE text <> '' GROUP BY ALL),
clean_ AS (SELECT doc_id, year, {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)\n+(?:##\s+Country\s+Facts|Be the first to know).*\z', ''), '(?is)Score Change:.*?(\n\n|\z)', '\1', 'g'), '(?m)^##\s+(?:PR|CL)\s+.*$', '', 'g'), '(?mi)^(##\s+)header[123]\s+', '\1', 'g')")} AS text FROM second_),
letters_ AS (SELECT doc_id, section, arg_max(text, pos) AS text FROM (SELECT doc_id, pos, CASE WHEN letter <> '' THEN letter ELSE 'exec_summary' END AS section, {_strip('block')} AS text FROM (SELECT *, regexp_extract(block, '^## ([A-G]) ', 1) AS letter FROM (SELECT doc_id, unnest(l) AS block, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(## [A-G] )', chr(1) || '\1', 'g'), chr(1)) AS l FROM clean_))) WHERE letter <> '' OR pos = 1) WHERE text <> '' GROUP BY ALL),
found_ AS (SELECT 'first' AS source, doc_id, section, text FROM secs_ UNION ALL SELECT 'second', doc_id, section, text FROM letters_),
shelf_ AS (SELECT 'first' AS source, doc_id FROM reports_ UNION ALL SELECT 'second', doc_id FROM second_),
plan_ AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in PLAN)}) p(indicator, source, pos, section, part)),
indicators_ AS (SELECT * FROM (VALUES {', '.join(f"('{i}')" for i in INDICATORS)}) i(indicator) CROSS JOIN (VALUES ('first'), ('second')) s(source)),
flags_ AS (SELECT indicator, source, source = 'first' AND coalesce(redirects, false) AS only_redirect FROM indicators_ LEFT JOIN (SELECT indicator, source, bool_and(section = '2c') AS redirects FROM plan_ GROUP BY ALL) USING (indicator, source))
"""


def text_oracle(query: str, *more: str) -> str:
    """A DuckDB query over the reports and their sections."""
    return "WITH " + ",".join([TEXT_SQL, *more]) + query


def oracle(query: str, *more: str) -> str:
    """A DuckDB query over the derived tables."""
    return "WITH RECURSIVE " + ",".join([SQL, *more]) + query
