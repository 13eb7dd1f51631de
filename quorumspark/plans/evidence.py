"""Sections, evidence, prompts and parsed answers over reports derived from the documents."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import u
from quorumspark.operators import evidence as E
from quorumspark.operators import texts as X
from quorumspark.plans.registry import query
from quorumspark.sources.views import _NL, _strip, _u, sql_part, text_oracle

KEYS = ["doc_id"]
RULE_SQL = f"{_NL} || {_NL} || '---' || {_NL} || {_NL}"
EVIDENCE = f"""body_ AS (SELECT p.indicator, p.source, doc_id, pos, coalesce(CASE WHEN p.section = '6' AND part = 'women' THEN {sql_part('text', "'Women'")} WHEN p.section = '6' AND part = 'minorities' THEN {sql_part('text', "CASE WHEN doc_id % 8 <= 3 THEN 'National/Racial/Ethnic Minorities' WHEN doc_id % 8 = 4 THEN 'Members of National/Racial/Ethnic Minority Groups' ELSE 'Systemic Racial or Ethnic Violence and Discrimination' END")} END, text) AS text
  FROM plan_ p JOIN found_ f ON f.source = p.source AND f.section = p.section WHERE p.section <> '2c'
  UNION ALL SELECT DISTINCT indicator, 'first', doc_id, 1000000, text FROM plan_ CROSS JOIN third_ WHERE section = '2c'),
joined_ AS (SELECT indicator, source, doc_id, string_agg(text, {RULE_SQL} ORDER BY pos) AS evidence, count(*) AS n_sections FROM body_ GROUP BY ALL),
evidence_ AS (SELECT s.doc_id, f.indicator, s.source, coalesce(j.evidence, CASE WHEN NOT only_redirect THEN e.text END) AS evidence, coalesce(n_sections, 0) AS n_sections
  FROM shelf_ s JOIN flags_ f ON f.source = s.source LEFT JOIN joined_ j ON j.indicator = f.indicator AND j.source = s.source AND j.doc_id = s.doc_id LEFT JOIN (SELECT * FROM found_ WHERE section = 'exec_summary') e ON e.source = s.source AND e.doc_id = s.doc_id)"""


def texts(name, sql, *more):
    """Register a query over the reports."""
    return query(name, text_oracle(sql, *more), raw=True)


def _md5(c):
    return F.md5(F.col(c).cast("binary")).alias("digest")


@texts("j1_sections", "SELECT doc_id, section, md5(text) AS digest FROM secs_ WHERE NOT regexp_matches(section, '^\\d+[a-g]$')")
def _(v):
    return X.sections(v.reports, KEYS).where(~F.col("section").rlike(r"^\d+[a-g]$")).select("doc_id", "section", _md5("text"))


@texts("j1_subsections", "SELECT doc_id, section, md5(text) AS digest FROM secs_ WHERE regexp_matches(section, '^\\d+[a-g]$')")
def _(v):
    return X.sections(v.reports, KEYS).where(F.col("section").rlike(r"^\d+[a-g]$")).select("doc_id", "section", _md5("text"))


@texts("j2_clean_second_source", "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM clean_")
def _(v):
    rows = v.shelf.where("source = 'second'").select("doc_id", X.clean_second_source(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), _md5("text"))


@texts("j3_lettered_blocks", "SELECT doc_id, section, md5(text) AS digest FROM letters_")
def _(v):
    return X.lettered_blocks(v.shelf.where("source = 'second'"), KEYS).select("doc_id", "section", _md5("text"))


_HEADS = {"women": "'Women'", "trafficking": "'Trafficking in Persons'", "other_societal": "'Other Societal Violence or Discrimination'", "minorities": "CASE WHEN doc_id % 8 <= 3 THEN 'National/Racial/Ethnic Minorities' WHEN doc_id % 8 = 4 THEN 'Members of National/Racial/Ethnic Minority Groups' ELSE 'Systemic Racial or Ethnic Violence and Discrimination' END"}


@texts("j4_named_parts", "SELECT doc_id, key, md5(part) AS digest FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, {sql_part('text', h)} AS part FROM secs_ WHERE regexp_matches(section, '^\\d+$')" for k, h in _HEADS.items()) + ") WHERE part IS NOT NULL")
def _(v):
    rows = v.shelf.where("source = 'first'").select("doc_id", "year").join(X.sections(v.reports, KEYS).where(F.col("section").rlike(r"^\d+$")), "doc_id")
    rows = rows.withColumn("key", F.explode(F.array(*map(F.lit, _HEADS)))).withColumn("part", X.named_part(F.col("text"), X.part_header(F.col("key"), F.col("year"))))
    return rows.where("part IS NOT NULL").select("doc_id", "key", _md5("part"))


@texts("j5_evidence", "SELECT doc_id, indicator, source, n_sections, md5(evidence) AS digest FROM evidence_ WHERE evidence IS NOT NULL", EVIDENCE)
def _(v):
    return E.evidence(v.shelf, v.indicators, v.plan, KEYS + ["year"]).select("doc_id", "indicator", "source", "n_sections", _md5("evidence"))


@texts("j6_missing_sections", """SELECT g.doc_id, g.indicator, g.source, string_agg(g.section, ',' ORDER BY pos, g.section) AS missing, coalesce(any_value(available), '') AS available
FROM (SELECT p.indicator, p.source, s.doc_id, pos, CASE WHEN section = '2c' AND p.source = 'first' THEN 'third' ELSE section END AS section FROM plan_ p JOIN shelf_ s USING (source)) g
LEFT JOIN found_ f ON f.source = g.source AND f.doc_id = g.doc_id AND f.section = g.section LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) t ON t.doc_id = g.doc_id AND g.section = 'third'
LEFT JOIN (SELECT source, doc_id, string_agg(section, ',' ORDER BY section) AS available FROM found_ WHERE section <> 'exec_summary' GROUP BY ALL) a ON a.source = g.source AND a.doc_id = g.doc_id
WHERE f.doc_id IS NULL AND t.doc_id IS NULL GROUP BY g.doc_id, g.indicator, g.source""")
def _(v):
    return E.missing_sections(v.shelf, v.plan, KEYS)


@texts("j7_plain_evidence", f"SELECT doc_id, indicator, source, count(*) AS n_sections, md5(string_agg(text, {RULE_SQL} ORDER BY pos)) AS digest FROM (SELECT indicator, source, pos, section FROM plan_ UNION ALL SELECT DISTINCT indicator, source, -1, 'exec_summary' FROM plan_) JOIN found_ USING (source, section) GROUP BY ALL")
def _(v):
    return E.plain_evidence(v.shelf, v.plan, KEYS).select("doc_id", "indicator", "source", "n_sections", _md5("evidence"))


_CUT = 2000


@texts("j8_budget", f"""SELECT doc_id, section, length(cut) AS n_chars, md5(cut) AS digest FROM (SELECT doc_id, section, CASE WHEN length(text) <= {_CUT} THEN text WHEN fits > 0 THEN {_strip("array_to_string(p[1:fits + 1], '')")} ELSE {_strip("CASE WHEN length(head) > 0 THEN head ELSE substr(text, 1, 2000) END")} END AS cut
FROM (SELECT *, len(list_filter(range(2, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) <= {_CUT})) AS fits, regexp_extract(substr(text, 1, {_CUT}), '(?s)^(.*)\\n\\n', 1) AS head
FROM (SELECT *, string_split(regexp_replace(text, '(?m){X.HEADER}', chr(3) || '\\1', 'g'), chr(3)) AS p FROM secs_)))""")
def _(v):
    rows = X.sections(v.reports, KEYS).select("doc_id", "section", X.within_budget(F.col("text"), _CUT).alias("text"))
    return rows.select("doc_id", "section", F.length("text").cast("long").alias("n_chars"), _md5("text"))


_OVER = [("the-united-states", "UNITED STATES"), ("burma", None), ("great-britain", "UNITED KINGDOM")]
_SLUG = "CASE c_custkey % 11 WHEN 0 THEN 'the-' || s WHEN 1 THEN 'burma' WHEN 2 THEN 'great-britain' WHEN 3 THEN 'island-' || c_custkey % 7 ELSE s END"


def _slugs(v):
    rows = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s, k = F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")), F.col("c_custkey") % 11
    return rows.select(F.when(k == 0, F.concat(F.lit("the-"), s)).when(k == 1, "burma").when(k == 2, "great-britain").when(k == 3, F.concat(F.lit("island-"), (F.col("c_custkey") % 7).cast("string"))).otherwise(s).alias("slug"), "c_custkey")


@query("j9_slugs", f"""WITH s AS (SELECT DISTINCT {_SLUG} AS slug FROM (SELECT c_custkey, replace(lower(n_name), ' ', '-') AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)), o AS (SELECT * FROM (VALUES ('the-united-states', 'UNITED STATES'), ('burma', NULL), ('great-britain', 'UNITED KINGDOM')) o(slug, code))
SELECT s.slug, CASE WHEN o.slug IS NOT NULL THEN o.code ELSE n_name END AS code, CASE WHEN o.slug IS NOT NULL AND o.code IS NULL THEN 'skipped' WHEN o.slug IS NOT NULL THEN 'override' WHEN n_name IS NOT NULL THEN 'name' ELSE 'unmatched' END AS status FROM s LEFT JOIN o USING (slug) LEFT JOIN nation ON lower(n_name) = replace(s.slug, '-', ' ')""", raw=True)
def _(v):
    over = v.spark.createDataFrame(_OVER, "slug string, code string")
    return E.harmonised(_slugs(v), over, v.table("nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("code")))


@query("j9_across_sources", f"SELECT c_custkey, slug, CASE WHEN slug = 'burma' THEN 'myanmar' WHEN slug LIKE 'the-%' THEN substr(slug, 5) ELSE slug END AS other_slug FROM (SELECT c_custkey, {_SLUG} AS slug FROM (SELECT c_custkey, replace(lower(n_name), ' ', '-') AS s FROM customer JOIN nation ON c_nationkey = n_nationkey))", raw=True)
def _(v):
    slugs = _slugs(v)
    articles = slugs.select("slug").distinct().where("slug LIKE 'the-%'").select("slug", F.expr("substr(slug, 5)").alias("other_slug"))
    return E.across_sources(slugs, articles.union(v.spark.createDataFrame([("burma", "myanmar")], "slug string, other_slug string"))).select("c_custkey", "slug", "other_slug")


_NAMED = "CASE WHEN source = 'first' AND section = '2c' THEN 'third' WHEN source = 'first' AND section = '6' AND part IS NOT NULL THEN '6_' || part ELSE section END"
CACHED = f"""cached_ AS (SELECT source, doc_id, section, text FROM found_ WHERE {_u('cache', 'source', 'doc_id', 'section')} % 5 > 0 UNION ALL SELECT 'first', doc_id, 'third', text FROM third_ UNION ALL SELECT 'first', doc_id, '6_women', text FROM found_ WHERE source = 'first' AND section = '6'),
held_ AS (SELECT p.indicator, p.source, doc_id, string_agg(text, {RULE_SQL} ORDER BY pos) AS text FROM (SELECT indicator, source, pos, {_NAMED} AS section FROM plan_) p JOIN cached_ USING (source, section) GROUP BY ALL),
assembled_ AS (SELECT doc_id, indicator, string_agg('*' || CASE source WHEN 'first' THEN 'State Department Human Rights Report' ELSE 'Freedom House Freedom in the World' END || '*' || {_NL} || {_NL} || text, {RULE_SQL} ORDER BY source) AS text FROM (
  SELECT coalesce(h.doc_id, e.doc_id) AS doc_id, coalesce(h.indicator, e.indicator) AS indicator, coalesce(h.source, e.source) AS source, coalesce(h.text, e.text) AS text FROM held_ h
  FULL JOIN (SELECT c.doc_id, f.indicator, c.source, c.text FROM cached_ c JOIN flags_ f ON f.source = c.source WHERE section = 'exec_summary' AND NOT only_redirect) e ON e.doc_id = h.doc_id AND e.indicator = h.indicator AND e.source = h.source) GROUP BY doc_id, indicator)"""


def _cached(v):
    found = E.parsed(v.shelf, KEYS)
    kept = found.where(u("cache", "source", "doc_id", "section") % 5 > 0)
    third = v.shelf.where("source = 'third' AND text <> ''").select(F.lit("first"), "doc_id", F.lit("third"), "text")
    return kept.union(third).union(found.where("source = 'first' AND section = '6'").select("source", "doc_id", F.lit("6_women"), "text"))


def _assembled(v):
    return E.assembled(_cached(v), v.indicators, v.plan, KEYS)


@texts("j10_section_work", f"SELECT doc_id, source, section FROM (SELECT doc_id FROM documents) CROSS JOIN (SELECT source, {_NAMED} AS section FROM plan_ UNION SELECT source, 'exec_summary' FROM plan_) ANTI JOIN cached_ USING (doc_id, source, section)", CACHED)
def _(v):
    return E.section_work(v.plan, v.table("documents"), _cached(v).select("doc_id", "source", "section"), KEYS)


@texts("j11_assembled", "SELECT doc_id, indicator, length(text) AS n_chars, md5(text) AS digest FROM assembled_", CACHED)
def _(v):
    return _assembled(v).select("doc_id", "indicator", F.length("text").cast("long").alias("n_chars"), _md5("text"))


CONDITIONS = ("codebook", "evidence", "evidence-zeroshot", "anonymized", "anonymized-zeroshot")
CATEGORIES = ("not at all", "in part", "mostly", "fully")
TASK = "Rate {FOCAL}, {YEAR}, on {INDICATOR}.\n\n{CATEGORIES}\n{CALIBRATION}{FIRST}{SECOND}\nAnswer with a number from 0 to {MAX}."
_EXAMPLES = f"""pick_ AS (SELECT indicator, lang AS entity, doc_id, (2016 + doc_id % 8)::INT AS year, {_u('mean', 'indicator', 'doc_id')} % 400 / 100.0 AS raw_mean, row_number() OVER (PARTITION BY indicator, lang ORDER BY {_u('example', 'indicator', 'doc_id')}, doc_id) AS k FROM documents CROSS JOIN (SELECT DISTINCT indicator FROM indicators_)),
examples_ AS (SELECT p.*, a.text FROM pick_ p LEFT JOIN assembled_ a USING (doc_id, indicator) WHERE k <= 2)"""


def _examples(v):
    """Two examples a language and indicator, in hash order; a language stands for an entity."""
    names = v.indicators.select("indicator").distinct()
    rows = v.table("documents").select("doc_id", F.col("lang").alias("entity"), (2016 + F.col("doc_id") % 8).cast("int").alias("year")).crossJoin(F.broadcast(names))
    rows = rows.withColumn("raw_mean", u("mean", "indicator", "doc_id") % 400 / 100.0).withColumn("k", F.row_number().over(W.partitionBy("indicator", "entity").orderBy(u("example", "indicator", "doc_id"), "doc_id")))
    return rows.where("k <= 2")


@texts("j19_examples_with_text", "SELECT indicator, entity, doc_id, k, text IS NULL AS missing, md5(text) AS digest FROM examples_", CACHED, _EXAMPLES)
def _(v):
    return E.with_text(_examples(v), _assembled(v), ["doc_id", "indicator"]).select("indicator", "entity", "doc_id", "k", "missing", _md5("text"))


_CATS = " || chr(10) || ".join(f"'- **{i}**: {c}'" for i, c in enumerate(CATEGORIES))
_CASES = "d.doc_id % 5"


@texts("j12_prompts", f"""SELECT doc_id, condition, length(p) AS n_chars, md5(p) AS digest FROM (
SELECT d.doc_id, c.condition, 'Rate ' || CASE WHEN hide THEN 'the focal country' ELSE lang END || ', ' || CASE WHEN hide THEN 'the focal year' ELSE (2016 + d.doc_id % 8)::VARCHAR END || ', on groups.' || {_NL} || {_NL} || {_CATS} || {_NL}
 || CASE WHEN shots THEN '## Calibration' || {_NL} || {_NL} || (SELECT string_agg('**Example ' || i || CASE WHEN hide THEN '' ELSE ' — ' || entity || ', ' || year END || '** (Panel mean: ' || printf('%.2f', raw_mean) || ')' || {_NL} || {_NL} || text, {RULE_SQL} ORDER BY i) FROM (SELECT *, row_number() OVER (ORDER BY entity, k) AS i FROM examples_ x WHERE x.indicator = 'groups' AND x.entity <> d.lang AND x.text IS NOT NULL)) || {_NL} ELSE '' END
 || CASE WHEN c.condition = 'codebook' THEN '' WHEN hide THEN coalesce(a.text, '[no text]') || {_NL} ELSE coalesce(f.evidence, '[no text]') || {_NL} || coalesce(s.evidence, '[no text]') || {_NL} END || {_NL} || 'Answer with a number from 0 to 3.' AS p
FROM documents d JOIN (VALUES (0, 'codebook', false, false), (1, 'evidence', true, false), (2, 'evidence-zeroshot', false, false), (3, 'anonymized', true, true), (4, 'anonymized-zeroshot', false, true)) c(n, condition, shots, hide) ON c.n = {_CASES}
LEFT JOIN assembled_ a ON a.doc_id = d.doc_id AND a.indicator = 'groups' LEFT JOIN evidence_ f ON f.doc_id = d.doc_id AND f.indicator = 'groups' AND f.source = 'first' LEFT JOIN evidence_ s ON s.doc_id = d.doc_id AND s.indicator = 'groups' AND s.source = 'second')""", EVIDENCE, CACHED, _EXAMPLES)
def _(v):
    mine = F.col("indicator") == "groups"
    indicators, plan = v.indicators.where(mine), v.plan.where(mine)
    kept = E.assembled(_cached(v), indicators, plan, KEYS)
    found = E.with_text(_examples(v).where(mine), kept, ["doc_id", "indicator"]).where("NOT missing")
    # a few examples of one indicator: every prompt has the same ones
    shots = found.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("entity", "k", "year", F.col("raw_mean").cast("double").alias("raw_mean"), "text"))), lambda x: x.dropFields("k")).alias("examples"))
    both = E.evidence(v.shelf, indicators, plan, KEYS + ["year"]).groupBy("doc_id").agg(*(F.max(F.when(F.col("source") == s, F.col("evidence"))).alias(s) for s in ("first", "second")))
    rows = v.table("documents").select("doc_id", "lang", (2016 + F.col("doc_id") % 8).cast("string").alias("year"), F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("condition"))
    rows = rows.join(both, "doc_id", "left").join(kept.select("doc_id", F.col("text").alias("kept")), "doc_id", "left").crossJoin(F.broadcast(shots))
    hide, shown = F.col("condition").startswith("anonymized"), F.col("condition").isin("evidence", "anonymized")
    none = F.lit("[no text]")
    evidence = lambda c: F.concat(F.coalesce(c, none), F.lit("\n"))
    text = X.prompt(
        TASK,
        FOCAL=F.when(hide, "the focal country").otherwise(F.col("lang")),
        YEAR=F.when(hide, "the focal year").otherwise(F.col("year")),
        INDICATOR=F.lit("groups"),
        CATEGORIES=X.numbered(F.array(*map(F.lit, CATEGORIES))),
        MAX=F.lit(str(len(CATEGORIES) - 1)),
        CALIBRATION=F.when(shown, F.concat(F.lit("## Calibration\n\n"), X.few_shot_block(F.col("examples"), F.col("lang"), ~hide), F.lit("\n"))),
        FIRST=F.when(F.col("condition") == "codebook", "").when(hide, evidence(F.col("kept"))).otherwise(evidence(F.col("first"))),
        SECOND=F.when(hide | (F.col("condition") == "codebook"), "").otherwise(evidence(F.col("second"))),
    )
    return rows.select("doc_id", "condition", text.alias("p")).select("doc_id", "condition", F.length("p").cast("long").alias("n_chars"), _md5("p"))


@texts("j17_available", "SELECT doc_id, indicator FROM (SELECT DISTINCT doc_id FROM second_) CROSS JOIN (SELECT indicator, bool_or(source = 'first' AND section <> '2c') AS f, bool_or(source = 'first' AND section = '2c') AS t FROM indicators_ LEFT JOIN plan_ USING (indicator, source) GROUP BY indicator) WHERE (NOT coalesce(f, false) OR doc_id IN (SELECT doc_id FROM reports_)) AND (NOT coalesce(t, false) OR doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL))")
def _(v):
    return E.available(v.shelf, v.plan, v.indicators, KEYS)


# training records: the assembled text of a document and indicator, rated by some coders
_RECORDS = f"""records_ AS (SELECT doc_id, indicator, coder, a.text FROM (SELECT doc_id, indicator, unnest(range(0, {_u('coders', 'doc_id', 'indicator')} % 4)) AS coder FROM documents CROSS JOIN (SELECT DISTINCT indicator FROM indicators_)) LEFT JOIN assembled_ a USING (doc_id, indicator))"""


def _coded(v):
    """(doc_id, indicator, coder): which coders rate which document."""
    names = v.indicators.select("indicator").distinct()
    rows = v.table("documents").select("doc_id").crossJoin(F.broadcast(names)).withColumn("n", u("coders", "doc_id", "indicator") % 4).where("n > 0")
    return rows.select("doc_id", "indicator", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("coder"))


def _records(v, **of):
    """Ratings with what is asked of their texts, null where there is none: it is made before the join, so texts are not shuffled for it."""
    made = _assembled(v).select("doc_id", "indicator", *(c.alias(n) for n, c in of.items()))
    return _coded(v).join(made, ["doc_id", "indicator"], "left")


def _rated_texts(v):
    """(doc_id, indicator, coder, text) of ratings that have a text: a document's ratings come to its texts, which stay where they were put together."""
    given = _coded(v).groupBy("doc_id").agg(F.collect_list(F.struct("indicator", "coder")).alias("given"))
    both = _assembled(v).join(given.hint("shuffle_hash"), "doc_id")
    return both.select("doc_id", "indicator", "text", F.explode(F.filter("given", lambda x: x.indicator == F.col("indicator"))).alias("x")).select("doc_id", "indicator", "x.coder", "text")


_ASK = "Rate the text from 0 to 4."
_RATED = f"({_u('coder_rating', 'doc_id', 'indicator', 'coder')} % 5)"


@texts("j13_rating_records", f"SELECT doc_id, indicator, coder, 3::BIGINT AS n_messages, 'system>user>assistant' AS roles, md5('{_ASK}' || chr(10) || text) AS asked, '{{\"rating\": ' || {_RATED}::VARCHAR || '}}' AS answer FROM records_ WHERE text IS NOT NULL", CACHED, _RECORDS)
def _(v):
    records = E.training_records(_rated_texts(v), F.lit("You rate texts."), F.concat(F.lit(_ASK + "\n"), F.col("text")), u("coder_rating", "doc_id", "indicator", "coder") % 5, "text", ["doc_id", "indicator", "coder"])
    m = lambda i: F.col("messages")[i]["content"]
    return records.select("doc_id", "indicator", "coder", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda x: x.role), ">").alias("roles"), F.md5(m(1)).alias("asked"), m(2).alias("answer"))


@texts("j14_training_cells", "SELECT indicator, count(*) FILTER (text IS NOT NULL) AS written, count(*) FILTER (text IS NULL) AS skipped, count(DISTINCT doc_id) FILTER (text IS NOT NULL) AS cells FROM records_ GROUP BY indicator", CACHED, _RECORDS)
def _(v):
    has = F.col("has").isNotNull()
    return _records(v, has=F.col("text").isNotNull()).groupBy("indicator").agg(F.count_if(has).alias("written"), F.count_if(~has).alias("skipped"), F.count_distinct(F.when(has, F.col("doc_id"))).alias("cells"))


@texts("j14_char_lengths", "SELECT indicator, n, a[1] AS min, " + ", ".join(f"a[j{p}] + (a[j{p} + 1] - a[j{p}]) * ({p} * (n + 1) / 100.0 - j{p})::DOUBLE AS p{p}" for p in (50, 90, 95, 99)) + ", a[n] AS max FROM (SELECT *, " + ", ".join(f"greatest(1, least(n - 1, {p} * (n + 1) // 100)) AS j{p}" for p in (50, 90, 95, 99)) + " FROM (SELECT indicator, count(*) AS n, list_sort(list(length(text))) AS a FROM records_ WHERE text IS NOT NULL GROUP BY indicator))", CACHED, _RECORDS)
def _(v):
    rows = _records(v, n_chars=F.length("text").cast("long")).where("n_chars IS NOT NULL")
    return X.char_percentiles(rows, "n_chars", ["indicator"])


@texts("j23_over_length", "SELECT doc_id, indicator FROM (SELECT doc_id, indicator, text FROM evidence_ JOIN (SELECT doc_id, indicator, evidence AS text, source AS s FROM evidence_) USING (doc_id, indicator) WHERE source = 'first' AND s = 'first' AND length(text) // 4 > 400 UNION ALL SELECT doc_id, indicator, evidence FROM evidence_ WHERE source = 'second' AND length(evidence) // 4 > 300 UNION ALL SELECT doc_id, indicator, text FROM assembled_ WHERE length(text) // 4 > 500) GROUP BY ALL".replace("SELECT doc_id, indicator, text FROM evidence_ JOIN (SELECT doc_id, indicator, evidence AS text, source AS s FROM evidence_) USING (doc_id, indicator) WHERE source = 'first' AND s = 'first' AND length(text) // 4 > 400", "SELECT doc_id, indicator, evidence AS text FROM evidence_ WHERE source = 'first' AND length(evidence) // 4 > 400").replace("GROUP BY ALL", "GROUP BY doc_id, indicator"), EVIDENCE, CACHED)
def _(v):
    e = E.evidence(v.shelf, v.indicators, v.plan, KEYS + ["year"]).withColumnRenamed("evidence", "text")
    return X.over_length([e.where("source = 'first'"), e.where("source = 'second'"), _assembled(v)], ["doc_id", "indicator"], "text", [400, 300, 500])


@texts("j24_canonical", "SELECT doc_id, indicator, coder, md5(text) AS digest FROM records_ WHERE text IS NOT NULL", CACHED, _RECORDS)
def _(v):
    return X.canonical(_records(v, digest=_md5("text")).where("digest IS NOT NULL").select("doc_id", "indicator", "coder", "digest"), ["doc_id", "indicator", "coder"])


_ANSWERS = {
    0: "'```json' || chr(10) || '{\"rating\": ' || d || ', \"justification\": \"as said\"}' || chr(10) || '```'",
    1: "'I would say \"rating\": ' || d || ' because'",
    2: "'{\"rating\": ' || d || ', \"justification\": \"so\"}'",
    3: "'no answer'",
    4: "'{\"rating\": ' || d || '}'",
    5: "'rating: ' || d || '2'",
    6: "'  {\"justification\": \"x\", \"rating\": \"' || d || '\"} '",
}
_PARSED = r"""answers_ AS (SELECT event_id, CASE event_id % 7 {cases} END AS t FROM (SELECT event_id, (event_id // 7 % 9)::VARCHAR AS d FROM events)),
bare_ AS (SELECT event_id, t, trim(regexp_replace(regexp_replace(trim(t), '(?m)^```(?:json)?\s*\n?', '', 'g'), '(?m)\n?```\s*$', '', 'g'), chr(10) || ' ') AS b FROM answers_),
rated_ AS (SELECT event_id, coalesce(CASE WHEN json_valid(b) AND json_extract(b, '$.justification') IS NOT NULL AND TRY_CAST(json_extract_string(b, '$.rating') AS INT) BETWEEN 0 AND 4 THEN json_extract_string(b, '$.rating')::INT END, TRY_CAST(nullif(regexp_extract(t, '(?i)"?rating"?\s*[":=]\s*([0-4])', 1), '') AS INT)) AS rating FROM bare_)""".replace("{cases}", " ".join(f"WHEN {k} THEN {x}" for k, x in _ANSWERS.items()))


@query("j27_parsed_ratings", "WITH " + _PARSED + " SELECT event_id, rating FROM rated_", raw=True)
def _(v):
    d = (F.floor(F.col("event_id") / 7) % 9).cast("string")
    kinds = [["```json\n{\"rating\": ", ", \"justification\": \"as said\"}\n```"], ["I would say \"rating\": ", " because"], ["{\"rating\": ", ", \"justification\": \"so\"}"], None, ["{\"rating\": ", "}"], ["rating: ", "2"], ["  {\"justification\": \"x\", \"rating\": \"", "\"} "]]
    text = F.lit("no answer")
    for k, kind in enumerate(kinds):
        if kind:
            text = F.when(F.col("event_id") % 7 == k, F.concat(F.lit(kind[0]), d, F.lit(kind[1]))).otherwise(text)
    return v.table("events").select("event_id", X.rating_of(text).alias("rating"))


@query("j29_rating_distribution", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE [""" + ", ".join(f"CASE WHEN d = {i} AND event_id % 5 <> 3 THEN round(exp(-a), 6) WHEN d = {i} THEN round(exp(-0.5), 6) WHEN (d + 1) % 7 = {i} THEN round(exp(-2 * a), 6) ELSE 0.0 END" for i in range(5)) + """] END AS dist FROM (SELECT event_id, event_id // 5 % 5 AS d, 0.1 + event_id % 9 / 10.0 AS a FROM events)""", raw=True)
def _(v):
    e, d = F.col("event_id"), F.floor(F.col("event_id") / 5) % 5
    a = F.lit(0.1) + e % 9 / 10.0
    digit = lambda x: x.cast("string")
    alt = lambda t, p: F.struct(t.alias("token"), p.alias("logprob"))
    tok = lambda t, *alts: F.struct(t.alias("token"), F.lit(-0.5).alias("logprob"), (F.array(*alts) if alts else F.array().cast("array<struct<token: string, logprob: double>>")).alias("alternatives"))
    more = [alt(digit((d + 1) % 7), -2 * a), alt(F.lit("x"), F.lit(-1.0))]
    value = F.when(e % 5 == 3, tok(F.concat(F.lit(" "), digit(d)), *more)).otherwise(tok(F.concat(F.lit(" "), digit(d)), alt(digit(d), -a), *more, alt(digit(d), F.lit(-3.0))))
    key = F.when(e % 5 == 4, F.array(tok(F.lit('{"score')), tok(F.lit('"')))).when(e % 2 == 0, F.array(tok(F.lit('{"rat')), tok(F.lit('ing"')))).otherwise(F.array(tok(F.lit("{3 ")), tok(F.lit('"rating"'))))
    tokens = F.concat(key, F.array(tok(F.lit(":")), value, tok(F.lit(", 2"))))
    return v.table("events").select("event_id", X.token_distribution(tokens).alias("dist"))
