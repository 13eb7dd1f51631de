"""Evidence texts from shelves of reports, by indicator, and what is made of them.

A shelf is a table (source, *keys, text) with one report a source and key: `first` is numbered (sections 1, 1a, ...), `second` lettered (A..G), and `third`
stands for section 2c of the first, which only refers to it. A plan is a table (indicator, source, pos, section, part): which sections an indicator
reads of a source, in order; part names a part of section 6. `indicators` lists all (indicator, source), also those without a section. Plans are configuration: they go to every task, and Spark decides by their size elsewhere.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumspark.operators.texts import RULE, lettered_blocks, named_part, part_header, sections

#: Sections of this number refer to the third source.
REDIRECT = "2c"
#: What a source is called in an assembled text.
LABELS = {"first": "State Department Human Rights Report", "second": "Freedom House Freedom in the World"}


def parsed(shelf: DataFrame, keys: list[str]) -> DataFrame:
    """(source, *keys, section, text) of the first two sources' reports."""
    one = lambda s: shelf.where(F.col("source") == s)
    first, second = sections(one("first"), keys), lettered_blocks(one("second"), keys)
    return first.select(F.lit("first").alias("source"), *keys, "section", "text").union(second.select(F.lit("second"), *keys, "section", "text"))


def _joined(rows, by):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)
    return rows.groupBy(*by).agg(F.array_join(parts, RULE).alias("evidence"), F.count("*").alias("n_sections"))


def _plans(indicators, plan):
    """(indicator, source, only_redirect) of every indicator and source."""
    flags = plan.groupBy("indicator", "source").agg((F.min((F.col("section") == REDIRECT).cast("int")) == 1).alias("only"))
    return indicators.join(flags, ["indicator", "source"], "left").select("indicator", "source", (F.coalesce("only", F.lit(False)) & (F.col("source") == "first")).alias("only_redirect"))


def _by_key(sections: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, _all array<struct<source, section, text>>): the sections that are needed (source, section), one row a key. The only place where texts are shuffled; they are dealt before they are collected, so that tasks sort their part and no more."""
    rows = sections.join(F.broadcast(needed.distinct()), ["source", "section"], "left_semi")
    return rows.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("source", "section", "text")).alias("_all"))


def _of(source, section):
    return F.filter("_all", lambda x: (x.source == source) & (x.section == section))


def _items(plan: DataFrame, *cols) -> DataFrame:
    """(indicator, source, items array<struct<pos, ...>>): what a plan reads, a row an indicator and source."""
    return plan.groupBy("indicator", "source").agg(F.collect_list(F.struct("pos", *cols)).alias("items"))


def _found(items, text):
    """array<struct<pos, text>>, in order, of the sections that are items of a source; `text` makes the text of a section for an item."""
    hits = F.flatten(F.transform(items, lambda i: F.transform(_of(i.source, i.section), lambda x: F.struct(i.pos.alias("pos"), text(i, x).alias("text")))))
    return F.sort_array(hits)


def _in_order(hits):
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda x: x.text), RULE))


def evidence(shelf: DataFrame, indicators: DataFrame, plan: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """(*keys, indicator, source, evidence, n_sections) for every report and indicator with some text.

    Sections in the order of the plan, RULE between them; a redirected section brings the third source's text, last; of section 6 only the part that the plan names, or
    all of it where the report has no such part. A report with none of its sections gives its summary, but not where the plan only redirects.

    The sections that the plan needs meet in one row a key, once; texts of indicators are put together there. Plans and indicators go to every task.
    """
    moved = (F.col("section") == REDIRECT) & (F.col("source") == "first")
    # the third source's text is one more section of the first, and its report a section without a text
    third = shelf.where("source = 'third' AND text <> ''").select(F.lit("first").alias("source"), *keys, F.lit("third").alias("section"), "text")
    reports = shelf.where("source = 'first'").select("source", *keys, F.lit("report").alias("section"), F.lit(None).cast("string").alias("text"))
    names = plan.where(F.col("section") != REDIRECT).select("source", "section").union(plan.select("source", F.lit("exec_summary"))).union(indicators.select("source", F.lit("exec_summary")))
    names = names.union(plan.where(moved).select("source", F.lit("third"))).union(plan.where(moved).select("source", F.lit("report")))
    rows = _by_key(parsed(shelf, keys).union(third).union(reports), names, keys)
    body = plan.where(F.col("section") != REDIRECT).select("indicator", "source", "pos", "section", "part")
    body = body.union(plan.where(moved).select("indicator", "source", F.lit(1 << 30), F.lit("third"), F.lit(None).cast("string")).distinct())
    wanted = _plans(indicators, plan).join(_items(body, "source", "section", "part"), ["indicator", "source"], "left")

    def text(i, x):
        part = F.when((i.section == "6") & i.part.isNotNull(), named_part(x.text, part_header(i.part, F.col(year))))
        return F.coalesce(part, x.text)

    some = F.filter(F.coalesce("items", F.array()), lambda i: (i.section != "third") | (F.size(_of("first", "report")) > 0))
    each = rows.crossJoin(F.broadcast(wanted))
    # exploded, so that what follows reads a text that is made once
    each = each.select(*keys, "indicator", "source", "only_redirect", F.get(_of(F.col("source"), "exec_summary"), 0).text.alias("_summary"), F.explode(F.array(_found(some, text))).alias("_hits"))
    whole = F.coalesce(_in_order(F.col("_hits")), F.when(~F.col("only_redirect"), F.col("_summary")))
    return each.select(*keys, "indicator", "source", F.explode(F.array(whole)).alias("evidence"), F.size("_hits").cast("long").alias("n_sections")).where("evidence IS NOT NULL")


def plain_evidence(shelf: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, indicator, source, evidence, n_sections): the summary first where there is one, then the plan's sections as they are."""
    found = parsed(shelf, keys)
    each = plan.select("indicator", "source", "pos", "section").union(plan.select("indicator", "source", F.lit(-1), F.lit("exec_summary")).distinct())
    return _joined(each.join(found, ["source", "section"]), [*keys, "indicator", "source"])


def missing_sections(shelf: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, indicator, source, missing, available): sections of the plan that a report does not have, and those that it has; a missing third report is named third."""
    found = parsed(shelf, keys)
    have = found.where("section <> 'exec_summary'").groupBy("source", *keys).agg(F.array_join(F.sort_array(F.collect_set("section")), ",").alias("available"))
    reports = shelf.where("source <> 'third'").select("source", *keys)
    wanted = reports.join(plan.select("source", "indicator", "pos", "section"), "source")
    redirected = (F.col("section") == REDIRECT) & (F.col("source") == "first")
    gone = wanted.where(~redirected).join(found.select("source", *keys, "section"), ["source", *keys, "section"], "left_anti")
    third = wanted.where(redirected).join(shelf.where("source = 'third'").select(*keys), keys, "left_anti").withColumn("section", F.lit("third"))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "section"))), lambda x: x.section), ",")
    out = gone.unionByName(third).groupBy("source", *keys, "indicator").agg(names.alias("missing"))
    return out.join(have, ["source", *keys], "left").select(*keys, "indicator", "source", "missing", F.coalesce("available", F.lit("")).alias("available"))


def cache_name(section, part):
    """The name under which a section of the plan is kept when it is rewritten: third for the redirect, 6_<part> for a part."""
    return F.when(section == REDIRECT, "third").when((section == "6") & part.isNotNull(), F.concat(F.lit("6_"), part)).otherwise(section)


def section_work(plan: DataFrame, reports: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, source, section): each rewritten section that some indicator needs, once, with every source's summary, for every report key, less those in `done`."""
    of_first = F.col("source") == "first"
    name = F.when(of_first, cache_name(F.col("section"), F.col("part"))).otherwise(F.col("section"))
    needed = plan.select("source", name.alias("section")).union(plan.select("source", F.lit("exec_summary"))).distinct()
    return reports.select(*keys).distinct().crossJoin(needed).join(done, [*keys, "source", "section"], "left_anti")


def assembled(cached: DataFrame, indicators: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, indicator, text): one text from kept sections (source, *keys, section, text): each source's label and sections, summaries by the rule of `evidence`; nothing kept, no row. Kept sections that the plan needs meet in one row a key, once."""
    of_first = F.col("source") == "first"
    name = F.when(of_first, cache_name(F.col("section"), F.col("part"))).otherwise(F.col("section"))
    body = plan.select("indicator", "source", "pos", name.alias("section"))
    names = body.select("source", "section").union(indicators.select("source", F.lit("exec_summary")))
    summary = _plans(indicators, plan).select("indicator", "source", (~F.col("only_redirect")).alias("summary"))
    wanted = _items(body, "source", "section").join(summary, ["indicator", "source"], "full_outer")
    wanted = wanted.groupBy("indicator").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("items", F.array()).alias("items"), F.coalesce("summary", F.lit(False)).alias("summary")))).alias("wanted"))
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def of_source(w):
        own = F.coalesce(_in_order(_found(w["items"], lambda i, x: x.text)), F.when(w.summary, F.get(_of(w.source, "exec_summary"), 0).text))
        return F.concat(F.lit("*"), F.try_element_at(label, w.source), F.lit("*\n\n"), own)

    each = _by_key(cached, names, keys).crossJoin(F.broadcast(wanted))
    # exploded, so that what follows reads a text that is made once
    each = each.select(*keys, "indicator", F.explode(F.array(F.filter(F.transform("wanted", of_source), lambda x: x.isNotNull()))).alias("_texts"))
    return each.where(F.size("_texts") > 0).select(*keys, "indicator", F.explode(F.array(F.array_join("_texts", RULE))).alias("text"))


def available(shelf: DataFrame, plan: DataFrame, indicators: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, indicator) with all documents: always the second source's, the first's where the plan has a section that is not redirected, the third's where it has one that is."""
    need = indicators.select("indicator").distinct().join(plan.where("source = 'first'").groupBy("indicator").agg(F.max((F.col("section") != REDIRECT).cast("int")).alias("first"), F.max((F.col("section") == REDIRECT).cast("int")).alias("third")), "indicator", "left")
    has = shelf.groupBy(*keys).agg(*(F.max((F.col("source") == s).cast("int")).alias(f"has_{s}") for s in ("first", "second", "third")))
    rows = has.where("has_second = 1").crossJoin(need)
    return rows.where("has_first >= coalesce(first, 0) AND has_third >= coalesce(third, 0)").select(*keys, "indicator")


def with_text(examples: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Examples (a few, which go to every task) with their text, and `missing` where none is kept."""
    own = texts.join(F.broadcast(examples.select(*keys).distinct()), keys, "left_semi")
    return examples.join(own, keys, "left").withColumn("missing", F.col("text").isNull())


def harmonised(slugs: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, code, status) of distinct slugs: an override's code (a null code skips the slug), else that of the name which the slug spells, else unmatched.

    overrides: (slug, code); names: (name, code). Both are dimensions; Spark decides by their size how they are joined.
    """
    name = F.lower(F.replace(F.col("slug"), F.lit("-"), F.lit(" ")))
    rows = slugs.select("slug").distinct().join(overrides.select("slug", F.col("code").alias("_o"), F.lit(True).alias("_over")), "slug", "left")
    rows = rows.withColumn("_name", name).join(names.select(F.lower("name").alias("_name"), F.col("code").alias("_n")), "_name", "left")
    over = F.col("_over").isNotNull()
    status = F.when(over & F.col("_o").isNull(), "skipped").when(over, "override").when(F.col("_n").isNotNull(), "name").otherwise("unmatched")
    return rows.select("slug", F.when(over, F.col("_o")).otherwise(F.col("_n")).alias("code"), status.alias("status"))


def across_sources(rows: DataFrame, renamed: DataFrame, slug: str = "slug") -> DataFrame:
    """`rows` with `other_slug`: the slug that the second source has for it, the same one where `renamed` (slug, other_slug) does not name it."""
    return rows.join(renamed, slug, "left").withColumn("other_slug", F.coalesce("other_slug", slug))


def training_records(ratings: DataFrame, system: Column, user: Column, rating: Column, text: str, case: list[str]) -> DataFrame:
    """(*case, messages array<struct<role, content>>): one record for each coder's rating whose cell has a text; the others are skipped. The answer is the rating as a JSON object."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    answer = F.concat(F.lit('{"rating": '), rating.cast("string"), F.lit("}"))
    return ratings.where(F.col(text).isNotNull()).select(*case, F.array(said("system", system), said("user", user), said("assistant", answer)).alias("messages"))
