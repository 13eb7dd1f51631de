"""Sectioned reports, evidence, prompts, parsed answers, and samples of training records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumspark.functions.core import u
from quorumspark.functions.tables import PickExamples
from quorumspark.operators.select import mark_smallest
from quorumspark.sources.views import kept


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What begins a numbered section, a lettered part and a block of the second source; what ends its text or is no part of it.
SECTION = r"^Section\s+(\d+)\s*\."
LETTER = r"^ *([a-g])\.[ ]?[A-Z]"
BLOCK = r"^## ([A-G]) "
SIDEBAR = r"\n+(?:##\s+Country\s+Facts|Be the first to know).*\z"
SCORE_CHANGE = r"Score Change:.*?(\n\n|\z)"
DIVIDER = r"^##\s+(?:PR|CL)\s+.*$"
ARTEFACT = r"^(##\s+)header[123]\s+"
#: The headers of the parts of section 6 over the years.
HEADERS = (
    "Women",
    "Children",
    "Anti-Semitism",
    "Antisemitism",
    "Trafficking in Persons",
    "Organ Harvesting",
    "Forced Organ Harvesting",
    "Persons with Disabilities",
    "National/Racial/Ethnic Minorities",
    "Members of National/Racial/Ethnic Minority Groups",
    "Systemic Racial or Ethnic Violence and Discrimination",
    "Indigenous People",
    "Indigenous Peoples",
    "HIV and AIDS Social Stigma",
    "Other Societal Violence or Discrimination",
    "Promotion of Acts of Discrimination",
    "Discrimination and Societal Abuses",
    "Discrimination, Societal Abuses, and Trafficking in Persons",
)
HEADER = "^(" + "|".join(HEADERS) + ")$"
#: The header that a key stands for; that of minorities changed in 2020 and again in 2021.
PARTS = {"women": "Women", "trafficking": "Trafficking in Persons", "other_societal": "Other Societal Violence or Discrimination"}
MINORITIES = ("National/Racial/Ethnic Minorities", "Members of National/Racial/Ethnic Minority Groups", "Systemic Racial or Ethnic Violence and Discrimination")


def _ahead(pattern: str) -> str:
    """A pattern as a place to split before; only a line feed ends a line."""
    return f"(?md)^(?={pattern.removeprefix('^')})"


def _last_named(rows: DataFrame, keys: list[str], pieces: Column) -> DataFrame:
    """(keys..., section, text) of pieces array<struct<section, text>>, without those that have no section or no text; of several with one section the last. Pieces are cut once, as a column of their own."""
    some = F.filter(F.transform(pieces, lambda x: F.struct(x.section.alias("section"), stripped(x.text).alias("text"))), lambda x: x.section.isNotNull() & (x.text != ""))
    cut = rows.select(*keys, some.alias("_some"))
    last = F.transform(F.array_distinct(F.col("_some.section")), lambda name: F.element_at(F.filter("_some", lambda x: x.section == name), -1))
    return cut.select(*keys, F.explode(last).alias("x")).select(*keys, "x.section", "x.text")


def sections(reports: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., section, text) of numbered reports, one a key: whole sections (1, 2, ...), their lettered parts (1a, 2c), and exec_summary, what stands before the first section.

    Headers stay in the text. A letter counts at a line's start (indented or not) before a capital. Of a repeated section or part the last wins. Each report is cut where it lies; texts are not shuffled.
    """

    def cut(block, pos):
        number = F.regexp_extract(block, SECTION, 1)
        own = F.when(number != "", number).when((pos == 0) & ~block.rlike(r"^Section\s+\d+"), "exec_summary")
        parts = F.filter(F.split(block, _ahead(LETTER)), lambda x: (number != "") & (F.regexp_extract(x, r"^ *([a-g])\.", 1) != ""))
        lettered = F.transform(parts, lambda x: F.struct(F.concat(number, F.regexp_extract(x, r"^ *([a-g])\.", 1)).alias("section"), x.alias("text")))
        return F.concat(F.array(F.struct(own.alias("section"), block.alias("text"))), lettered)

    pieces = F.flatten(F.transform(F.split(F.col(text), _ahead(SECTION)), cut))
    return _last_named(reports, keys, pieces)


def clean_second_source(c: Column) -> Column:
    """Cut at the sidebar, without score-change paragraphs, divider headings and the artefacts of headings."""
    c = F.regexp_replace(c, "(?is)" + SIDEBAR, "")
    c = F.regexp_replace(c, "(?is)" + SCORE_CHANGE, "$1")
    c = F.regexp_replace(c, "(?md)" + DIVIDER, "")
    return stripped(F.regexp_replace(c, "(?mdi)" + ARTEFACT, "$1"))


def lettered_blocks(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., section, text): blocks A-G of the second source with their headings, and exec_summary, what stands before the first."""


    def named(part, pos):
        letter = F.regexp_extract(part, BLOCK, 1)
        return F.struct(F.when(letter != "", letter).when(pos == 0, "exec_summary").alias("section"), part.alias("text"))

    pieces = F.transform(F.split(clean_second_source(F.col(text)), _ahead(BLOCK)), named)
    return _last_named(rows, keys, pieces)


def part_header(key: Column, year: Column) -> Column:
    """The header that a part of section 6 has in a year's reports."""
    old, middle, new = MINORITIES
    named = F.create_map(*(F.lit(x) for pair in PARTS.items() for x in pair))
    return F.when(key == "minorities", F.when(year <= 2019, old).when(year == 2020, middle).otherwise(new)).otherwise(F.try_element_at(named, key))


#: A character that no report has; it marks where headers begin.
_MARK = "\x03"


def _headed(text: Column) -> Column:
    """A text cut before each line that is a header; the first element is what stands before them all."""
    return F.split(F.regexp_replace(text, "(?md)" + HEADER, f"{_MARK}$1"), _MARK, -1)


def named_part(text: Column, header: Column) -> Column:
    """What stands under a header that fills a line, up to the next one; null if there is none, or nothing."""
    found = F.filter(F.slice(_headed(text), 2, 1 << 30), lambda p: F.regexp_extract(p, r"^([^\n]*)", 1) == header)
    return F.nullif(stripped(F.regexp_replace(F.get(found, 0), r"^[^\n]*", "")), F.lit(""))


def within_budget(text: Column, budget: int = 28_000) -> Column:
    """A text that is too long, cut after the last part of section 6 that fits; where none does, at its last blank line before the budget."""
    parts = _headed(text)
    grown = F.aggregate(F.slice(parts, 2, 1 << 30), F.struct(F.get(parts, 0).alias("t"), F.lit(False).alias("full"), F.lit(0).alias("n")), lambda s, p: F.struct(
        F.when(s.full | (F.length(s.t) + F.length(p) > budget), s.t).otherwise(F.concat(s.t, p)).alias("t"),
        (s.full | (F.length(s.t) + F.length(p) > budget)).alias("full"),
        (s.n + F.when(s.full | (F.length(s.t) + F.length(p) > budget), 0).otherwise(1)).alias("n")))
    head = F.substring(text, 1, budget)
    last = F.length(F.regexp_extract(head, r"(?s)^(.*)\n\n", 1))
    cut = stripped(F.when(last > 0, F.substring(head, F.lit(1), last)).otherwise(head))
    return F.when(F.length(text) <= budget, text).when(grown.n > 0, stripped(grown.t)).otherwise(cut)


def prompt(template: str, **values: Column) -> Column:
    """{NAME} placeholders of a template by columns."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def numbered(categories: Column) -> Column:
    """Categories as a list from 0 on."""
    return F.array_join(F.transform(categories, lambda c, i: F.concat(F.lit("- **"), i.cast("string"), F.lit("**: "), c)), "\n")


#: Fixed format of an example's heading: number, entity and year where they are shown, panel mean.
HEADING = ("**Example ", " — ", ", ", "** (Panel mean: ", ")\n\n")


def few_shot_block(examples: Column, focal: Column, named: Column) -> Column:
    """Examples array<struct<entity, year, raw_mean, text>> without those of the focal entity, numbered; entity and year are in the headings only where `named` holds. None left is an error."""
    kept = F.filter(examples, lambda e: ~e.entity.eqNullSafe(focal))
    name = lambda e: F.when(named, F.concat(F.lit(HEADING[1]), e.entity, F.lit(HEADING[2]), e.year.cast("string"))).otherwise("")
    one = lambda e, i: F.concat(F.lit(HEADING[0]), (i + 1).cast("string"), name(e), F.lit(HEADING[3]), F.format_string("%.2f", e.raw_mean), F.lit(HEADING[4]), e.text)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(F.transform(kept, one), RULE)).otherwise(F.raise_error(F.lit("an indicator without examples")))


RULE = "\n\n---\n\n"


def few_shot(means: DataFrame, regions: DataFrame, available: DataFrame | None = None, levels: int = 5) -> DataFrame:
    """(indicator, level, entity, year): for each level the closest panel mean, preferring a new region and a new entity, then a new entity, then the closest.

    The choice is greedy over an indicator's few levels; candidates are cut to the best of each (indicator, level, entity) first and stream through a table function. Only cells with their documents, keys of `available`, are candidates.
    """
    if available is not None:
        means = means.join(available, [c for c in available.columns if c in means.columns], "left_semi")
    rows = means.join(regions, "entity").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("dist", F.round(F.abs(F.col("raw_mean") - F.col("level")), 9)).where(F.rint("raw_mean") == F.col("level"))
    best = rows.groupBy("indicator", "level", "region", "entity").agg(F.min(F.struct("dist", "year")).alias("b")).select("indicator", "level", "region", "entity", "b.dist", "b.year")
    return PickExamples(best.asTable())


def rating_of(response: Column, top: int = 4) -> Column:
    """A rating 0..top: from JSON (fences removed) that has a whole rating in range and a justification; else the first digit in range after the word rating; else null."""
    bare = F.regexp_replace(F.regexp_replace(stripped(response), r"(?md)^```(?:json)?\s*\n?", ""), r"(?md)\n?```\s*$", "")
    parsed = F.from_json(stripped(bare), "rating string, justification string")
    number = F.when(parsed.rating.rlike(r"^\s*[+-]?\d{1,9}(?:\.\d+)?\s*$") & parsed.justification.isNotNull(), parsed.rating.cast("double").cast("int"))
    found = F.regexp_extract(response, rf'(?i)"?rating"?\s*[":=]\s*([0-{top}])', 1)
    return F.coalesce(F.when(number.between(0, top), number), F.when(found != "", found.cast("int")))


def hygiene(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    bare = F.col(text).rlike(r"^\s*\d\s*$")
    digit = F.regexp_extract(text, r"(\d)", 1)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum((~bare).cast("long")).alias("not_bare"), F.sum((digit == "").cast("long")).alias("unparseable"))


def token_distribution(tokens: Column, top: int = 4) -> Column:
    """tokens array<struct<token, logprob, alternatives array<struct<token, logprob>>>>: probabilities of 0..top at the first token with such a digit once the text so far has "rating" in it.

    A token stands for its first ASCII digit in range; of alternatives for one digit the first counts, and the chosen token itself where none stands for its digit. Six decimals, not normalised; null without such a token.
    """
    digit = lambda t: F.regexp_extract(F.trim(t), f"([0-{top}])", 1)
    text = F.transform(tokens, lambda t: t.token)
    seen = lambda i: F.contains(F.array_join(F.slice(text, F.lit(1), i + 1), ""), F.lit('"rating"'))
    place = F.get(F.filter(F.transform(tokens, lambda t, i: F.when(seen(i) & (digit(t.token) != ""), t)), lambda t: t.isNotNull()), 0)
    p = lambda d: F.get(F.filter(place.alternatives, lambda a: (digit(a.token) == str(d)) & (F.round(F.exp(a.logprob), 6) != 0)), 0).logprob
    own = lambda d: F.when(digit(place.token) == str(d), place.logprob)
    return F.when(place.isNotNull(), F.array(*(F.coalesce(F.round(F.exp(F.coalesce(p(d), own(d))), 6), F.lit(0.0)) for d in range(top + 1))))


def lengths(rows: DataFrame, text: str, by: list[str], limits: list[int]) -> DataFrame:
    """Nearest-index percentiles of token counts (characters / 4), and how many are over each limit: from counts of each length, so a group of any size is spread over rows."""
    n = rows.groupBy(*by, F.floor(F.length(text) / 4).alias("t")).agg(F.count("*").alias("c")).where("t IS NOT NULL")
    w = W.partitionBy(*by)
    n = n.withColumn("upto", F.sum("c").over(w.orderBy("t").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col("t"))).alias(f"p{p}")
    return n.groupBy(*by).agg(F.first("n").alias("n"), *(at(p) for p in (50, 75, 90, 95, 99)), F.max("t").alias("max"), *(F.sum(F.when(F.col("t") > k, F.col("c")).otherwise(0)).alias(f"over_{k}") for k in limits))


def over_limit(rows: DataFrame, keys: list[str], text: str, limit: int) -> DataFrame:
    t = F.floor(F.length(text) / 4)
    return rows.select(*keys, t.alias("tokens"), (t - limit).alias("over_by")).where("over_by > 0")


def intersection(pools: list[DataFrame], keys: list[str], values: list[str] = ()) -> DataFrame:
    """Keys in every pool, with the first pool's `values`; a key that one pool has twice is an error. One grouping of all pools, whatever their number."""
    every = None
    for i, p in enumerate(pools):
        tagged = p.select(*keys, *(F.col(c) if i == 0 else F.lit(None).cast(p.schema[c].dataType).alias(c) for c in values), F.lit(i).alias("_pool"))
        every = tagged if every is None else every.union(tagged)
    n = lambda i: F.sum((F.col("_pool") == i).cast("int"))
    out = every.groupBy(*keys).agg(*(F.max(c).alias(c) for c in values), F.array(*map(n, range(len(pools)))).alias("_n"))
    out = out.withColumn("_n", F.when(F.array_max("_n") > 1, F.raise_error(F.lit("a key comes twice"))).otherwise(F.col("_n")))
    return out.where(F.array_min("_n") == 1).select(*keys, *values)


def budgets(pool: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, n, budget): proportional shares of `total` by largest remainder, at most n."""
    n = pool.groupBy(stratum).agg(F.count("*").alias("n"))
    every = W.partitionBy()
    n = n.withColumn("exact", F.lit(float(total)) * F.col("n") / F.sum("n").over(every)).withColumn("base", F.floor("exact"))
    n = n.withColumn("left", F.lit(total) - F.sum("base").over(every)).withColumn("k", F.row_number().over(W.partitionBy().orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), stratum)))
    return n.select(stratum, "n", F.least(F.col("n"), F.col("base") + (F.col("k") <= F.col("left")).cast("int")).alias("budget"))


def stratified(pool: DataFrame, budget: DataFrame, stratum: str, level: str, keys: list[str], floor: int = 1, seed: str = "sample") -> DataFrame:
    """`budget` rows of each stratum in hash order, `floor` of each level first; by counts of hash ranges, so no stratum is sorted."""
    cols = pool.columns
    rows = mark_smallest(kept(pool.withColumn("_h", u(seed, *keys))), [stratum, level], floor, "_h", keys, "_first")
    rows = kept(rows)
    firsts = rows.where("_first").groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_f"))
    room = budget.select(F.col(stratum).alias("_b"), "budget").join(firsts, F.col("_b").eqNullSafe(F.col("_s")), "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    room = kept(room.select(F.col("_b").alias(stratum), F.least("budget", "_f").alias("_k1"), F.greatest(F.col("budget") - F.col("_f"), F.lit(0)).alias("_k2")))
    take = lambda some, k: mark_smallest(some, [stratum], room.select(stratum, F.col(k).alias("k")), "_h", keys, "_in").where("_in").select(*cols)
    return take(rows.where("_first"), "_k1").union(take(rows.where("NOT _first"), "_k2"))


def random_rows(rows: DataFrame, n: int, keys: list[str], seed: str) -> DataFrame:
    """The n rows whose hash of `keys` is smallest."""
    return mark_smallest(rows.withColumn("_h", u(seed, *keys)), [], n, "_h", keys, "_in").where("_in").select(*rows.columns)


def over_length(variants: list[DataFrame], keys: list[str], text: str, limits: list[int]) -> DataFrame:
    """Keys whose text is too long (characters / 4) in any variant, each once."""
    over = None
    for rows, limit in zip(variants, limits, strict=True):
        mine = rows.where(F.floor(F.length(text) / 4) > limit).select(*keys)
        over = mine if over is None else over.union(mine)
    return over.distinct()


def canonical(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of their keys, over files of as many ranges as the session shuffles to."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def char_percentiles(rows: DataFrame, n_chars: str, by: list[str], points: tuple = (50, 90, 95, 99)) -> DataFrame:
    """min, percentiles and max of lengths; percentile p is read at place p (n + 1) / 100 between neighbours, inside the data."""
    n = rows.groupBy(*by, F.col(n_chars).alias("t")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by)
    n = n.withColumn("upto", F.sum("c").over(w.orderBy("t").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    place = lambda p: F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.lit(p) * (F.col("n") + 1) / 100)))
    value = lambda at: F.min(F.when(F.col("upto") >= at, F.col("t")))
    cols = [x for p in points for x in (value(place(p)).alias(f"_a{p}"), value(place(p) + 1).alias(f"_b{p}"), F.first(F.lit(p) * (F.col("n") + 1) / 100 - place(p)).alias(f"_d{p}"))]
    out = n.groupBy(*by).agg(F.first("n").alias("n"), F.min("t").alias("min"), F.max("t").alias("max"), *cols)
    return out.select(*by, "n", "min", *((F.col(f"_a{p}") + (F.col(f"_b{p}") - F.col(f"_a{p}")) * F.col(f"_d{p}")).alias(f"p{p}") for p in points), "max")


def group_split(rows: DataFrame, group: list[str], fraction: float, cap: int, seed: str = "split") -> DataFrame:
    """`split` of each row by whole groups: the first max(1, round(groups * fraction)) groups in hash order are held out and never train; of these a group
    is validation while the rows of those before it are below the cap, and unused beyond."""
    n = rows.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_h", u(seed, *group))
    # partial sums of hash ranges keep the running totals out of one task
    n = n.withColumn("_b", F.floor(F.col("_h") / F.lit(1 << 20)))
    per = n.groupBy("_b").agg(F.sum("_n").alias("_s"), F.count("*").alias("_g"))
    before = W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_g0"), F.sum("_g").over(W.partitionBy()).alias("_groups"))
    own = W.partitionBy("_b").orderBy("_h", *group)
    n = n.join(F.broadcast(per), "_b").withColumn("_place", F.col("_g0") + F.row_number().over(own)).withColumn("_rows", F.col("_s0") + F.coalesce(F.sum("_n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    held = F.col("_place") <= F.greatest(F.lit(1), F.bround(F.col("_groups") * F.lit(fraction)))
    split = F.when(~held, "train").when(F.col("_rows") < cap, "validation").otherwise("unused")
    return rows.join(n.select(*group, split.alias("split")), group)
