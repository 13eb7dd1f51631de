"""Mixing sources to target weights by a time-varying curriculum.

Each source has a demand of words (its target) and a weight schedule over training time 0..1, piecewise linear. The integral of the
schedule, scaled to the target, is how many of its words training has taken by a time; a document that begins at some word of its
source's (hashed) order gets the time at which the demand reaches that word: its training position. Sources that are
asked for more than they have go round again. Documents are range-sorted by position.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumspark.llm._graph import written
from quorumspark.llm._order import parts, running

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by rank, repeating, and their schedules over training time as (time, weight): falling, even, rising.
WEIGHTS = (3, 1, 2)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, rank, target) of a table (source, size): `share` of all sizes dealt to the sources by weight, no target above `most` times its source's size.

    Sources rank by code point, null last, and take `weights` in turn. What a source may not take is dealt to the others by weight until no target is above its limit: all
    targets are min(limit, weight * level) for one level. Sources are sorted by limit / weight; the level is that of the first source which, with all before it at
    their limits, stays within its own. Where `share` exceeds `most` every source is at its limit.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(each, [F.col("source").isNull(), "source"], {"rank": "one"}).drop("one")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    # integers, for exact sums in any order
    ranked = ranked.withColumn("w", F.round(F.col("weight") * 1_000_000).cast("long"))
    filled = running(ranked, [F.col("limit") / F.col("weight"), "rank"], {"size_before": "source_size", "w_before": "w"})
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.lit(float(share)) * F.col("all_size") - F.lit(float(most)) * F.col("size_before")) / ((F.col("all_w") - F.col("w_before")) / 1_000_000)
    fits = F.when(level * F.col("weight") <= F.col("limit"), F.struct("size_before", F.col("rank").alias("_r"), level.alias("level")))
    one = filled.crossJoin(F.broadcast(whole)).agg(F.min(fits)["level"].alias("level"))
    return ranked.crossJoin(F.broadcast(one)).select("source", "source_size", "rank", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def _pieces(knots) -> list[dict]:
    """The pieces of a schedule, with its integral before each as a share of the whole."""
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append({"t": t0, "dt": t1 - t0, "w": w0, "dw": w1 - w0, "before": done})
        done += (w0 + w1) / 2 * (t1 - t0)
    if done <= 0 or any(w < 0 for _, w in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to 1 with weights that are not negative nor all 0")
    return [{k: v / done if k in ("w", "dw", "before") else v for k, v in p.items()} for p in out]


def position(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule, scaled to 1, reaches `share`: the inverse of a quadratic in the piece that holds it."""
    out = None
    for p in _pieces(knots):
        # before + dt * (w * x + dw * x * x / 2) = share, in the form without cancellation
        need = (share - p["before"]) / p["dt"] if p["dt"] else F.lit(0.0)
        root = F.sqrt(F.greatest(F.lit(p["w"] ** 2) + 2 * p["dw"] * need, F.lit(0.0)))
        at = F.lit(p["t"]) + p["dt"] * F.least(F.greatest(F.coalesce(2 * need / F.nullif(F.lit(p["w"]) + root, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        out = at if out is None else F.when(share >= p["before"], at).otherwise(out)
    return out


def _sizes(docs, id_col, text_col, source_col):
    return docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.lit(1).cast("long").alias("one"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(row, doc, source, size, source_size, target, begin, taken, copies array<struct<pass, words, position>>), one row a document; `row` numbers them.

    Size: words of the text. A source's documents go by hash of (seed, id) and, where ids repeat or are null, by size and text; `begin` is the number of words before a document in that order, and
    pass k over the source demands the words k * source_size + begin onwards. Demand ends at the whole part of the target, so the last document of a
    source gives only its first words. `copies` has an entry for each pass that takes words of it; `position` is when, by the source's schedule, the demand reaches its first word.
    An empty or null text is a document of no words: taken is 0, without copies. A null source is a source of its own, the last; rows that repeat are documents of their own; an empty table gives an empty
    result. Other columns are not looked at. Texts are counted where they are read and never shuffled; no source is gathered in a task: the order is one range sort of all sources.
    """
    rows = written(_sizes(docs, id_col, text_col, source_col))
    per_source = written(targets(rows.select("source", "size"), weights, share, most))
    keyed = rows.withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc").cast("string"))))
    ordered = running(keyed, [F.col("source").isNull(), "source", "order", "doc", "size", "key"], {"all_before": "size", "row": "one"})
    starts = running(per_source.select("source", "source_size", "rank", "target"), ["rank"], {"base": "source_size"})
    both = ordered.join(starts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("begin", F.col("all_before") - F.col("base"))
    demand = F.floor(F.col("target") + 1e-6).cast("long")
    shape = F.col("rank") % len(schedules)

    def copy(k):
        first = F.lit(k) * F.col("source_size") + F.col("begin")
        words = F.least(F.greatest(demand - first, F.lit(0)), F.col("size")).cast("long")
        done = first / F.nullif(F.col("target"), F.lit(0.0))
        when = None
        for i, knots in enumerate(schedules):
            at = position(done, knots)
            when = at if when is None else F.when(shape == i, at).otherwise(when)
        return F.struct(F.lit(k).alias("pass"), words.alias("words"), when.alias("position"))

    copies = F.filter(F.array(*(copy(k) for k in range(int(-(-most // 1))))), lambda c: c.words > 0)
    out = both.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c.words)
    return out.select("row", "doc", "source", "size", "source_size", "target", "begin", taken.alias("taken"), "copies")


def order(assigned: DataFrame) -> DataFrame:
    """The columns of `assigned`, but for copies (pass, words, position, at): a row for every copy, range-sorted by position; `at` is the number of words that training has taken before it.

    Ties go by source (null last), pass and beginning. Documents of which nothing is taken come last, once each, with a null position.
    """
    each = assigned.select("*", F.explode_outer("copies").alias("_c")).select(*(c for c in assigned.columns if c != "copies"), "_c.pass", "_c.words", "_c.position")
    return running(each, [F.col("position").isNull(), "position", F.col("source").isNull(), "source", "pass", "begin", "row"], {"at": "words"})


def stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The training stream: (doc, source, pass, words, position, at, text) in order, with the text up to the last word taken. Ids have to be unique and not null here; texts are shuffled once to join and once to sort."""
    placed = order(assign(docs, id_col, text_col, source_col, **how)).where("words > 0")
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.regexp_count("text", F.lit(WORD)), part).otherwise(F.col("text"))
    out = placed.join(texts, "doc").select("doc", "source", "pass", "words", "position", "at", cut.alias("text"))
    return out.repartitionByRange(parts(docs), "at").sortWithinPartitions("at")


def digest(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, source_size, target, taken, first_position, first_at) of what `order` returns, a row a document: words taken over all copies, time and place of the first copy (null where nothing is taken)."""
    out = placed.groupBy("row", "doc", "size", "source_size", "target").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.round(F.min("position"), 6).alias("first_position"), F.min(F.when(F.col("words") > 0, F.col("at"))).alias("first_at"))
    return out.select(F.col("doc").alias(id_col), "size", "source_size", "target", "taken", "first_position", "first_at")
