"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A text is split at line feeds; the hash of each line enters a rolling hash over `window` lines, and a chunk ends
after every line at which that hash is 0 modulo `divisor` and was not at the line before: no chunk inside a text has one line only. Boundaries depend on the last lines
only, so a passage is cut alike wherever it stands. Chunks of two lines or more that occur again anywhere are found
by hash, compared byte by byte, and all but the first (least id, then place) are removed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chunk_starts(h: Column, window: int, divisor: int) -> Column:
    """1-based first lines of the chunks, from the array of line hashes; the last chunk has two lines at least if the text has."""
    rolling = h
    for m in range(1, window):
        rest = F.greatest(F.size(h) - m, F.lit(0))
        rolling = F.zip_with(F.slice(rolling, 1, rest), F.slice(h, m + 1, rest), lambda r, x: r * 31 + x)
    mark = F.transform(rolling, lambda r: r % divisor == 0)
    alone = F.zip_with(mark, F.slice(F.concat(F.array(F.lit(False)), mark), 1, F.greatest(F.size(h) - window + 1, F.lit(0))), lambda m, before: m & ~before)
    cut = F.transform(alone, lambda m, i: F.when(m, i + window + 1))
    return F.concat(F.array(F.lit(1)), F.filter(cut, lambda x: x.isNotNull() & (x < F.size(h))))


def _named(docs, id_col, text_col):
    """Two hashes that name a row by id and text."""
    i, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(i, text), F.xxhash64(text, F.lit(1), i)


def _use(docs, id_col, text_col):
    """(id, u1, u2, text): u1 and u2 name a row by id and text."""
    u1, u2 = _named(docs, id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), u1.alias("u1"), u2.alias("u2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _chunked(rows, window, divisor, *more):
    """(u1, u2, *more, n_lines, sizes, chunks) of rows (u1, u2, text, *more): how many lines each chunk has, and its text."""
    keep = ["u1", "u2", *more]
    rows = rows.select(*keep, F.split("text", "\n", -1).alias("lines"))
    rows = rows.select(*keep, "lines", F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")).alias("h"))
    rows = rows.select(*keep, "lines", _chunk_starts(F.col("h"), window, divisor).alias("starts"))
    stops = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines") + 1))
    rows = rows.select(*keep, "lines", F.zip_with("starts", stops, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))).alias("ranges"), F.size("lines").alias("n_lines"))
    # `lines` is used twice, so that it is computed once and not for each chunk
    return rows.select(*keep, "n_lines", F.transform("ranges", lambda r: r.n).alias("sizes"), F.transform("ranges", lambda r: F.array_join(F.slice("lines", r.a, r.n), "\n")).alias("chunks"), F.size("lines").alias("_n")).drop("_n")


def _gone(use, window, divisor):
    """(u1, u2, gone array<int>): the places of each row's chunks that an earlier one equals byte by byte."""
    wide = _chunked(use, window, divisor).select("u1", "u2", F.posexplode(F.zip_with("sizes", "chunks", lambda n, t: F.when((n > 1) & t.rlike(r"\S"), F.xxhash64(t, F.length(t))))).alias("place", "key")).where("key is not null")
    again = wide.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    suspect = wide.join(again, "key").groupBy("u1", "u2").agg(F.collect_set("place").alias("places"))
    found = _chunked(use.join(suspect, ["u1", "u2"]), window, divisor, "id", "places")
    found = found.select("id", "u1", "u2", F.explode(F.transform("places", lambda p: F.struct(p.alias("place"), F.get("chunks", p).alias("chunk")))).alias("x"), F.size("chunks").alias("n"), F.size("places").alias("_n")).select("id", "u1", "u2", "x.place", "x.chunk")
    first = found.groupBy("chunk").agg(F.min(F.struct("id", "u1", "u2", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("chunk").alias("chunk1"), "first")
    return found.join(first, F.col("chunk") == F.col("chunk1")).where(F.struct("id", "u1", "u2", "place") != F.col("first")).groupBy("u1", "u2").agg(F.collect_set("place").alias("gone"))


def _left(rows, window, divisor, *more):
    """(u1, u2, *more, n_lines, n_chunks, n_removed, left) of rows (u1, u2, text, gone, *more): the chunks that stay, joined."""
    none = F.array().cast("array<int>")
    out = _chunked(rows, window, divisor, "gone", *more).withColumn("gone", F.coalesce("gone", none))
    out = out.select("u1", "u2", *more, "n_lines", "sizes", "chunks", "gone", F.size("chunks").alias("n_chunks"))
    out = out.select("u1", "u2", *more, "n_lines", "sizes", "chunks", "gone", "n_chunks", F.array_except(F.sequence(F.lit(0), F.col("n_chunks") - 1), "gone").alias("stay"), F.size("sizes").alias("_n"))
    removed = F.aggregate("gone", F.lit(0), lambda s, p: s + F.get("sizes", p))
    left = F.array_join(F.transform("stay", lambda p: F.get("chunks", p)), "\n")
    return out.select("u1", "u2", *more, F.col("n_lines").cast("long").alias("n_lines"), F.col("n_chunks").cast("long").alias("n_chunks"), removed.cast("long").alias("n_removed"), left.alias("left"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2) -> DataFrame:
    """(id_col, n_lines, n_chunks, n_removed lines, text left), one row for each input row.

    Removed: chunks of two lines or more, with a character that is not white space, whose bytes an
    earlier chunk also has; earlier means a smaller (id, place), a null id first; different texts of one id go by their row names. A null text is empty (one line). Rows that repeat with the same id keep what one
    of them keeps. Empty tables give an empty result; other columns are not looked at. A text is held whole, some ten times its bytes.
    """
    use = _use(docs, id_col, text_col)
    # both joins of the texts can read one exchange
    out = _left(use.join(_gone(use, window, divisor), ["u1", "u2"], "left"), window, divisor, "id")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_chunks", "n_removed", F.col("left").alias("text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = 2, divisor: int = 2) -> DataFrame:
    """`docs` with each text replaced by what `repeated_chunks` leaves of it; rows of which nothing but white space is left, and that had more, go.

    All other columns stay; `length_col`, if there is one, is set to the new length in characters. A null or empty text stays as it is; rows that repeat stay or lose chunks alike; an empty table stays empty.
    """
    gone = _gone(_use(docs, id_col, text_col), window, divisor)
    u1, u2 = _named(docs, id_col, text_col)
    cols = [f"_line_{i}" for i in range(len(docs.columns))]
    rows = docs.select(u1.alias("u1"), u2.alias("u2"), *(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, cols, strict=True))).join(gone, ["u1", "u2"], "left")
    own = F.col(cols[docs.columns.index(text_col)]).cast("string")
    rows = rows.withColumn("text", F.when(F.col("gone").isNotNull(), own).otherwise(F.lit("")))
    out = _left(rows, window, divisor, *cols)
    # through a generator, below which Spark does not push the filter: it would compute the chunks anew in it
    out = out.select(*cols, F.explode(F.array(F.struct("n_removed", "left", "n_lines"))).alias("x")).select(*cols, "x.*")
    out = out.where((F.col("n_removed") == 0) | F.col("left").rlike(r"\S"))
    text = F.when(F.col("n_removed") > 0, F.col("left")).otherwise(own)
    new = {text_col: text, length_col: F.length(text)}
    return out.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(k)).alias(c) for c, k in zip(docs.columns, cols, strict=True)))
