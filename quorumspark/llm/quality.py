"""Quality rules: basic figures of a text, and lines that many documents of a host have.

Normalised lines are hashed; for each host, documents with a line are counted, lines above the host's limit
count as boilerplate and are removed, and a document of which too little is left is rejected.

Distinct documents: lines of many distinct texts are candidates; a line is a document's own if it is no candidate and resembles none (same first or last words, or same
least window). A document whose own lines hold at least OWN of its words is counted by its text, so whatever else it shares, with few or with many, it counts once for itself. A document
with fewer own words is a copy, exact or lightly edited: it is named by the least hash of the 8-word windows of its own lines, or else by that of its rarest candidate, and documents of
one name count once. So a text that is copied many times does not make its own lines boilerplate.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import shared, small_batches, written

#: The characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
#: Normalised lines: ASCII letters in lower case, every digit as 0, white space as one blank.
_NORMAL = np.array([ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 48 if 48 <= c < 58 else c for c in range(256)], np.uint8)
WINDOW = 8
#: Words at either end that an edited line has in common with its original (half of a shorter line's); lines of fewer than FEW words have none.
ENDS, FEW = 4, 6
#: Share of own words from which a document is no copy. A copy that is 0.8 alike in 5-word shingles has changed some 2.4 % of its words.
OWN = 0.05


def _per_text(flags, offsets):
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


class Lines:
    """Lines with a word of a slice: their text's row, byte range, number of words and normalised hash."""

    def __init__(self, data, offsets, words):
        cut = np.flatnonzero(data == 10)
        edge = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], cut + 1)))
        edge = edge[edge < len(data)]
        nxt = np.append(edge[1:], len(data))
        stop = np.where((nxt > 0) & (data[np.maximum(nxt - 1, 0)] == 10), nxt - 1, nxt)
        w0, w1 = np.searchsorted(words.start, edge), np.searchsorted(words.start, np.maximum(stop, edge))
        keep = w1 > w0
        self.start, self.stop, w0, w1 = edge[keep], stop[keep], w0[keep], w1[keep]
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.n_words, self.first_word, self.last_word = w1 - w0, w0, w1
        plain = A.Words(_NORMAL[data], offsets)
        run = plain.run()
        self.hash = A.mix(A.between(run, w0, w1, 0xD6E8FEB86659FD93), 11) + self.n_words.astype(np.uint64)
        self._run = run

    def ends(self):
        """Hashes of each line's first and of its last normalised words; those of a short line are its own hash."""
        m = np.minimum(ENDS, self.n_words // 2)
        long = self.n_words >= FEW
        head = A.mix(A.between(self._run, self.first_word, self.first_word + m, 0xD6E8FEB86659FD93), 21)
        tail = A.mix(A.between(self._run, self.last_word - m, self.last_word, 0xD6E8FEB86659FD93), 22)
        return np.where(long, head, self.hash), np.where(long, tail, self.hash)

    def sketch(self, words):
        """The least hash of each line's windows of WINDOW words (a shorter line is one window), from the words as they are."""
        base = 0xD6E8FEB86659FD93
        each = np.maximum(self.n_words - WINDOW + 1, 1)
        at = np.cumsum(each) - each
        begin = np.repeat(self.first_word - at, each) + np.arange(each.sum())
        end = np.minimum(begin + WINDOW, np.repeat(self.last_word, each))
        h = A.mix(A.between(words.run(base), begin, end, base), WINDOW) + (end - begin).astype(np.uint64)
        return np.minimum.reduceat(h, at) if len(at) else h


def _figures(batches):
    for b in batches:
        for i, j, data, offsets in A.slices(b.column("text")):
            n = j - i
            w = A.Words(data, offsets)
            solid = ~A.SPACE[data] & ((data & 0xC0) != 0x80)
            lines = Lines(data, offsets, w)
            # equal lines of one text
            own = A.mix(A.between(w.sums, lines.start, lines.stop)) ^ A.mix(lines.row.astype(np.uint64), 5) ^ (lines.stop - lines.start).astype(np.uint64)
            _, first = np.unique(own, return_index=True)
            again = np.ones(len(own), bool)
            again[first] = False
            dup = np.bincount(lines.row[again], minlength=n)
            h, begin, each = w.windows(WINDOW)
            row = np.repeat(np.arange(n), each)
            whole = w.counts[row] >= WINDOW
            key = (h ^ A.mix(row.astype(np.uint64), 9))[whole]
            o = np.argsort(key)
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[o][1:] == key[o][:-1]
            twice = begin[whole][o[same[1:] | same[:-1]]]
            edge = np.bincount(twice, minlength=len(w.hash) + WINDOW) - np.bincount(twice + WINDOW, minlength=len(w.hash) + WINDOW)[: len(w.hash) + WINDOW]
            repeat = np.cumsum(edge)[: len(w.hash)] > 0
            # lines of a text with equal hashes: one entry with the words of all
            o = np.lexsort((lines.hash, lines.row))
            r, lh, ln = lines.row[o], lines.hash[o], lines.n_words[o]
            cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (lh[1:] != lh[:-1])))) if len(o) else np.zeros(0, np.int64)
            total = np.add.reduceat(ln, cut) if len(cut) else ln
            sketch = np.minimum.reduceat(lines.sketch(w)[o], cut) if len(cut) else np.zeros(0, np.uint64)
            head, tail = (x[o][cut] for x in lines.ends())
            stop = np.concatenate(([0], np.cumsum(np.bincount(r[cut], minlength=n))))
            entry = pa.StructArray.from_arrays([A.signed(lh[cut]), pa.array(total.astype(np.int64)), A.signed(sketch), A.signed(head), A.signed(tail)], ["h", "n", "least", "head", "tail"])
            yield pa.record_batch(
                [*(b.column(c).slice(i, n) for c in ("id", "host", "u1", "u2")), *(pa.array(x.astype(np.int64)) for x in (w.counts, _per_text(solid, offsets), _per_text(SYMBOLS[data], offsets), dup, np.diff(np.concatenate(([0], np.cumsum(repeat)))[w.first]))), A.signed(w.keys()[0]), pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), entry)],
                ["id", "host", "u1", "u2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words", "lines"],
            )


_SCHEMA = "id long, host string, u1 long, u2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, words long, lines array<struct<h: long, n: long, least: long, head: long, tail: long>>"


def _named(docs, id_col, text_col, host_col):
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return F.xxhash64(F.col(id_col), text, host), F.xxhash64(text, host, F.lit(1), F.col(id_col))


def _counts(rows, lines, min_docs):
    """(host, h, n_docs, docs): how many distinct documents have a line, for lines of more than `min_docs` distinct texts, and how many the host has."""
    many = lines.groupBy("host", "h").agg(F.count_distinct("words").alias("n_texts"), *(F.min(c).alias(c) for c in ("head", "tail", "least"))).where(F.col("n_texts") > min_docs)
    many = written(many)
    marked = lines.join(many.select("host", "h", "n_texts"), ["host", "h"], "left")
    like, keys = marked, ("head", "tail", "least")
    for key in keys:
        like = like.join(written(many.select("host", key, F.lit(True).alias(f"like_{key}")).distinct()), ["host", key], "left")
    own = F.col("n_texts").isNull()
    for key in keys:
        own = own & F.col(f"like_{key}").isNull()
    rarest = F.min(F.when(F.col("n_texts").isNotNull(), F.struct("n_texts", "h", "least")))
    copied = F.coalesce(F.min(F.when(own, F.col("least"))), rarest["least"], F.min("least"))
    name = F.when(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) >= OWN * F.sum("n"), F.first("words")).otherwise(copied)
    names = shared(like.groupBy("host", "u1", "u2").agg(name.alias("name")))
    docs = rows.select("host", "u1", "u2").join(names, ["host", "u1", "u2"], "left").groupBy("host").agg(F.count_distinct(F.coalesce("name", F.lit(0))).alias("docs"))
    often = marked.where(F.col("n_texts").isNotNull()).join(names, ["host", "u1", "u2"]).groupBy("host", "h").agg(F.count_distinct("name").alias("n_docs"))
    return often.join(docs, "host")


def _boilerplate(rows, lines, min_docs, min_share):
    """(host, h) of the lines that more than max(min_docs, min_share * the host's documents) distinct documents have."""
    return _counts(rows, lines, min_docs).where(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), min_share * F.col("docs"))).select("host", "h")


def _read(docs, id_col, text_col, host_col):
    """Figures of each row, written, and its lines by normalised hash."""
    small_batches(docs.sparkSession)
    u1, u2 = _named(docs, id_col, text_col, host_col)
    use = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), u1.alias("u1"), u2.alias("u2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = shared(use.mapInArrow(A.tidy(_figures), _SCHEMA))
    return rows, rows.select("host", "u1", "u2", "words", F.explode("lines").alias("line")).select("host", "u1", "u2", "words", "line.*")


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20) -> DataFrame:
    """(host, h, n_docs, docs): for each normalised line (hash h) of more than `min_docs` distinct texts of a host, how many distinct documents have it, and how many the host has; see `judged` for nulls and repeats."""
    return _counts(*_read(docs, id_col, text_col, host_col), min_docs)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20, min_share: float = 0.02, min_words: int = 20, min_left: float = 0.5, max_repeat: float = 0.3) -> DataFrame:
    """Figures and verdict of each row: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_words_left, boilerplate array<long>, u1, u2).

    A line is boilerplate on a host when more than max(min_docs, min_share * the host's documents)
    distinct documents have it. `kept` is false if the base rules fail (fewer than `min_words` words, or more than
    `max_repeat` of the words in repeated 8-word windows) or if the document is depleted: fewer than `min_words`
    words, or less than `min_left` of them, outside boilerplate lines. A null text is empty (base fails), a null
    host is a host of its own; rows that repeat, or share an id, are judged each by its own text.
    Empty tables give an empty result; other columns are not looked at. Ids are taken as long. Texts are worked off in slices, so a task's memory follows its longest text (some
    thirty times its bytes); lines, not texts, are shuffled.
    """
    rows, lines = _read(docs, id_col, text_col, host_col)
    often = _boilerplate(rows, lines, min_docs, min_share)
    bad = lines.join(often, ["host", "h"]).select("u1", "u2", "h", "n").distinct().groupBy("u1", "u2").agg(F.sum("n").alias("n_bad"), F.collect_list("h").alias("boilerplate"))
    out = rows.drop("lines", "words", "host").join(bad, ["u1", "u2"], "left")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * max_repeat) * F.col("n_words")))
    out = out.withColumn("n_words_left", F.col("n_words") - F.coalesce("n_bad", F.lit(0)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= min_words) & (F.col("n_words_left") >= min_left * F.col("n_words")))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", "boilerplate", "u1", "u2")


def _cleaner(text_col):
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = b.column(at).to_pylist()
            bad = b.column("_quality_lines")
            for i, j, data, offsets in A.slices(b.column(at)):
                if bad.slice(i, j - i).null_count == j - i:
                    continue
                lines = Lines(data, offsets, A.Words(data, offsets))
                first = np.searchsorted(lines.row, np.arange(j - i + 1))
                for r in range(j - i):
                    own = bad[i + r].as_py()
                    if not own:
                        continue
                    s = slice(first[r], first[r + 1])
                    gone = set(lines.start[s][np.isin(lines.hash[s].view(np.int64), np.array(own, np.int64))].tolist())
                    text, p, kept = out[i + r].encode(), int(offsets[r]), []
                    for line in text.split(b"\n"):
                        if p not in gone:
                            kept.append(line)
                        p += len(line) + 1
                    out[i + r] = b"\n".join(kept).decode()
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            keep = [k for k, name in enumerate(b.schema.names) if name != "_quality_lines"]
            yield pa.record_batch([columns[k] for k in keep], [b.schema.names[k] for k in keep])

    return run


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", **limits) -> DataFrame:
    """The rows of `docs` that are kept, all columns, their texts without boilerplate lines; `length_col`, if there is one, is set to the new length in characters.

    A null or empty text fails the base rules and goes; a null host is a host of its own; each of several rows that repeat stays or goes as all of them do, and rows that only
    share an id (or have none) each by their own text. There are no ties to break. An empty table gives an empty table; other columns, of any name, go along unchanged.
    """
    u1, u2 = _named(docs, id_col, text_col, host_col)
    verdict = judged(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col("u1").alias("_quality_1"), F.col("u2").alias("_quality_2"), F.col("boilerplate").alias("_quality_lines")).dropDuplicates(["_quality_1", "_quality_2"])
    rows = docs.withColumn(text_col, F.col(text_col).cast("string")).join(verdict, (u1 == F.col("_quality_1")) & (u2 == F.col("_quality_2"))).select(*docs.columns, "_quality_lines")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_quality_lines")
    out = rows.mapInArrow(A.tidy(_cleaner(text_col)), schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
