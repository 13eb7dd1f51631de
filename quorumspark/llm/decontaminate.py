"""Benchmark decontamination by spaced seeds.

Masks choose the hashed words of a window and ignore at most one place between them. An overlap begins and ends with an equal
word, so its changed words cut it into runs of equal ones; two runs that meet at a changed word hold at least `weight` words
together (see `weight_of`), so one of the masks fits into each overlap the rule allows. Seeds of the benchmark are joined to those of the
corpus; around each hit the benchmark item is laid over the document on the hit's diagonal, and the
longest stretch with at least `min_equal` equal words is the overlap. Windows never reach over a document's end: what is found in a text
does not depend on the texts it is read with.

The benchmark is the stated query set: it goes to the tasks in blocks of at most `block_words`
words, a fixed bound, one pass over the documents for each block; document seeds are never shuffled. Longer items come in pieces that share words.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import small_batches

#: Pairs of words that one step compares, and of seeds that it joins.
STEP = 1 << 20
#: An item of more words is cut into pieces of so many.
PIECE = 10_000
#: Bytes that separate words (everything in ASCII but letters and digits) become blanks.
_PLAIN = np.array([c if chr(c).isalnum() or c > 127 else 32 for c in range(256)], np.uint8)


def words_of(column):
    """(first row, last row + 1, Words) of slices of a string column: lower case, split at all but letters and digits."""
    for i, j, data, offsets in A.slices(pc.utf8_lower(pc.fill_null(column, ""))):
        yield i, j, A.Words(_PLAIN[data], offsets)


def _changed(n, min_equal):
    """The most words of n that may differ."""
    return int(np.floor((1 - min_equal) * n + 1e-9))


def weight_of(least, most, min_equal):
    """The most words that two neighbouring runs of equal words hold in every allowed overlap of least to most words.

    e changed words leave e + 1 runs (some may be empty), which ceil((e + 1) / 2) pairs of neighbours cover, so one pair holds the average at least.
    """
    sizes = [(n, _changed(n, min_equal)) for n in range(least, most + 1)]
    return max(1, min(-(-(n - e) // -(-(e + 1) // 2)) for n, e in sizes))


def seed_masks(n, min_words, min_equal):
    """Masks of which each allowed overlap with an item of n words has one, 1 for a word that is hashed."""
    short = n < min_words
    w = weight_of(n if short else min_words, n if short else min_words + 500, min_equal)
    return ["1" * w] + ["1" * i + "0" + "1" * (w - i) for i in range(1, w) if _changed(n, min_equal)]


def _seeds(h, doc, mask):
    """(first words, hashes of the masked words) of the windows of len(mask) words inside one document."""
    n = max(len(h) - len(mask) + 1, 0)
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :][:n])
    out = np.zeros(n, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return at, A.mix(out[at], len(mask))


class Items:
    """Seeds of a block of benchmark items or pieces of items: (id, text, whether it is an item's last piece)."""

    def __init__(self, rows, min_words, min_equal):
        self.ids, self.last, self.words = pa.array([r[0] for r in rows], pa.int64()), [r[2] for r in rows], []
        for _, _, w in words_of(pa.array([r[1] for r in rows], pa.string())):
            self.words += np.split(w.hash, w.first[1:-1])
        size = np.array([len(h) for h in self.words])
        self.size, self.shares = size, 4 * min_words
        # equal words that an overlap with each item has at least
        self.enough = np.array([m - _changed(m, min_equal) for m in np.minimum(size, min_words).tolist()])
        masks, parts = {}, {}
        for n, h in enumerate(self.words):
            m = min(len(h), min_words)
            if m and m not in masks:
                masks[m] = seed_masks(m, min_words, min_equal)
            for mask in masks.get(m, ()):
                at, s = _seeds(h, np.zeros(len(h), np.int8), mask)
                parts.setdefault(mask, []).append((s, np.full(len(s), n), at))
        self.tables = {}
        for mask, found in parts.items():
            seed, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
            o = np.argsort(seed, kind="stable")
            shift = np.uint64(64 - min(22, max(10, int(16 * len(seed)).bit_length())))
            near = np.zeros(1 << (64 - int(shift)), bool)
            near[(seed >> shift).astype(np.int64)] = True
            self.tables[mask] = (near, shift, seed[o], item[o], at[o])
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.first = np.cumsum(size) - size

    def hits(self, h, doc, first):
        """(document, place of the item's first word, item) for seeds that a document of `h` shares with an item, each once, where enough words of the document are equal."""
        found = []
        for mask, (near, shift, seed, item, at) in self.tables.items():
            place, s = _seeds(h, doc, mask)
            hit = near[(s >> shift).astype(np.int64)]
            place, s = place[hit], s[hit]
            lo, hi = np.searchsorted(seed, s, "left"), np.searchsorted(seed, s, "right")
            for i, j in _portions(hi - lo):
                many = (hi - lo)[i:j]
                row = np.repeat(lo[i:j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                p = np.repeat(place[i:j], many)
                # the same diagonal of two documents is two hits
                found.append(np.unique(np.stack((doc[p], p - at[row], item[row]), axis=1), axis=0))
        x = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        keep = np.zeros(len(x), bool)
        for i, j in _portions(self.size[x[:, 2]]):
            d, start, item = x[i:j].T
            n = self.size[item]
            off = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(off, n)
            there = np.repeat(start, n) + inside
            same = (there >= np.repeat(first[d], n)) & (there < np.repeat(first[d + 1], n))
            same &= h[np.clip(there, 0, len(h) - 1)] == self.flat[np.repeat(self.first[item], n) + inside]
            keep[i:j] = np.add.reduceat(same.astype(np.int64), off) >= self.enough[item]
        return x[keep]


def _portions(sizes):
    """(i, j) of runs of rows whose sizes are STEP together, or of one row."""
    total, i = np.cumsum(sizes), 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, "right")))
        yield i, j
        i = j


def longest(equal, share):
    """(start, stop) of the longest stretch that begins and ends with an equal word and has at least `share` of them; the first of several."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    score = np.concatenate(([0], np.cumsum(equal - share)))
    # the first beginning whose score is not above that of an end: scores' running minimum falls
    lowest = np.minimum.accumulate(score[at])
    begin = np.searchsorted(-lowest, -(score[at + 1] + 1e-9), "left")
    length = np.where(begin <= np.arange(len(at)), at + 1 - at[np.minimum(begin, len(at) - 1)], 0)
    j = int(np.argmax(length))
    return int(at[begin[j]]), int(at[j]) + 1


def _overlaps(items, w, min_words, min_equal):
    """(row, item number, first word in the document, words, equal words) of a slice."""
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    out = set()
    for d, start, item in items.hits(w.hash, doc, w.first).tolist():
        own = items.words[item]
        p, q = max(start, int(w.first[d])), min(start + len(own), int(w.first[d + 1]))
        equal = (w.hash[p:q] == own[p - start : q - start]).astype(np.float64)
        i, j = longest(equal, min_equal)
        # what begins in the words that a piece shares with the next one is found there
        if j - i >= min(min_words, len(own)) and (items.last[item] or p + i - start < len(own) - items.shares):
            out.add((d, item, p + i - int(w.first[d]), j - i, int(equal[i:j].sum())))
    return sorted(out)


def _finder(items, min_words, min_equal):
    def run(batches):
        for b in batches:
            for i, _, w in words_of(b.column(1)):
                x = _overlaps(items.value, w, min_words, min_equal)
                if x:
                    d, item, first, n, equal = (np.array(c, np.int64) for c in zip(*x, strict=True))
                    yield pa.record_batch([b.column(0).take(pa.array(d + i)), items.value.ids.take(pa.array(item)), pa.array(first), pa.array(n), pa.array(equal)], ["id", "item_id", "first_word", "n_words", "n_equal"])

    return run


def _keeper(items, text_col, min_words, min_equal):
    def run(batches):
        for b in batches:
            keep = np.ones(len(b), bool)
            for i, _, w in words_of(b.column(text_col)):
                for d, *_ in _overlaps(items.value, w, min_words, min_equal):
                    keep[i + d] = False
            yield b.filter(pa.array(keep))

    return run


def _blocks(benchmark, item_col, text_col, min_words, min_equal, block_words, fewest):
    """The benchmark in blocks of bounded size, each broadcast: items and pieces of items are dealt by a hash."""
    spark = benchmark.sparkSession
    small_batches(spark)
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    shares = 4 * min_words
    piece = max(PIECE, 4 * shares)
    # the words that the tasks make of it: runs of letters, digits and other than ASCII characters
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))
    rows = rows.select("item", words.alias("words"), F.size(words).alias("n")).where(F.col("n") >= fewest)
    rows = rows.withColumn("begin", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - shares - 1, F.lit(0)), F.lit(piece - shares))))
    rows = rows.select("item", F.array_join(F.slice("words", F.col("begin") + 1, F.lit(piece)), " ").alias("text"), (F.col("begin") + piece >= F.col("n")).alias("last"), F.least(F.col("n") - F.col("begin"), F.lit(piece)).alias("n"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(1, int(-(-2 * total // block_words))) if total > block_words else 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        if block:
            yield spark.sparkContext.broadcast(Items([(r.item, r.text, r["last"]) for r in block], min_words, min_equal))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, min_equal: float = 0.8, block_words: int = 1_000_000, fewest: int = 5) -> DataFrame:
    """(id_col, item_id, first_word, n_words, n_equal): overlaps of `min_words` words or more (or of a whole shorter item) of which at least `min_equal` are equal in place, the longest of each item and place.

    Words are lower-cased runs of letters and digits (ASCII punctuation separates them). Null or empty texts overlap
    nothing, items of under `fewest` words are not looked for, and an item whose id is null is one like others. A document whose id
    is null gives rows with a null id; repeated rows each give theirs; other columns are not looked at; empty tables give an empty result. A text of any length is read whole, about 60 bytes of
    memory a byte of it; an item of more than PIECE words is laid in pieces that share 4 * min_words words: an overlap at a piece's end may be reported in parts or by both, and none is lost.
    """
    use = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, first_word long, n_words long, n_equal long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col, min_words, min_equal, block_words, fewest):
        out = out.union(use.mapInArrow(_finder(items, min_words, min_equal), schema))
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 13, min_equal: float = 0.8, block_words: int = 1_000_000, fewest: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, without an overlap with any item (see `overlaps`): null and empty texts stay, rows that repeat stay or go together, an empty table stays empty."""
    for items in _blocks(benchmark, item_col, item_text_col, min_words, min_equal, block_words, fewest):
        docs = docs.mapInArrow(_keeper(items, text_col, min_words, min_equal), docs.schema)
    return docs
