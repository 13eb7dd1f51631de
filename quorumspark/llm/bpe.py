"""Byte-level BPE by merge replay over the words of a corpus, and decoding.

1. The corpus's units (stretches of pattern matches, see `_Units`) are counted, each task's distinct ones first; the `common` most frequent are the
   corpus's index, a table of bounded size. Which count makes a unit frequent is read off a histogram of counts, so no task sorts them.
2. That table is dealt over the tasks and its words' merges are replayed once for the whole corpus: an inverted index
   from a pair's rank to word positions is worked off in rank order, every place of a merge at once, and only the
   pairs left and right of a merged place are looked up again. The result is broadcast.
3. Texts are put together from the units' ids. A unit outside the table is rare; tasks that meet one replay it in the same way, all
   new ones of a batch together. So every text is encoded whole and alike at any size.

The pass over texts has no shuffle; what a task holds is one Arrow batch, the table and at most `cache` rare units.
"""

import base64
import heapq
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import shared, small_batches
from quorumspark.llm.suffix import _ramp

NONE = np.int64(1 << 40)
#: Units of more characters are not put in the corpus's table, which bounds its size.
LONGEST = 64
#: Units or ids that a task lays out at a time; a text of more stands alone.
PIECE = 1 << 18
#: A pattern of which it is known that a space between two other characters always begins a match.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (one base64 token and rank a line), read on the driver: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary as arrays: the pairs that form a token, sorted, and the tokens' bytes."""

    def __init__(self, ranks):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.pair, self.rank = np.append(self.pair, 1 << 62), np.append(self.rank, NONE)
        top = max(ranks.values()) + 1
        size = np.zeros(top, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.bytes = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.ranks = ranks

    def of(self, a, b):
        key = a << 32 | b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], NONE)

    def one_by_one(self, word: bytes) -> list[int]:
        """The ids of one word, lowest rank and leftmost place first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]):
        """ids of all words, end to end, and their number for each word."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int64), size
        n = len(flat)
        token = self.byte[flat]
        word = np.repeat(np.arange(len(words)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(word[1:] != word[:-1])
        after[edge], after[-1] = n, n
        before[edge + 1] = -1
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, NONE)
        has = np.flatnonzero(after < n)
        rank[has] = self.of(token[has], token[after[has]])
        index, odd = {}, set()

        def note(places):
            r = rank[places]
            places, r = places[r < NONE], r[r < NONE]
            if not len(places):
                return
            o = np.argsort(r, kind="stable")
            places, r = places[o], r[o]
            cut = A.runs(r)
            for i, j in zip(cut.tolist(), np.append(cut[1:], len(r)).tolist(), strict=True):
                k = int(r[i])
                if k in index:
                    index[k].append(places[i:j])
                else:
                    index[k] = [places[i:j]]
                    heapq.heappush(heap, k)

        heap = []
        note(has)
        while heap:
            r = heapq.heappop(heap)
            p = index.pop(r)
            p = np.unique(np.concatenate(p)) if len(p) > 1 else p[0]
            p = p[alive[p] & (rank[p] == r)]
            if not len(p):
                continue
            if len(p) > 1:  # places of one run overlap: every other one, from the left
                chain = np.zeros(len(p), bool)
                chain[1:] = after[p[:-1]] == p[1:]
                if chain.any():
                    begin = np.maximum.accumulate(np.where(chain, 0, np.arange(len(p))))
                    p = p[(np.arange(len(p)) - begin) % 2 == 0]
            q = after[p]
            token[p] = r
            alive[q] = False
            end = after[q]
            after[p] = end
            inner = end < n
            before[end[inner]] = p[inner]
            rank[p] = NONE
            rank[p[inner]] = self.of(token[p[inner]], token[end[inner]])
            left = before[p]
            left = left[left >= 0]
            if len(left):
                rank[left] = self.of(token[left], token[after[left]])
            touched = np.concatenate((p[inner], left))
            low = touched[rank[touched] <= r]
            if len(low):  # a merge made a pair of lower rank: the order inside a word could differ
                odd.update(word[low].tolist())
            note(touched)
        alive = alive[:n]
        count = np.bincount(word[alive], minlength=len(words))
        token = token[alive]
        if odd:
            stop = np.cumsum(count)
            parts = np.split(token, stop[:-1])
            for w in odd:
                parts[w] = np.array(self.one_by_one(words[w]), np.int64)
            token, count = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return token, count


class _Index(dict):
    def __missing__(self, word):
        self[word] = at = len(self)
        return at


#: A space that stands next to other white space.
_WIDE = regex.compile(r"\s \S?| \s|^ | $")


class _Units:
    """Distinct units of the texts so far and their ids.

    A unit is what a single space starts, up to the next one: a match of `pattern` never reaches over
    a space between two other characters but begins with it. Texts with other spacing are cut into
    matches. Key: the unit without its leading space, or with one put before it if it has none.
    """

    def __init__(self, merges, pattern, table=None):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.clean = pattern == SPACED
        units, ids, stop = table or ([], np.zeros(0, np.int32), np.zeros(1, np.int64))
        self.units, self.words = _Index(zip(units, range(len(units)), strict=True)), _Index()
        self.ids, self.stop = np.zeros(0, np.int32), np.zeros(1, np.int64)  # of words
        self.unit_ids, self.unit_stop = ids, stop

    def cut(self, text):
        if self.clean and not _WIDE.search(text):
            parts = text.split(" ")
            parts[0] = " " + parts[0]
            return parts
        return [t[1:] if t[0] == " " and len(t) > 1 and " " not in t[1:] else " " + t for t in self.find(text)]

    def rows(self, text):
        parts = self.cut(text)
        return np.fromiter(map(self.units.__getitem__, parts), np.int32, len(parts))

    def settle(self):
        """Replay the merges for the words of the units that are new."""
        known = len(self.unit_stop) - 1
        if len(self.units) == known:
            return
        found = [self.find(k[1:] if k[0] == " " else " " + k) for k in itertools.islice(self.units, known, None)]
        count = np.array([len(f) for f in found], np.int64)
        word = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(count.sum()))
        fresh = [w.encode() for w in itertools.islice(self.words, len(self.stop) - 1, None)]
        if fresh:
            token, size = self.merges.replay(fresh)
            self.ids = np.concatenate((self.ids, token.astype(np.int32)))
            self.stop = np.concatenate((self.stop, self.stop[-1] + np.cumsum(size)))
        flat, size = gather(self.ids, self.stop, word)
        self.unit_ids = np.concatenate((self.unit_ids, flat))
        at = np.concatenate(([0], np.cumsum(size)))[np.cumsum(count)]
        self.unit_stop = np.concatenate((self.unit_stop, self.unit_stop[-1] + at))


def gather(values, stop, which):
    """The ragged rows `which` of (values, stop), end to end, and their lengths."""
    size = stop[which + 1] - stop[which]
    return values[np.repeat(stop[which], size) + _ramp(size)], size


def _counter(pattern, cache):
    def run(batches):
        cut = _Units(None, pattern).cut
        seen = Counter()

        def packed():
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    parts = cut(text)
                    seen.update(parts if max(map(len, parts)) <= LONGEST else [x for x in parts if len(x) <= LONGEST])
            if len(seen) > cache:
                yield packed()
        if seen:
            yield packed()

    return run


def common_units(texts: DataFrame, pattern: str, common: int, cache: int) -> DataFrame:
    """(unit): at most `common` units of a column of texts, the most frequent; units that occur once or have more than LONGEST characters are left to the tasks that meet them."""
    counts = shared(texts.mapInArrow(A.tidy(_counter(pattern, cache)), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1"))
    # counts on a scale of eighths of powers of two: some hundred rows whatever the corpus
    counts = counts.withColumn("size", F.floor(8 * F.log2("n")).cast("int"))
    least, total = None, 0
    for r in counts.groupBy("size").count().orderBy(F.desc("size")).collect():
        total += r["count"]
        if total > common:
            break
        least = r["size"]
    return counts.where(F.lit(False) if least is None else F.col("size") >= least).select("unit")


def _replayer(merges, pattern):
    def run(batches):
        for b in batches:
            known = _Units(merges.value, pattern)
            for unit in b.column(0).to_pylist():
                known.units[unit]
            known.settle()
            yield pa.record_batch([b.column(0), A.blobs(known.unit_ids.view(np.uint8), known.unit_stop[1:] * 4)], ["unit", "ids"])

    return run


def _encoder(merges, table, pattern, cache):
    def run(batches):
        known = None
        for b in batches:
            if known is None or len(known.units) > cache + len(table.value[0]):
                known = None  # or the old one would be held until the new one is made
                known = _Units(merges.value, pattern, table.value)
            rows = [known.rows(t) if t else np.zeros(0, np.int32) for t in b.column(1).to_pylist()]
            known.settle()
            # about PIECE units at a time, so that the ids of a batch are made in pieces
            edge, i = np.cumsum([len(r) for r in rows]), 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(edge, (edge[i - 1] if i else 0) + PIECE, "right")))
                flat, size = gather(known.unit_ids, known.unit_stop, np.concatenate(rows[i:j]))
                per_row = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum([len(r) for r in rows[i:j]])))]
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.array(flat))], ["id", "ids"])
                i = j

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", common: int = 200_000, cache: int = 300_000) -> DataFrame:
    """(id_col, ids array<int>): ids of each whole text by the rank file at `path`, each match of `pattern` encoded separately, without special tokens.

    A null or empty text has no ids. Rows that repeat, or whose id is null or repeated, each give a row; other columns are not looked at; an empty
    table gives an empty result. A text is held whole in its task (about 40 bytes of memory a byte). `common` bounds the broadcast table of units (some 60 bytes each).
    """
    rows, encoder, _ = _encoding(docs, path, pattern, id_col, text_col, common, cache)
    return rows.mapInArrow(A.tidy(encoder), "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", common: int = 200_000, cache: int = 300_000) -> DataFrame:
    """(id_col, ids array<int>, decoded binary): `decode` of `encode`, row for row, in one pass: a task has one Python worker for both, and ids go to it once."""
    rows, encoder, merges = _encoding(docs, path, pattern, id_col, text_col, common, cache)
    decoder = _decoder(merges)
    return rows.mapInArrow(A.tidy(lambda batches: decoder(encoder(batches))), "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def _encoding(docs, path, pattern, id_col, text_col, common, cache):
    """(rows of id and text, what encodes their batches, the vocabulary as a broadcast)."""
    spark = docs.sparkSession
    small_batches(spark)
    merges = spark.sparkContext.broadcast(Merges(load_ranks(path)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = common_units(rows.select("text"), pattern, common, cache).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    found = found.mapInArrow(A.tidy(_replayer(merges, pattern)), "unit string, ids binary").collect()
    stop = np.concatenate(([0], np.cumsum([len(r.ids) // 4 for r in found]))).astype(np.int64)
    table = spark.sparkContext.broadcast(([r.unit for r in found], np.frombuffer(b"".join(r.ids for r in found), np.int32), stop))
    return rows, _encoder(merges, table, pattern, cache), merges


def _decoder(merges):
    def run(batches):
        for b in batches:
            m, at = merges.value, b.schema.get_field_index("ids")
            edge, i = np.cumsum(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while i < len(b):
                j = max(i + 1, int(np.searchsorted(edge, (edge[i - 1] if i else 0) + PIECE, "right")))
                part = b.slice(i, j - i)
                i = j
                column = part.column(at).fill_null(pa.scalar([], part.column(at).type)) if part.column(at).null_count else part.column(at)
                ids = np.array(column.flatten())
                count = np.array(column.value_lengths())
                size = m.stop[ids] - m.start[ids]
                flat = m.bytes[np.repeat(m.start[ids], size) + _ramp(size)]
                stop = np.concatenate(([0], np.cumsum(size)))[np.cumsum(count)]
                yield pa.record_batch([*part.columns, A.blobs(flat, stop)], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with a column `decoded` (binary): the bytes that each row's ids stand for. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    merges = encoded.sparkSession.sparkContext.broadcast(Merges(load_ranks(path)))
    rows = encoded.withColumnRenamed(ids_col, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(A.tidy(_decoder(merges)), f"{fields}, decoded binary").withColumnRenamed("ids", ids_col)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
