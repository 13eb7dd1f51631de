"""Hard negatives: for anchors and their nearest rows of the same label, near rows of other labels in a window of scores.

Vectors are compared by integer inner products. Each row is rotated (random signs and Hadamard steps) and coded by one bit a component; what
that code leaves is rotated and coded again, a few levels deep. Every level stores the alignment of its code with what it codes, and the length of
what is left. Against an anchor, whose rotated components are cut to eight bits, popcounts estimate the score, and by
Cauchy-Schwarz the part of both that the code does not hold bounds the error for certain. Rows whose interval cannot change the answer are
dropped level by level, and only the others are scored in integers: the answer is exact.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumspark.llm._arrow import blobs, joined, tidy
from quorumspark.llm._graph import written
from quorumspark.llm._order import parts

#: A score times 100 has to fit a long, so the squared length of a row's integers stays under this.
LONGEST = 2**56
#: Levels of one-bit codes, and bits of an anchor's components.
LEVELS, BITS = 6, 8
#: Rows of a chunk at least.
LEAST = 4096


def width_of(dim: int) -> int:
    """Components after rotation: a power of two, at least one machine word of bits."""
    return max(64, 1 << max(0, int(dim - 1).bit_length()))


def rotated(x: np.ndarray, width: int, level: int) -> np.ndarray:
    """Rows turned by the fixed rotation of a level: three rounds of random signs and a Walsh-Hadamard transform."""
    rng = np.random.default_rng(level)
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], width)
        h = 1
        while h < width:
            pair = out.reshape(len(x), width // (2 * h), 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            h *= 2
        out /= np.sqrt(width)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def codes(x: np.ndarray, width: int, levels: int):
    """(words n x levels x w, alignments n x levels, lengths left n x levels) of rows."""
    root, words, align, left, e = np.sqrt(width), [], [], [], x
    for level in range(levels):
        e = rotated(e, width, level)
        up = e >= 0
        a = np.abs(e).sum(axis=1) / root
        e -= np.where(up, a[:, None], -a[:, None]) / root
        words.append(packed(up))
        align.append(a)
        left.append(np.linalg.norm(e, axis=1))
    return np.stack(words, axis=1), np.stack(align, axis=1), np.stack(left, axis=1)


def _matrix(column, dim):
    """Lists of numbers, padded with zeros to `dim`, and which rows have a null or non-finite component."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten()
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    odd = np.zeros(len(n), bool)
    odd[row[~np.isfinite(values)]] = True
    out = np.zeros((len(n), dim))
    out[row, at] = np.where(np.isfinite(values), values, 0.0)
    return out, odd


_CODED = "id long, label long, ints binary, words binary, factors binary, chunk int"


def encoded(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = 256, levels: int = LEVELS, rows_per_task: int = 65_536) -> tuple[DataFrame, int, int]:
    """The rows that take part as a written table (id, label, ints, words, factors, chunk), their number of components and of chunks.

    Rows with a null id, label or vector or with a null or non-finite component take no part. Shorter vectors end in zeros. Rows are dealt to chunks in turn, so copies of a row spread too.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    size = rows.agg(F.max(F.size("vec")).alias("dim"), F.count("*").alias("n")).first()
    # as many chunks as partitions, but none of a few rows only: every chunk answers for every anchor
    dim, chunks = max(1, size.dim or 1), max(1, -(-size.n // rows_per_task), min(parts(vectors), size.n // LEAST))
    width = width_of(dim)

    def run(batches):
        at = TaskContext.get().partitionId() * 7919
        for b in batches:
            x, odd = _matrix(b.column("vec"), dim)
            x = np.floor(scale * x[~odd])
            length = np.einsum("ij,ij->i", x, x)
            if (length >= LONGEST).any():
                raise ValueError("vectors too long: their scores do not fit a long")
            words, align, left = codes(x, width, levels)
            n, keep = len(x), pa.array(~odd)
            whole = np.concatenate((align, left, np.sqrt(length)[:, None]), axis=1)
            stops = np.arange(1, n + 1)
            yield pa.record_batch([b.column("id").filter(keep), b.column("label").filter(keep), blobs(x.astype(np.int32), stops), blobs(words.reshape(n, -1), stops), blobs(whole, stops), pa.array(((at + np.arange(n)) % chunks).astype(np.int32))], ["id", "label", "ints", "words", "factors", "chunk"])
            at += n

    return written(rows.mapInArrow(tidy(run), _CODED)), dim, chunks


class Chunk:
    """Coded rows in memory, to be searched for one anchor at a time."""

    def __init__(self, table: pa.Table, dim: int, levels: int):
        n, self.dim, self.levels, self.width = table.num_rows, dim, levels, width_of(dim)
        self.id, self.label = (table.column(c).to_numpy() for c in ("id", "label"))
        self.ints = joined(table.column("ints"), np.int32).reshape(n, dim)
        self.words = np.ascontiguousarray(joined(table.column("words"), np.uint64).reshape(n, levels, -1).transpose(1, 2, 0))
        factors = joined(table.column("factors"), np.float64).reshape(n, -1)
        self.align, self.left, self.length = factors[:, :levels].T.copy(), factors[:, levels:-1].T.copy(), factors[:, -1].copy()
        order = np.argsort(self.label, kind="stable")
        cut = np.searchsorted(self.label[order], names := np.unique(self.label))
        self.by_label = dict(zip(names.tolist(), np.split(order, cut[1:]), strict=True)) if n else {}
        self.seen = self.scored = 0

    def anchors(self, q: np.ndarray):
        """What the estimates need of each anchor's integers: by level its components cut to BITS bits, in bit planes, and the length of what is cut off."""
        each, r, length = [[] for _ in q], q.astype(float), np.linalg.norm(q, axis=1)
        for level in range(self.levels):
            r = rotated(r, self.width, level)
            low = r.min(axis=1)
            step = (r.max(axis=1) - low) / (2**BITS - 1)
            step[step == 0] = 1.0
            u = np.clip(np.rint((r - low[:, None]) / step[:, None]), 0, 2**BITS - 1).astype(np.int64)
            planes = [packed(((u >> j) & 1).astype(bool)) for j in range(BITS)]
            off = np.linalg.norm(r - (low[:, None] + step[:, None] * u), axis=1)
            for i, a in enumerate(each):
                a.append({"low": low[i], "step": step[i], "sum": int(u[i].sum()), "planes": [p[i] for p in planes], "off": off[i], "length": length[i]})
        return each

    def bounds(self, levels, rows):
        """For each level (lower, upper) bounds of the scores of `rows`, which shrink: send the mask of those to keep."""
        estimate, slip = np.zeros(len(rows)), np.zeros(len(rows))
        root = np.sqrt(self.width)
        for level, a in enumerate(levels):
            words = self.words[level][:, rows]
            ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
            both = np.zeros(len(rows), np.int64)
            for j, plane in enumerate(a["planes"]):
                both += np.bitwise_count(words & plane[:, None]).sum(axis=0, dtype=np.int64) << j
            inner = (a["low"] * (2 * ones - self.width) + a["step"] * (2 * both - a["sum"])) / root
            align = self.align[level][rows]
            estimate, slip = estimate + align * inner, slip + align * a["off"]
            # of the anchor, only what stands square on this code meets what the code has left of the row
            square = np.sqrt(np.maximum(a["length"] ** 2 - np.maximum(np.abs(inner) - a["off"], 0) ** 2, 0))
            gap = self.left[level][rows] * square + slip + 1e-9 * self.length[rows] * a["length"] + 1e-6
            keep = yield estimate - gap, estimate + gap
            rows, estimate, slip = rows[keep], estimate[keep], slip[keep]

    def scores(self, q, rows):
        self.scored += len(rows)
        return self.ints[rows].astype(np.int64) @ q.astype(np.int64)

    def survivors(self, anchor, rows, wanted):
        """`rows` without those that `wanted`, a function of (lower, upper), rules out at some level."""
        self.seen += len(rows)
        each = self.bounds(anchor, rows)
        span = next(each)
        while True:
            keep = wanted(*span)
            rows = rows[keep]
            try:
                span = each.send(keep)
            except StopIteration:
                return rows

    def nearest(self, q, anchor, id_, label, k):
        """(rows, scores) of the k best rows of the same label with another id."""
        rows = self.by_label.get(label, np.zeros(0, np.int64))
        rows = rows[self.id[rows] != id_]
        if len(rows) > k:
            rows = self.survivors(anchor, rows, lambda low, up: up >= (np.partition(low, -k)[-k] if len(low) > k else -np.inf))
        s = self.scores(q, rows)
        o = np.lexsort((self.id[rows], -s))[:k]
        return rows[o], s[o]

    def in_windows(self, q, anchor, label, windows, k):
        """For each window (low, high) of scores the (rows, scores) of the k best rows of other labels inside it."""
        some = [(x, y) for x, y in windows if x <= y]

        def wanted(low, up):
            keep = np.zeros(len(low), bool)
            for x, y in some:
                sure = low[(low >= x) & (up <= y)]
                least = max(x, np.partition(sure, -k)[-k]) if len(sure) >= k else x
                keep |= (up >= least) & (low <= y)
            return keep

        rows = np.flatnonzero(self.label != label) if some else np.zeros(0, np.int64)
        rows = self.survivors(anchor, rows, wanted) if len(rows) else rows
        s = self.scores(q, rows)
        for x, y in windows:
            i = np.flatnonzero((s >= x) & (s <= y))
            o = i[np.lexsort((self.id[rows[i]], -s[i]))[:k]]
            yield rows[o], s[o]


def _search(dim, levels, answer, names):
    """For mapInArrow over (chunk, kind): a chunk's rows (kind 0) are held, its anchors (kind 1) stream past; answer(chunk, anchor row, ints, what anchors() has) gives columns."""

    def run(batches):
        at, held, chunk, found = None, [], None, []

        def out():
            cols = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            return pa.record_batch([pa.array(c) for c in cols], names)

        for b in batches:
            place, kind = b.column("chunk").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))) if b.num_rows else []
            for i, j in zip(cut, [*cut[1:], b.num_rows], strict=True):
                if place[i] != at:
                    at, held, chunk = place[i], [], None
                piece = b.slice(i, j - i)
                if kind[i] == 0:
                    held.append(piece.select(["id", "label", "ints", "words", "factors"]))
                    continue
                if chunk is None and held:
                    chunk, held = Chunk(pa.Table.from_batches(held), dim, levels), []
                if chunk is None:
                    continue
                q = joined(piece.column("ints"), np.int32).reshape(-1, dim)
                found.extend(x for row, ints, coded in zip(piece.to_pylist(), q, chunk.anchors(q), strict=True) for x in answer(chunk, row, ints, coded) if len(x[0]))
                if sum(len(x[0]) for x in found) > 20_000:
                    yield out()
        if found:
            yield out()

    return run


def _met(rows, anchors, chunks):
    """Rows and anchors sorted by chunk, rows first; every chunk gets all anchors."""
    cols = ["chunk", "kind", "id", "label", "ints", "words", "factors", "key", "aims"]
    none = lambda t: F.lit(None).cast(t)
    own = rows.withColumns({"kind": F.lit(0), "key": none("long"), "aims": none("array<struct<j: int, id: long, score: long>>")})
    each = anchors.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "kind": F.lit(1), "words": none("binary"), "factors": none("binary")})
    return own.select(*cols).union(each.select(*cols)).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", every: int = 100, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, levels: int = LEVELS, rows_per_task: int = 65_536) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. A row's score is the integer inner product of floor(scale * x) with the anchor's; higher scores first, ties by smaller id. An
    anchor's positives are its first `n_positives` rows of the same label with another id; for each, the first `n_negatives` rows of other labels with
    low * positive <= 100 * negative <= high * positive are ranked from 1. Rows with a null id, label or vector or a null or non-finite component take
    no part; shorter vectors end in zeros; vectors so long that a score may not fit a long (squared length from 2**56 after scaling) raise an error. Rows that repeat are candidates each and anchors once; rows that share an id but not
    vector and label are anchors each. An empty table, and anchors without positives or negatives, give no rows. Other columns are not looked at.

    The anchors meet all rows in blocks: rows lie in chunks of at most `rows_per_task` or so, held by one task each, past which the anchors stream; a chunk gives an
    anchor's best of its own, and windows over (anchor) and (anchor, positive) merge these. Nothing is cut: what the codes cannot rule out is scored.
    """
    rows, dim, chunks = encoded(vectors, id_col, label_col, vec_col, scale, levels, rows_per_task)
    anchors = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "label", "ints").distinct().withColumn("key", F.xxhash64("label", "ints"))
    anchors = written(anchors)

    def positives(chunk, a, q, coded):
        at, s = chunk.nearest(q, coded, a["id"], a["label"], n_positives)
        yield np.full(len(s), a["id"]), np.full(len(s), a["key"]), chunk.id[at], s

    none = F.lit(None).cast("array<struct<j: int, id: long, score: long>>")
    found = _met(rows, anchors.withColumn("aims", none), chunks).mapInArrow(tidy(_search(dim, levels, positives, ["anchor", "key", "id", "score"])), "anchor long, key long, id long, score long")
    first = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "id")
    best = found.withColumn("j", F.row_number().over(first)).where(F.col("j") <= n_positives)
    aims = best.groupBy(F.col("anchor").alias("id"), "key").agg(F.collect_list(F.struct("j", "id", "score")).alias("aims"))
    aimed = written(anchors.join(aims, ["id", "key"]))

    def negatives(chunk, a, q, coded):
        windows = [(-(-low * x["score"] // 100), high * x["score"] // 100) for x in a["aims"]]
        for x, (at, s) in zip(a["aims"], chunk.in_windows(q, coded, a["label"], windows, n_negatives), strict=True):
            yield (*(np.full(len(s), v) for v in (a["id"], a["key"], x["j"], x["id"])), chunk.id[at], np.full(len(s), x["score"]), s)

    names = ["anchor", "key", "j", "positive_id", "negative_id", "positive_score", "negative_score"]
    near = _met(rows, aimed, chunks).mapInArrow(tidy(_search(dim, levels, negatives, names)), ", ".join(f"{c} long" for c in names))
    by = Window.partitionBy("anchor", "key", "j").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
