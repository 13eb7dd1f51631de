"""Exact repeated substrings: blockwise suffix sorting with cover-sample ranks.

A window is a string of `length` bytes. Two equal windows have the same smallest `K`-gram at the same
place (their anchor), so only windows with equal anchors need to meet:

1. Every text's anchors (about 2 for each 170 windows) are dealt by anchor hash into buckets; an
   anchor that occurs once in the whole corpus takes its windows out of the search, exactly.
2. The texts with repeated anchors send each anchor with the bytes that its windows reach over to
   the suffix bucket of the anchor's hash. Equal stretches in a batch travel once.
3. One suffix bucket at a time is sorted. The anchors are the cover sample: as the difference cover of
   blockwise suffix sorting does for any two suffixes, it meets two equal windows at one common shift, but it takes 1.2 % of the
   positions and not 20 %. The sample's suffixes are ranked first (their bytes, sorted once, with the common prefix of
   neighbours). A window then compares only its bytes left of the anchor, ranked in the same way from the anchor backwards; ties, however long, are
   resolved by the ranks of the sample, cut off at the window's end. Memory: the stretches of one bucket and 16 bytes for each window of a block.
4. Repeated windows are joined to maximal runs in each text.

Equality is decided on bytes; hashes only route and preselect.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import dealt_by, small_batches

K = 32
#: Bytes of texts that are looked at together: some 80 bytes of memory each.
PIECE = 1 << 20
ANCHOR = np.dtype([("h", "<u8"), ("at", "<i8"), ("lo", "<i2"), ("hi", "<i2"), ("doc", "<i4")])
#: size: in the first step 1 for an anchor that its batch has again, 2 for a window of which that is known to the byte; later the bytes of the stretch.
STRETCH = np.dtype([("h", "<u8"), ("c1", "<u8"), ("u1", "<i8"), ("u2", "<i8"), ("at", "<i8"), ("lo", "<i2"), ("hi", "<i2"), ("size", "<i4")])
SPAN = np.dtype([("u1", "<i8"), ("u2", "<i8"), ("a", "<i8"), ("b", "<i8")])


def anchors(data, offsets, length):
    """Anchors of a slice: hash, byte position in the text, and how far before it (lo to hi) the windows start that it stands for."""
    wide = length - K + 1
    sums = A.prefix(data)
    n = len(data) - K + 1
    if n < wide:
        return np.zeros(0, ANCHOR)
    h = A.mix(A.between(sums, np.arange(n), np.arange(K, n + K)))
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    full = -(-n // wide) * wide
    key = np.concatenate((key, np.full(full - n, 2**64 - 1, np.uint64))).reshape(-1, wide)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - length + 1
    start = np.arange(count)
    doc = np.searchsorted(offsets, start, "right") - 1
    whole = start + length <= offsets[doc + 1]
    start, doc = start[whole], doc[whole]
    at = (np.minimum(behind[start], ahead[start + wide - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
    run = A.runs(at)
    last = np.append(run[1:], len(at)) - 1
    out = np.empty(len(run), ANCHOR)
    at = at[run]
    out["h"], out["at"], out["doc"] = h[at], at - offsets[doc[run]], doc[run]
    out["lo"], out["hi"] = at - start[run], at - start[last]
    return out


def _periodic(x, data, offsets, length):
    """Of anchors that stand for one window (where a text repeats itself at once, every byte can be one): (rows to leave out, rows known to be repeated).

    Windows that another of the slice equals byte by byte are repeated; the first of them goes on and stands for all.
    """
    one = np.flatnonzero(x["lo"] == x["hi"])
    begin = offsets[x["doc"][one]] + x["at"][one] - x["lo"][one]
    sums = A.prefix(data)
    w = A.between(sums, begin, begin + length)
    o = np.argsort(w, kind="stable")
    one, begin, w = one[o], begin[o], w[o]
    pair = np.flatnonzero(w[1:] == w[:-1])
    same = np.zeros(len(w), bool)
    for i in range(0, len(pair), 4096):
        p = pair[i : i + 4096]
        reach = np.arange(length)
        same[p + 1] = (data[begin[p][:, None] + reach] == data[begin[p + 1][:, None] + reach]).all(axis=1)
    known = same.copy()
    known[:-1] |= same[1:]
    return one[same], one[known]


def _texts(column, length):
    """(row, first byte, bytes, offsets) of slices; a long text comes in pieces that share length - 1 bytes."""
    for i, j, data, offsets in A.slices(column, PIECE):
        if j - i > 1 or len(data) <= 2 * PIECE:
            yield i, 0, data, offsets
        else:
            for p in range(0, max(1, len(data) - length + 1), PIECE):
                part = data[p : p + PIECE + length - 1]
                yield i, p, part, np.array([0, len(part)])


def _deal_anchors(length, buckets):
    def run(batches):
        for b in batches:
            u = np.stack([np.array(b.column(0)), np.array(b.column(1))], axis=1)
            for i, p, data, offsets in _texts(b.column(2), length):
                x = anchors(data, offsets, length)
                if not len(x):
                    continue
                spans = x[:0]
                if len(x) > len(data) // 40:  # more than twice the usual number
                    out, known = _periodic(x, data, offsets, length)
                    spans = x[known]
                    x = np.delete(x, out)
                x = x[np.argsort(x["h"], kind="stable")]
                first = A.runs(x["h"])
                again = np.repeat(np.diff(np.append(first, len(x))) > 1, np.diff(np.append(first, len(x))))
                once = np.zeros(len(x), bool)
                once[first] = True
                out = np.empty(len(x), STRETCH)
                out["h"], out["at"], out["lo"], out["hi"] = x["h"], x["at"] + p, x["lo"], x["hi"]
                out["u1"], out["u2"] = u[i + x["doc"], 0], u[i + x["doc"], 1]
                out["size"], out["c1"] = again, 0
                # an anchor that this batch has twice is repeated for certain: only its first goes to the bucket of its hash
                bucket = np.where(once, (A.mix(x["h"]) % np.uint64(buckets)).astype(np.int64), out["u1"] % buckets)
                if len(spans):
                    # neighbours together: a stretch of windows, up to what lo holds
                    at = offsets[spans["doc"]] + spans["at"] - spans["lo"]
                    spans, at = spans[np.argsort(at)], np.sort(at)
                    number = np.cumsum(np.concatenate(([0], (np.diff(at) > 1) | (np.diff(spans["doc"]) > 0))))
                    number = number * len(at) + (at - at[A.runs(number)][number]) // 30_000
                    cut = A.runs(number)
                    last = np.append(cut[1:], len(at)) - 1
                    more = np.zeros(len(cut), STRETCH)
                    more["at"] = spans["at"][cut] - spans["lo"][cut] + p + at[last] - at[cut]
                    more["lo"], more["size"] = at[last] - at[cut], 2
                    more["u1"], more["u2"] = u[i + spans["doc"][cut], 0], u[i + spans["doc"][cut], 1]
                    out, bucket = np.concatenate((out, more)), np.concatenate((bucket, more["u1"] % buckets))
                order = np.argsort(bucket, kind="stable")
                cut = A.runs(bucket[order])
                yield pa.record_batch([pa.array(bucket[order][cut]), A.blobs(out[order].view(np.uint8).reshape(-1, STRETCH.itemsize), np.append(cut[1:], len(out)))], ["bucket", "anchors"])

    return run


def _repeated(table):
    x = A.joined(table.column("anchors"), np.uint8).view(STRETCH)
    own = np.where(x["size"] > 1, A.mix(np.arange(len(x), dtype=np.uint64), 77), x["h"])
    o = np.argsort(own)
    hs = own[o]
    same = np.zeros(len(hs) + 1, bool)
    same[1:-1] = hs[1:] == hs[:-1]
    twice = np.zeros(len(x), bool)
    twice[o] = same[1:] | same[:-1]
    x = x[twice | (x["size"] > 0)]
    return _by_text(x, STRETCH, "anchors")


def _by_text(x, kind, name):
    """One row a text (copies of a row bring the same again, which stays once)."""
    x = np.unique(x.view(f"V{kind.itemsize}")).view(kind) if len(x) else x
    x = x[np.lexsort((x["u2"], x["u1"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["u1"][1:] != x["u1"][:-1]) | (x["u2"][1:] != x["u2"][:-1])
    cut = np.flatnonzero(new)
    return pa.table([pa.array(x["u1"][cut].copy()), pa.array(x["u2"][cut].copy()), A.blobs(x.view(np.uint8).reshape(-1, kind.itemsize), np.append(cut[1:], len(x)) if len(cut) else cut)], ["u1", "u2", name])


def _deal_stretches(length, buckets):
    def run(batches):
        for b in batches:
            data, offsets = A.raw(b.column("text"))
            begin = 0
            while begin < len(b):
                # about 2 MB of stretches at a time
                own, total, end = [], 0, begin
                while end < len(b) and (end == begin or total < (2 << 20)):
                    x = np.frombuffer(b"".join(b.column("anchors")[end].as_py()), STRETCH)
                    own.append((x, offsets[end]))
                    total += len(x) * 2 * length
                    end += 1
                begin = end
                x = np.concatenate([x for x, _ in own])
                start = np.concatenate([o + x["at"] - x["lo"] for x, o in own])
                certain = x[x["size"] == 2]
                start, x = start[x["size"] < 2], x[x["size"] < 2]
                size = length + x["lo"].astype(np.int64) - x["hi"]
                at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                flat = data[at]
                stop = np.cumsum(size)
                sums = A.prefix(flat)
                c1 = A.mix(A.between(sums, stop - size, stop)) + (x["lo"].astype(np.uint64) << np.uint64(9)) + size.astype(np.uint64)
                x = x.copy()
                x["c1"], x["size"] = c1, size
                order = np.argsort(c1, kind="stable")
                run = A.runs(c1[order])
                many = np.diff(np.append(run, len(order)))
                first = order[run]
                # equal stretches of one batch: every window in them is repeated; one stretch stands for all (compared byte by byte)
                head = np.repeat(first, many)
                alike = size[head] == size[order]
                gather = np.repeat((stop - size)[head], size[order] * alike) + _ramp(size[order] * alike)
                other = np.repeat((stop - size)[order], size[order] * alike) + _ramp(size[order] * alike)
                bad = flat[gather] != flat[other]
                if bad.any():  # a hash collision: those travel by themselves
                    alike[np.repeat(np.arange(len(order)), size[order] * alike)[bad]] = False
                done = np.zeros(len(x), bool)
                done[order] = alike & (np.repeat(many, many) > 1)
                sent = np.zeros(len(x), bool)
                sent[first] = True
                sent[order[~alike]] = True
                y = np.concatenate((x[done], certain))
                spans = np.empty(len(y), SPAN)
                spans["u1"], spans["u2"], spans["a"], spans["b"] = y["u1"], y["u2"], y["at"] - y["lo"], y["at"] - y["hi"] + length
                pick = np.flatnonzero(sent)
                bucket = (A.mix(x["h"][pick]) % np.uint64(buckets)).astype(np.int64)  # anchors are least hashes: mixed once more
                pick, bucket = pick[np.argsort(bucket, kind="stable")], np.sort(bucket, kind="stable")
                cut = A.runs(bucket)
                edge = np.append(cut[1:], len(pick))
                bytes_ = flat[np.repeat((stop - size)[pick], size[pick]) + _ramp(size[pick])]
                n = len(cut)
                if n:
                    yield pa.record_batch([pa.array(bucket[cut]), A.blobs(x[pick].view(np.uint8).reshape(-1, STRETCH.itemsize), edge), A.blobs(bytes_, np.cumsum(size[pick])[edge - 1]), pa.array([b""] * n, pa.binary())], ["bucket", "stretches", "bytes", "spans"])
                if len(spans):  # what is known already goes by text, so that it meets what copies of the row bring
                    to = spans["u1"] % buckets
                    spans, to = spans[np.argsort(to, kind="stable")], np.sort(to, kind="stable")
                    cut = A.runs(to)
                    yield pa.record_batch([pa.array(to[cut]), pa.array([b""] * len(cut), pa.binary()), pa.array([b""] * len(cut), pa.binary()), A.blobs(spans.view(np.uint8).reshape(-1, SPAN.itemsize), np.append(cut[1:], len(spans)))], ["bucket", "stretches", "bytes", "spans"])

    return run


def _ramp(sizes):
    """0..size-1 for each size, end to end."""
    sizes = np.asarray(sizes, np.int64)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ranked(part):
    """Order of the rows of a byte matrix, and how many bytes each row shares with the one before it in that order."""
    part = np.ascontiguousarray(part)
    order = np.argsort(part.view(f"V{part.shape[1]}").ravel())
    differs = part[order[1:]] != part[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), part.shape[1])
    return order, np.concatenate(([-1], common))


def _classes(order, common, lengths):
    """For each length, the class of every row: rows of a class share so many first bytes."""
    out = np.empty((len(lengths), len(order)), np.int32)
    out[:, order] = np.cumsum(common[None, :] < np.asarray(lengths)[:, None], axis=1, dtype=np.int32)
    return out


def repeated_windows(rows, lo, hi, length):
    """Blockwise suffix sort: `rows` holds stretches with their anchors in one column, a row's windows start hi to lo bytes before it. (row, bytes before the anchor) of the windows that occur twice."""
    reach, n = length - K, len(rows)
    right = _ranked(rows[:, reach : reach + length])
    left = _ranked(rows[:, reach - 1 :: -1]) if reach else None
    found = [np.zeros((0, 2), np.int64)]
    step = max(1, (1 << 19) // n)
    for o in range(int(hi.min()), int(lo.max()) + 1, step):
        before = np.arange(o, min(o + step, int(lo.max()) + 1))
        key = _classes(*left, before).astype(np.int64) * (n + 1) + _classes(*right, length - before)
        outside = (before[:, None] < hi[None, :]) | (before[:, None] > lo[None, :])
        key = np.where(outside, -1 - np.arange(n)[None, :], key)
        order = np.argsort(key, axis=1)
        k = np.take_along_axis(key, order, axis=1)
        same = k[:, 1:] == k[:, :-1]
        twice = np.zeros((len(before), n), bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        at, place = np.nonzero(twice)
        found.append(np.stack((order[at, place], before[at]), axis=1))
    return np.concatenate(found)


def _sorted_bucket(length):
    reach = length - K
    width = reach + length

    def run(table):
        found = [A.joined(table.column("spans"), np.uint8).view(SPAN)]
        x = A.joined(table.column("stretches"), np.uint8).view(STRETCH)
        data = A.joined(table.column("bytes"), np.uint8)
        size = x["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.argsort(x["h"], kind="stable")
        run_ = A.runs(x["h"][order])
        number = np.diff(np.append(run_, len(order)))
        # one anchor hash alone can have nothing to meet; the others go in blocks of whole hashes
        order = order[np.repeat(number > 1, number)]
        number = number[number > 1]
        edge = np.concatenate(([0], np.cumsum(number)))
        i = 0
        while i < len(number):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + 2048, "right")) - 1)
            o = order[edge[i] : edge[j]]
            i = j
            y, s = x[o], size[o]
            rows = np.zeros((len(o), width), np.uint8)
            col = reach - y["lo"].astype(np.int64)
            rows.ravel()[np.repeat(np.arange(len(o)) * width + col, s) + _ramp(s)] = data[np.repeat(begin[o], s) + _ramp(s)]
            row, before = repeated_windows(rows, y["lo"].astype(np.int64), y["hi"].astype(np.int64), length).T
            at = np.sort(row * width + reach - before)
            if not len(at):
                continue
            start = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1))))
            stop = np.append(start[1:], len(at)) - 1
            row = at[start] // width
            spans = np.empty(len(start), SPAN)
            zero = y["at"][row] - reach
            spans["u1"], spans["u2"] = y["u1"][row], y["u2"][row]
            spans["a"], spans["b"] = zero + at[start] % width, zero + at[stop] % width + length
            found.append(spans)
        return _by_text(np.concatenate(found), SPAN, "spans")

    return run


def _cut(batches):
    for b in batches:
        spans, kept = [], []
        data, offsets = A.raw(b.column("text"))
        for i in range(len(b)):
            text = data[offsets[i] : offsets[i + 1]]
            x = np.frombuffer(b"".join(b.column("spans")[i].as_py() or []), SPAN)
            edge = np.zeros(len(text) + 1, np.int32)
            np.add.at(edge, x["a"], 1)
            np.add.at(edge, x["b"], -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
            spans.append([{"start": int(p), "stop": int(q)} for p, q in zip(turn[::2], turn[1::2], strict=True)])
            kept.append(text[~gone].tobytes())
        yield pa.record_batch([b.column("id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "spans", "kept"])


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, anchors_per_bucket: int = 400_000) -> DataFrame:
    """(id_col, n_bytes, spans array<struct<start, stop>>, kept binary), one row for each input row.

    spans: maximal runs of bytes covered by a string of `length` bytes that also starts anywhere else in the
    corpus (the same text and rows that repeat included); kept: the other bytes in order, which need not be
    valid UTF-8. A text of any length is worked off in pieces of PIECE bytes (the last step holds it whole). A null text is empty; texts under `length` bytes have no spans; rows with a null or repeated
    id are treated as any others; an empty table gives an empty result. `length` must be more than K.

    anchors_per_bucket bounds a task: an anchor takes up to 2 * length bytes. An anchor hash with very many
    different surroundings stays in one bucket and is sorted in that bucket's task.
    """
    if length <= K:
        raise ValueError(f"length must be more than {K}")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    use = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    use = use.select(F.xxhash64("id", "text").alias("u1"), F.xxhash64("text", F.lit(1), "id").alias("u2"), "text", "id")
    n_bytes = use.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(n_bytes / 85 / anchors_per_bucket))
    repeated = dealt_by(use.mapInArrow(A.tidy(_deal_anchors(length, buckets)), "bucket long, anchors binary"), "bucket").applyInArrow(A.tidy_group(lambda key, table: _repeated(table)), "u1 long, u2 long, anchors binary")
    repeated = repeated.groupBy("u1", "u2").agg(F.collect_list("anchors").alias("anchors"))
    once = repeated.join(use.select("u1", "u2", "text", "id"), ["u1", "u2"])
    stretches = once.select("anchors", "text", "id").mapInArrow(A.tidy(_deal_stretches(length, 16 * buckets)), "bucket long, stretches binary, bytes binary, spans binary")
    sort = _sorted_bucket(length)
    spans = dealt_by(stretches, "bucket").applyInArrow(A.tidy_group(lambda key, table: sort(table)), "u1 long, u2 long, spans binary").groupBy("u1", "u2").agg(F.collect_list("spans").alias("spans"))
    out = use.select("u1", "u2", "text", "id").join(spans, ["u1", "u2"], "left").select("id", "text", "spans").mapInArrow(A.tidy(_cut), "id long, spans array<struct<start: long, stop: long>>, kept binary")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.stop - x.start)
    return out.select(F.col("id").alias(id_col), (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), "spans", "kept")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The figures of each text's removal: (id_col, n_bytes, n_removed, n_spans, kept_sha256)."""
    return found.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
