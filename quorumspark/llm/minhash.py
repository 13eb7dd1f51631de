"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles.

1. A text's words (lower case, split at white space) give shingles of `k` words; texts with the
   same words are one class of copies from here on.
2. Document frequencies: shingle hashes, dealt by hash range into buckets of bounded size, meet
   once. Shingles of very many documents, of which there can only be a bounded number, are found first (each task counts what is frequent in it), counted by
   partial sums, and never dealt: their weights go to the texts directly. Weight of a shingle: tf * idf, idf = 1 + ln((1 + N) / (1 + df)) / ln(1 + N), df and N over all
   documents. A shingle that no other text has cannot be in an intersection; only its weight
   counts. So a text whose shared weight is below `threshold` of its total has no partner at all,
   exactly, and drops out here: most texts do.
3. The rest are sampled (bands * rows samples) and banded; texts that share a band bucket are
   candidates, linked to the bucket's least member, never pair by pair. Components of these
   links are the candidate groups.
4. Every pair inside a candidate group is verified by weighted Jaccard similarity, in blocks of
   texts (a group of m texts is (m / block)^2 / 2 independent tasks, each a matrix product), and
   links at or above the threshold are counted. A task sends back a spanning forest and degrees,
   never pairs.
5. Components of the verified links are the classes.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm import _arrow as A
from quorumspark.llm._graph import components, dealt_by, shared, small_batches

SEGMENT = np.dtype([("k1", "<i8"), ("k2", "<u4"), ("total", "<u4"), ("n", "<u4")])
TEXT = np.dtype([("k1", "<i8"), ("k2", "<u4"), ("total", "<u4"), ("copies", "<i8"), ("n", "<i8")])
ENTRY = np.dtype([("feature", "<u8"), ("weight", "<f4")])
#: Hot shingles at most (16 bytes each in every task).
MOST_HOT = 2_000_000
#: A bucket is worked off in so many ranges of hashes, one after the other.
RANGES = 8


#: Shingles that a task counts at most; rarer ones are forgotten first.
COUNTED = 400_000


def _each_once(h, doc):
    """Distinct hashes and in how many texts each is."""
    o = np.lexsort((doc, h))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(h[new], return_counts=True)


def _keys(k, share):
    """Keys of each text; where a shingle can be in so large a share of the texts as to be frequent, also rows (often, n) of those that may be."""

    def run(batches):
        known, count, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for b in batches:
            text = pc.utf8_lower(pc.fill_null(b.column("text"), ""))
            rows += len(b)
            for i, j, data, offsets in A.slices(text):
                w = A.Words(data, offsets)
                k1, k2 = w.keys()
                none = pa.nulls(j - i, pa.int64())
                yield pa.record_batch([b.column("id").slice(i, j - i), b.column("own").slice(i, j - i), A.signed(k1), A.signed(k2 >> np.uint64(32)), none, none], ["id", "own", "k1", "k2", "often", "n"])
                if share <= 1:
                    h, _, each = w.windows(k)
                    h, n = _each_once(h, np.repeat(np.arange(len(each)), each))
                    known, at = np.unique(np.concatenate((known, h)), return_inverse=True)
                    count = np.bincount(at, weights=np.concatenate((count, n)), minlength=len(known)).astype(np.int64)
                    if len(known) > COUNTED:
                        keep = count > max(1, share * rows / 4)
                        known, count = known[keep], count[keep]
        keep = count > share * rows / 2
        if keep.any():
            n = int(keep.sum())
            none = pa.nulls(n, pa.int64())
            yield pa.record_batch([none, none, none, none, A.signed(known[keep]), pa.array(count[keep])], ["id", "own", "k1", "k2", "often", "n"])

    return run


def _texts_of(batches):
    """(Words) of the slices of a column of texts."""
    for b in batches:
        for _, _, data, offsets in A.slices(pc.utf8_lower(pc.fill_null(b.column(0), ""))):
            yield A.Words(data, offsets)


def _in(sorted_values, h):
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return at, sorted_values[at] == h


def _counted(k, hot):
    """(often, n): in how many texts of a slice each of the hot shingles is."""

    def run(batches):
        for w in _texts_of(batches):
            h, _, each = w.windows(k)
            doc = np.repeat(np.arange(len(each)), each)
            is_hot = _in(hot.value, h)[1]
            if is_hot.any():
                found, n = _each_once(h[is_hot], doc[is_hot])
                yield pa.record_batch([A.signed(found), pa.array(n)], ["often", "n"])

    return run


def _hot_entries(k, buckets, hot, n_docs):
    """The hot shingles' entries of each text, as `_shared` gives those of the others; texts with the same words in a slice send them once."""

    def run(batches):
        shingles, df = hot.value
        for w in _texts_of(batches):
            h, _, each = w.windows(k)
            k1, k2 = (x[: len(each)] for x in w.keys())
            _, first, copies = np.unique(np.stack((k1, k2 >> np.uint64(32)), axis=1), axis=0, return_index=True, return_counts=True)
            at, keep = _in(shingles, h)
            doc = np.repeat(np.arange(len(each)), each)
            n_copies = np.zeros(len(each), np.int64)
            n_copies[first] = copies
            keep &= n_copies[doc] > 0
            at, doc = at[keep], doc[keep]
            if not len(doc):
                continue
            goal = ((k1 >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            o = np.lexsort((at, doc, goal[doc]))
            at, doc = at[o], doc[o]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
            again = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            entries = np.empty(len(doc), ENTRY)
            entries["feature"] = A.mix(shingles[at] + again.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 0x5EED)
            entries["weight"] = _idf(df[at], n_docs)
            run_ = A.runs(doc)
            d = doc[run_]
            texts = np.empty(len(run_), TEXT)
            # negative: copies in this slice only, to be added up
            texts["k1"], texts["k2"], texts["total"], texts["copies"], texts["n"] = k1.view(np.int64)[d], (k2 >> np.uint64(32))[d], each[d], -n_copies[d], np.diff(np.append(run_, len(doc)))
            cut = A.runs(goal[d])
            stop = np.append(cut[1:], len(d))
            yield pa.record_batch([pa.array(goal[d][cut]), A.blobs(texts.view(np.uint8).reshape(-1, TEXT.itemsize), stop), A.blobs(entries.view(np.uint8).reshape(-1, ENTRY.itemsize), np.append(run_, len(doc))[stop])], ["goal", "texts", "entries"])

    return run


def _dealt(k, buckets, hot):
    def run(batches):
        for b in batches:
            text = pc.utf8_lower(pc.fill_null(b.column(0), ""))
            for _, _, data, offsets in A.slices(text):
                w = A.Words(data, offsets)
                h, _, each = w.windows(k)
                doc = np.repeat(np.arange(len(each)), each)
                if hot is not None:
                    cold = ~_in(hot.value[0], h)[1]
                    h, doc = h[cold], doc[cold]
                if not len(h):
                    continue
                k1, k2 = w.keys()
                bucket = (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.uint16 if buckets <= 65536 else np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, doc = bucket[order], doc[order]
                low = h[order].view(np.uint8).reshape(-1, 8)[:, :6]
                cut = A.runs(bucket.astype(np.int64) * len(each) + doc)
                seg = np.empty(len(cut), SEGMENT)
                at = doc[cut]
                seg["k1"], seg["k2"], seg["total"], seg["n"] = k1.view(np.int64)[at], (k2 >> np.uint64(32))[at], each[at], np.diff(np.append(cut, len(doc)))
                own = A.runs(bucket[cut])
                stop = np.append(own[1:], len(cut))
                yield pa.record_batch([pa.array(bucket[cut[own]].astype(np.int64)), A.blobs(seg.view(np.uint8).reshape(-1, SEGMENT.itemsize), stop), A.blobs(low, np.append(cut, len(doc))[stop])], ["bucket", "segments", "hashes"])

    return run


def _idf(df, n_docs):
    return 1 + np.log((1 + n_docs) / (1 + df)) / math.log(1 + n_docs)


def _shared(n_docs, buckets):
    def run(key, table):
        seg = A.joined(table.column("segments"), np.uint8).view(SEGMENT)
        low = A.joined(table.column("hashes"), np.uint8).reshape(-1, 6)
        order = np.lexsort((seg["k2"], seg["k1"]))
        s = seg[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["k1"][1:] != s["k1"][:-1]) | (s["k2"][1:] != s["k2"][:-1])
        cls = np.empty(len(seg), np.int32)
        cls[order] = np.cumsum(new) - 1
        texts = s[new]
        copies = np.bincount(cls)
        # copies of a text bring the same shingles again: one of them stands for all
        chosen = np.zeros(len(seg), bool)
        chosen[order[new]] = True
        cls, chosen = np.repeat(cls, seg["n"]), np.repeat(chosen, seg["n"])
        salt = np.uint64((int(key[0].as_py()) + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        found = []
        for part in range(RANGES):
            at = np.flatnonzero(chosen & (low[:, 4] % RANGES == part))
            wide = np.zeros((len(at), 8), np.uint8)
            wide[:, :6] = low[at]
            found.append(_repeats(wide.view(np.uint64).ravel(), cls[at], copies, n_docs, salt))
        del low, cls, chosen  # what a bucket takes is largest here
        c = np.concatenate([c for c, _ in found])
        entries = np.concatenate([e for _, e in found])
        del found
        goal = (texts["k1"].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        o = np.lexsort((c, goal[c]))
        c, entries = c[o], entries[o]
        run = A.runs(c)
        own = np.empty(len(run), TEXT)
        t = c[run]
        for name in ("k1", "k2", "total"):
            own[name] = texts[name][t]
        own["copies"], own["n"] = copies[t], np.diff(np.append(run, len(c)))
        goal = goal[t].astype(np.int64)
        cut = A.runs(goal)
        stop = np.append(cut[1:], len(goal)) if len(cut) else cut
        return pa.table([pa.array(goal[cut]), A.blobs(own.view(np.uint8).reshape(-1, TEXT.itemsize), stop), A.blobs(entries.view(np.uint8).reshape(-1, ENTRY.itemsize), np.append(run, len(c))[stop])], ["goal", "texts", "entries"])

    return run


def _repeats(h, c, copies, n_docs, salt):
    """(class, entry) of every shingle that two texts have; the nth time that a text has it is a feature of its own, so that sums of least weights are sums over common features."""
    o = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[o][1:] == h[o][:-1]
    o = o[same[1:] | same[:-1]]
    o = o[np.lexsort((c[o], h[o]))]
    h, c = h[o], c[o]
    out = np.zeros(0, ENTRY)
    if not len(h):
        return c, out
    run = A.runs(h)
    size = np.diff(np.append(run, len(h)))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    texts = np.repeat(np.add.reduceat(first.astype(np.int64), run), size)
    df = np.repeat(np.add.reduceat(np.where(first, copies[c], 0), run), size)
    again = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    keep = texts > 1
    h, c, df, again = h[keep], c[keep], df[keep], again[keep]
    out = np.empty(len(h), ENTRY)
    out["feature"] = A.mix(h + salt + again.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    out["weight"] = _idf(df, n_docs)
    return c, out


def _possible(n_docs, threshold):
    """Texts whose shared weight can reach the threshold at all, with their features."""

    def run(key, table):
        texts = A.joined(table.column("texts"), np.uint8).view(TEXT)
        entries = A.joined(table.column("entries"), np.uint8).view(ENTRY)
        order = np.lexsort((texts["k2"], texts["k1"]))
        s = texts[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["k1"][1:] != s["k1"][:-1]) | (s["k2"][1:] != s["k2"][:-1])
        cls = np.empty(len(texts), np.int64)
        cls[order] = np.cumsum(new) - 1
        own = s[new]
        # of a text's hot entries, which several slices can have sent, one record counts
        hot = texts["copies"] < 0
        least = np.full(len(own), len(texts))
        np.minimum.at(least, cls[hot], np.flatnonzero(hot))
        own["copies"] = np.bincount(cls, weights=np.where(hot, -texts["copies"], 0), minlength=len(own))
        np.maximum.at(own["copies"], cls[~hot], texts["copies"][~hot])
        counts = ~hot | (least[cls] == np.arange(len(texts)))
        entries = entries[np.repeat(counts, texts["n"])]
        cls, texts = cls[counts], texts[counts]
        c = np.repeat(cls, texts["n"])
        shared_n, shared_w = np.bincount(c, minlength=len(own)), np.bincount(c, weights=entries["weight"], minlength=len(own))
        total = shared_w + (own["total"].astype(np.int64) - shared_n) * _idf(own["copies"], n_docs)
        good = shared_w >= (threshold - 1e-6) * total
        at = np.flatnonzero(good[c])
        at = at[np.argsort(c[at], kind="stable")]
        stop = np.cumsum(shared_n[good])
        return pa.table([pa.array(own["k1"][good].copy()), pa.array(own["k2"][good].astype(np.int64)), pa.array(total[good]), A.blobs(entries["feature"][at], stop), A.blobs(entries["weight"][at], stop)], ["k1", "k2", "w_total", "features", "weights"])

    return run


def icws(feature, weight, samples, seed=1):
    """`samples` improved consistent weighted samples of a weighted set: equal at a place with probability weighted Jaccard."""
    out = np.empty(samples, np.uint64)
    log_w = np.log(weight.astype(np.float32))[:, None]
    step = max(1, min(samples, (1 << 18) // max(1, len(feature))))
    unit = np.float32(2.0**-32)
    for at in range(0, samples, step):
        k = np.arange(at, min(at + step, samples), dtype=np.uint64) + np.uint64(seed << 20)
        x = A.mix(feature[:, None] ^ A.mix(k)[None, :])
        y = A.mix(x, 0x51ED27)
        low = np.uint64(0xFFFFFFFF)
        u = [((v & low) if part else (v >> np.uint64(32))).astype(np.float32) * unit + unit for v in (x, y) for part in (0, 1)]
        beta = ((x * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.float32) * unit
        r, c = -np.log(np.minimum(u[0] * u[1], 0.9999999)), -np.log(np.minimum(u[2] * u[3], 0.9999999))
        t = np.floor(log_w / r + beta)
        best = np.argmin(np.log(c) - r * (t - beta + 1), axis=0)
        j = np.arange(len(k))
        out[at : at + len(k)] = A.mix(feature[best] ^ A.mix(t[best, j].astype(np.int64).view(np.uint64), 3))
    return out


def _bands(bands, rows):
    def run(batches):
        for b in batches:
            at, hashes = [], []
            for i in range(len(b)):
                f = np.frombuffer(b.column("features")[i].as_py(), np.uint64)
                w = np.frombuffer(b.column("weights")[i].as_py(), np.float32)
                s = icws(f, w, bands * rows).reshape(bands, rows)
                h = np.zeros(bands, np.uint64)
                for r in range(rows):
                    h = A.mix(h * np.uint64(31) + s[:, r], r)
                at.append(b.column("rep")[i].as_py())
                hashes.append(h)
            if at:
                yield pa.record_batch([pa.array(np.repeat(np.array(at, np.int64), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(at))), A.signed(np.concatenate(hashes))], ["rep", "band", "h"])

    return run


def similarities(features, weights, totals):
    """Weighted Jaccard of all pairs of a few weighted sets, by products of slices of the set-by-feature matrix."""
    n = len(features)
    f, d, w = np.concatenate(features), np.repeat(np.arange(n), [len(x) for x in features]), np.concatenate(weights).astype(np.float64)
    _, at, inverse, count = np.unique(f, return_index=True, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[keep]]
    row, w = d[keep], w[at[count > 1]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n))
    step = max(256, (1 << 20) // n)
    for begin in range(0, len(w), step):
        i, j = np.searchsorted(column, (begin, begin + step))
        m = np.zeros((n, min(step, len(w) - begin)))
        m[row[i:j], column[i:j] - begin] = 1
        common += (m * w[begin : begin + step]) @ m.T
    total = np.asarray(totals)
    return common / np.maximum(total[:, None] + total[None, :] - common, 1e-300)


def _verified(threshold):
    def run(key, table):
        part = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
        rep, block = np.array(table.column("rep")), np.array(table.column("block"))
        link = similarities(part("features", np.uint64), part("weights", np.float32), np.array(table.column("w_total"))) >= threshold - 1e-9
        np.fill_diagonal(link, False)
        if key[1].as_py() != key[2].as_py():
            link &= block[:, None] != block[None, :]
        label = np.arange(len(rep))
        while True:
            least = np.minimum(label, np.where(link, label[None, :], len(rep)).min(axis=1))
            if (least == label).all():
                break
            label = least
        degree = link.sum(axis=1)
        keep = degree > 0
        return pa.table([pa.array(rep[keep]), pa.array(rep[label[keep]]), pa.array(degree[keep].astype(np.int64))], ["a", "b", "degree"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, pairs_per_bucket: int = 12_000_000, block: int = 200) -> DataFrame:
    """One row for each input row: (id_col, class_id, rep_id, n_copies, n_links).

    class_id: least id of the near-duplicate class; rep_id: least id among texts with the same
    words; n_copies: rows with these words; n_links: other texts linked to this one at or above
    `threshold`. A text with fewer than `k` words is one shingle. Null and wordless texts are
    copies of each other. Rows that repeat an id each get their row; other columns are not
    looked at; an empty table gives an empty result. A row whose id is null belongs to its class but never names it
    (class_id is null if all its ids are).

    pairs_per_bucket bounds what one task holds of the document-frequency step (about 15 bytes a
    pair); raise it with the executors' memory so that buckets stay fewer at large scale. A shingle of more than a sixteenth
    of that many documents (or, in a corpus of over 2 * 10^12 shingles or so, of one in MOST_HOT of its pairs) is hot and not dealt.
    A text of any length is read whole (some 60 bytes of memory a byte).
    A pair at the threshold is found with probability 1 - (1 - threshold^rows)^bands > 0.9999
    directly, and also if a third text joins its candidate group.
    """
    own = F.col(id_col).cast("long")
    use = docs.select(own.alias("id"), own.alias("own"), F.col(text_col).cast("string").alias("text"))
    return _classes(use, k, threshold, bands, rows, pairs_per_bucket, block).select(F.col("id").alias(id_col), "class_id", "rep_id", "n_copies", "n_links")


def _classes(use, k=5, threshold=0.8, bands=32, rows=6, pairs_per_bucket=12_000_000, block=200):
    """(id, own, class_id, rep_id, n_copies, n_links) for each row of `use` (id, own, text); classes are named by id."""
    spark = use.sparkSession
    small_batches(spark)
    n_docs, n_bytes = use.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(1, math.ceil(n_bytes / 5 / pairs_per_bucket))
    # a shingle of so many texts is hot; as there are n_bytes / 5 pairs or so, MOST_HOT shingles can be at most
    hot_docs = max(pairs_per_bucket // 16, math.ceil(n_bytes / 5 / MOST_HOT))
    found = shared(use.mapInArrow(A.tidy(_keys(k, hot_docs / max(n_docs, 1))), "id long, own long, k1 long, k2 long, often long, n long"))
    keys = found.where("often IS NULL").drop("often", "n")
    reps = keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    hot = None
    if n_docs >= hot_docs:
        guess = found.where("often IS NOT NULL").groupBy("often").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_docs // 2).select("often").collect()
        if guess:
            names = spark.sparkContext.broadcast(np.sort(np.array([r.often for r in guess], np.int64).view(np.uint64)))
            counts = use.select("text").mapInArrow(A.tidy(_counted(k, names)), "often long, n long").groupBy("often").agg(F.sum("n").alias("n")).collect()
            df = {r.often: r.n for r in counts}
            hot = spark.sparkContext.broadcast((names.value, np.array([df.get(h, 0) for h in names.value.view(np.int64).tolist()], np.int64)))
    dealt = use.select("text").mapInArrow(A.tidy(_dealt(k, buckets, hot)), "bucket long, segments binary, hashes binary")
    parts = dealt_by(dealt, "bucket").applyInArrow(A.tidy_group(_shared(max(n_docs, 1), buckets)), "goal long, texts binary, entries binary")
    if hot is not None:
        parts = parts.union(use.select("text").mapInArrow(A.tidy(_hot_entries(k, buckets, hot, max(n_docs, 1))), "goal long, texts binary, entries binary"))
    texts = dealt_by(parts, "goal").applyInArrow(A.tidy_group(_possible(max(n_docs, 1), threshold)), "k1 long, k2 long, w_total double, features binary, weights binary")
    # a number of partitions of its own, so that sampling, which takes longest, is spread over all cores however few bytes the features have
    spread = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k1", "k2")
    texts = shared(spread.join(reps, ["k1", "k2"]).where("rep is not null").select("rep", "w_total", "features", "weights"))
    banded = shared(texts.mapInArrow(A.tidy(_bands(bands, rows)), "rep long, band int, h long"))
    least = banded.groupBy("band", "h").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = components(banded.join(least, ["band", "h"]).select(F.col("rep").alias("a"), "b"))
    size = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = groups.join(size, "root").select(F.col("node").alias("rep"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    links = shared(dealt_by(tasks.join(texts, "rep"), "root", "lo", "hi").applyInArrow(A.tidy_group(_verified(threshold)), "a long, b long, degree long"))
    classes = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.sum("degree").alias("n_links"))
    found = reps.join(classes, "rep", "left").join(degree, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("rep_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return keys.join(found, ["k1", "k2"]).select("id", "own", "class_id", "rep_id", "n_copies", "n_links")


def _names(text, own):
    """Two 64-bit names of a row by its text and id."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(3), whole, own.isNull(), own), F.xxhash64(own, own.isNull(), whole, F.lit(4))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` of each near-duplicate group, all columns kept: the one with the least id, a null id last.

    Rows are told apart by id and text: different texts may share an id or have none. Of rows that repeat, one stays. A row is named by a 64-bit hash;
    rows of different second hashes that share a name are found first (some three pairs in 10^10 rows) and go by their second one. Null and wordless texts are copies of each
    other; an empty table gives an empty table; columns of any other name go along.
    """
    text, own = F.col(text_col).cast("string"), F.col(id_col)
    one, two = _names(text, own)
    both = docs.select(one.alias("a"), two.alias("b")).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    clash = [r.a for r in both.where("lo <> hi").select("a").collect()]
    name = F.when(one.isin(clash), two).otherwise(one) if clash else one
    rows = shared(_classes(docs.select(name.alias("id"), own.cast("long").alias("own"), text.alias("text")), **options).select("id", "own", "class_id"))
    first = rows.groupBy("class_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "id"))["id"].alias("id"))
    kept = rows.join(first, "id", "left_semi").groupBy(F.col("id").alias("_minhash_name")).agg(F.count("*").alias("_minhash_repeats"))
    found = docs.join(kept, name == F.col("_minhash_name"))
    again = found.where("_minhash_repeats > 1").dropDuplicates(["_minhash_name"])
    return found.where("_minhash_repeats = 1").union(again).select(*docs.columns)
