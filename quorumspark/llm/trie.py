"""A prefix trie of conversations: one node for each distinct sequence of first turns.

Figures of whole subtrees come from an Euler tour: every node has an enter and an exit arc, every arc a successor; the tour, a
linked list over all arcs, is ranked by contraction. In each round arcs meet in tasks, chains within a task become one
segment with their sums, and the segments are the next, shorter list; afterwards places and running sums are handed down again.
A subtree's figure is the running sum at its exit less the one at its entry.

A node is named by its smallest member and its depth: a conversation is the smallest member of the nodes on one stretch of its own
path, and the child it shares with its parent is the first child. So a tour runs down a conversation's own stretch at once, and
most of the list contracts where arcs are dealt by conversation.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quorumspark.llm._arrow import tidy
from quorumspark.llm._graph import written
from quorumspark.llm._order import followed, parts


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, c1, c2, bytes): turns numbered from 1, with two hashes of (role, text) and the text's UTF-8 bytes.

    Turns go by number (null first), then role and hash of the text; rows that repeat are turns of their own. A null role or text is empty; rows
    without a conversation id are left out. Texts are hashed where they are read and not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("c1"), F.xxhash64(text, F.lit(1), role).alias("c2"), F.octet_length(text).cast("long").alias("bytes"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "c1", "c2")).cast("long")
    return rows.select("conv", at.alias("pos"), "c1", "c2", "bytes")


def graft(rows: DataFrame, source: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Ordered turns anew, and the conversations: each begins with the first `heads` (at most `most`) turns of the conversation `source`, both expressions over its id "conv"; its own turns from there on follow.

    A source with fewer turns gives all, one that does not exist gives none. The second table (conv) has all ids of `rows`, as a conversation may be left without turns.
    """
    rows = written(rows)
    ids = rows.groupBy("conv").agg(F.max("pos").alias("n"))
    of = ids.select(F.col("conv").alias("source"), F.col("n").alias("n_source"))
    want = written(ids.withColumn("source", source).withColumn("h", heads).join(of, "source", "left").withColumn("take", F.least("h", F.coalesce("n_source", F.lit(0)))).select("conv", "source", "h", "take"))
    first = rows.where(F.col("pos") <= most).withColumnRenamed("conv", "source").join(want, "source").where("pos <= take")
    own = rows.join(want, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("take"))
    cols = ["conv", "pos", "c1", "c2", "bytes"]
    return first.select(*cols).union(own.select(*cols)), want.select("conv")


def _contract(sums):
    """For mapInArrow: chains of a partition's list elements (a, k) -> (sa, sk)."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        n = t.num_rows
        col = lambda c: t.column(c).to_numpy()
        a, k = col("a"), col("k")
        end = t.column("sa").is_null().to_numpy()
        sa, sk = (t.column(c).fill_null(-1).to_numpy() for c in ("sa", "sk"))
        names, at = np.unique(a, return_inverse=True)
        width = max(int(k.max()), int(sk.max())) + 1
        code = at * width + k
        by = np.argsort(code)
        code = code[by]
        s = np.minimum(np.searchsorted(names, sa), len(names) - 1)
        here = ~end & (names[s] == sa)
        aim = s * width + sk
        p = np.minimum(np.searchsorted(code, aim), n - 1)
        here &= code[p] == aim
        head = np.arange(n)
        before = np.flatnonzero(here)
        head[by[p[here]]] = before
        # each element points at an earlier one of its chain, in the end at the first; doubled each time
        w = np.stack([col(x) for x in sums])
        off = np.where(head != np.arange(n), w[:, head], 0)
        while True:
            further = head[head]
            if (further == head).all():
                break
            off += off[:, head]
            head = further
        out = {"a": a, "k": k, "ha": a[head], "hk": k[head], **{f"off_{x}": off[i] for i, x in enumerate(sums)}, "tail": ~here}
        cols = [pa.array(v) for v in out.values()] + [t.column(c).combine_chunks() for c in ("sa", "sk")] + [pa.array(off[i] + w[i]) for i in range(len(sums))]
        whole = pa.Table.from_arrays(cols, names=[*out, "sa", "sk", *sums])
        yield from whole.to_batches(max_chunksize=50_000)

    return run


def list_rank(elements: DataFrame, sums: list[str], per_task: int = 32_768) -> DataFrame:
    """(a, k, *sums): for each element (a, k) of linked lists, the sums of `sums` over all elements before it in its list. Successors are (sa, sk), null at an end.

    Rounds of contraction: elements are dealt to tasks of about `per_task`, by ranges of (a, k) and, every second time, by random
    mates (an element goes by its own key or by its successor's, as a hash of key and round says, so that a quarter of the links is expected to meet whatever the keys are). Each task joins the chains
    that it holds, so lists shrink by a constant factor a round or more, until one task's worth is left. Every round is a written table.
    """
    keep = ["a", "k", "sa", "sk", *sums]
    schema = StructType([*(StructField(c, LongType()) for c in ("a", "k", "ha", "hk", *(f"off_{x}" for x in sums))), StructField("tail", BooleanType()), *(StructField(c, LongType()) for c in ("sa", "sk", *sums))])
    now, levels = written(elements.select(*keep)), []
    while True:
        n = -(-now.count() // per_task)
        r = len(levels)
        if n <= 1:
            dealt = now.repartition(1)
        elif r % 2 == 0:
            dealt = now.repartitionByRange(n, "a", "k")
        else:
            own = F.pmod(F.xxhash64(F.lit(r), "a", "k"), F.lit(2)) == 0
            mate = lambda c, s: F.when(own | F.col(s).isNull(), F.col(c)).otherwise(F.col(s))
            dealt = now.repartition(n, mate("a", "sa"), mate("k", "sk"))
        levels.append(written(dealt.mapInArrow(tidy(_contract(sums)), schema)))
        if n <= 1:
            break
        now = levels[-1].where("tail").select(F.col("ha").alias("a"), F.col("hk").alias("k"), "sa", "sk", *sums)
    place = levels.pop().select("a", "k", *(F.col(f"off_{x}").alias(x) for x in sums))
    for level in reversed(levels):
        up = place.select(F.col("a").alias("ha"), F.col("k").alias("hk"), *(F.col(x).alias(f"up_{x}") for x in sums))
        place = level.join(up, ["ha", "hk"]).select("a", "k", *((F.col(f"off_{x}") + F.col(f"up_{x}")).alias(x) for x in sums))
    return place


_KEY = ["x1", "x2", "depth"]


def _ends(prefixes):
    """(x1, x2, depth, ends_sha256): the digest of the ids that end at a node. Ids are range-sorted and joined to pieces in many tasks; a node's pieces then stream through its hash in order, whose state is all that is held."""

    def pieces(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in _KEY])
            ids = b.column("conv").to_pylist()
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))).tolist()
            text = [",".join(map(str, ids[i:j])) for i, j in zip(cut, [*cut[1:], len(ids)], strict=True)]
            yield pa.record_batch([*(pa.array(x[cut]) for x in key), pa.array([ids[i] for i in cut], pa.int64()), pa.array(text, pa.string())], [*_KEY, "first", "piece"])

    def digests(batches):
        held, state, done = None, None, []

        def out():
            rows = list(zip(*done, strict=True))
            return pa.record_batch([*(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string())], [*_KEY, "ends_sha256"])

        for b in batches:
            for *key, piece in zip(*(b.column(c).to_pylist() for c in (*_KEY, "piece")), strict=True):
                if key != held:
                    if state:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if len(done) > 20_000:
                yield out()
                done.clear()
        if state:
            done.append((*held, state.hexdigest()))
            yield out()

    n = parts(prefixes)
    rows = prefixes.where("last").select(*_KEY, "conv")
    some = rows.repartitionByRange(n, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(tidy(pieces), "x1 long, x2 long, depth long, first long, piece string")
    return some.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(tidy(digests), "x1 long, x2 long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, members: DataFrame | None = None, per_task: int = 32_768) -> DataFrame:
    """One row a node: (conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256, enter_at, exit_at).

    `rows` are turns as `ordered` gives them; `members` (conv) adds conversations without turns. A node of depth d is a distinct sequence of first d turns (role and
    text, compared by two 64-bit hashes of every turn and its place); the root has depth 0 and no text. conv: its smallest member; n_convs: conversations that begin
    with it; n_leaves and saved: nodes without children in its subtree, and the sum over its subtree of (n_convs - 1) times the bytes of a node's last text;
    ends_sha256: digest of the ids that end here, ascending, comma-joined; enter_at, exit_at: places of its arcs in the tour, children in order of conv. No conversations give no nodes. A conversation of any length, and a
    node of any number of children or members, is spread over tasks but for the window that numbers a conversation's turns, which streams.
    """
    whole = Window.partitionBy("conv").orderBy("pos")
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h1, h2 = F.xxhash64("pos", "c1", "c2"), F.xxhash64("c2", "c1", "pos")
    rows = rows.select("conv", "pos", "bytes", h1.alias("h1"), h2.alias("h2"))
    chains = rows.select("conv", F.col("pos").alias("depth"), "bytes", "h1", "h2", F.bit_xor("h1").over(upto).alias("x1"), F.bit_xor("h2").over(upto).alias("x2"), F.lead("pos").over(whole).isNull().alias("last"))
    ids = rows.groupBy("conv").agg(F.lit(False).alias("last"))
    if members is not None:
        ids = members.select("conv").distinct().join(ids, "conv", "left").select("conv", F.col("last").isNull().alias("last"))
    zero = F.lit(0).cast("long")
    roots = ids.select("conv", zero.alias("depth"), zero.alias("bytes"), *(zero.alias(c) for c in ("x1", "x2", "p1", "p2")), "last")
    chains = chains.withColumn("p1", F.col("x1").bitwiseXOR(F.col("h1"))).withColumn("p2", F.col("x2").bitwiseXOR(F.col("h2")))
    cols = ["conv", "depth", "bytes", "x1", "x2", "p1", "p2", "last"]
    prefixes = written(chains.select(*cols).union(roots.select(*cols)))
    nodes = written(prefixes.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("p1", "p2", "bytes"))))

    # a conversation's own stretch of nodes; its top hangs below a node of a smaller conversation
    stretch = Window.partitionBy("conv").orderBy("depth")
    marked = nodes.withColumn("top", F.lag("depth").over(stretch).isNull()).withColumn("own", F.lead("depth").over(stretch).isNotNull())
    marked = written(marked)
    root = marked.where("depth = 0").select(F.col("conv").alias("root"))
    tops = marked.where("top AND depth > 0")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv").alias("parent"))
    sides = tops.where("depth > 1").join(above.where("depth > 1"), ["depth", "p1", "p2"]).select("parent", "depth", "conv")
    sides = sides.union(tops.where("depth = 1").crossJoin(F.broadcast(root)).select("root", "depth", "conv"))
    sides = followed(sides, ["parent", "depth"], "conv", "next")
    first = sides.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv").alias("side"), F.count("*").alias("n_sides"))
    linked = marked.join(first, ["conv", "depth"], "left").join(sides.select("conv", "depth", "parent", "next"), ["conv", "depth"], "left")
    linked = linked.withColumn("beside", F.lag("side").over(stretch))
    linked = written(linked.select("conv", *_KEY, "n_convs", "bytes", "top", "own", "parent", "next", "side", "beside", (F.coalesce("n_sides", F.lit(0)) + F.col("own").cast("long")).alias("n_children")))

    def to(conv, depth, kind):
        return F.struct(F.col(conv).alias("sa"), (2 * (F.col("depth") + depth) + kind).alias("sk"))

    into = F.when(F.col("own"), to("conv", 1, 0)).when(F.col("side").isNotNull(), to("side", 1, 0)).otherwise(to("conv", 0, 1))
    out_of = F.when(~F.col("top"), F.when(F.col("beside").isNotNull(), to("beside", 0, 0)).otherwise(to("conv", -1, 1))).when(F.col("next").isNotNull(), to("next", 0, 0)).when(F.col("parent").isNotNull(), to("parent", -1, 1))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    arc = lambda kind, succ, x, y: F.struct((2 * F.col("depth") + kind).alias("k"), succ.alias("s"), F.lit(1).cast("long").alias("n"), x.alias("leaves"), y.alias("saved"))
    arcs = linked.select(F.col("conv").alias("a"), F.explode(F.array(arc(0, into, leaf, saved), arc(1, out_of, zero, zero))).alias("e")).select("a", "e.k", "e.s.*", "e.n", "e.leaves", "e.saved")
    place = list_rank(arcs, ["n", "leaves", "saved"], per_task)
    side = lambda c, odd: F.max(F.when(F.pmod("k", F.lit(2)) == odd, F.col(c)))
    within = place.groupBy(F.col("a").alias("conv"), F.floor(F.col("k") / 2).alias("depth")).agg(*((side(c, 1) - side(c, 0)).alias(c) for c in ("leaves", "saved")), side("n", 0).alias("enter_at"), side("n", 1).alias("exit_at"))
    ends = _ends(prefixes)
    out = linked.join(within, ["conv", "depth"]).join(ends, _KEY, "left")
    parent = F.when(~F.col("top"), F.col("conv")).otherwise(F.col("parent"))
    return out.select("conv", "depth", parent.alias("parent_conv"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "enter_at", "exit_at")
