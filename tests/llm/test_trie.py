"""The prefix trie against a plain one, whatever the tasks, and its edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorumspark.llm import trie
from quorumspark.llm._order import followed

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int, k int, pos string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def plain(convs):
    """(conv, depth) -> figures, from a dict of turn lists."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        worth = (len(m) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += worth
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def result(nodes):
    rows = nodes.collect()
    out = {(r.conv, r.depth): (r.parent_conv, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    # the tour: every place once, arcs nested
    assert sorted(x for r in rows for x in (r.enter_at, r.exit_at)) == list(range(2 * len(rows)))
    at = {(r.conv, r.depth): r for r in rows}
    for r in rows:
        if r.depth:
            up = at[r.parent_conv, r.depth - 1]
            assert up.enter_at < r.enter_at < r.exit_at < up.exit_at
    return out


def some_convs(seed, n=150):
    r = random.Random(seed)
    texts = ["hi", "", "é中", "longer text " * 5, "a|b,c"]
    return {c: [(r.choice(["user", "assistant", ""]), r.choice(texts[: 2 + c % 4])) for _ in range(r.randrange(1, 7))] for c in r.sample(range(-50, 5000), n)}


@pytest.mark.parametrize("per_task", [20, 200, 100_000])
def test_trie_equals_a_plain_one(spark, per_task):
    convs = some_convs(per_task)
    rows = [(c, k, role, text) for c, seq in convs.items() for k, (role, text) in enumerate(seq)]
    random.Random(1).shuffle(rows)
    assert result(trie.prefix_trie(trie.ordered(turns(spark, rows)), per_task=per_task)) == plain(convs)


def test_hot_first_turn_and_a_long_conversation(spark):
    convs = {c: [("user", "hello"), ("assistant", f"own {c}")] for c in range(300)}
    convs |= {c: [("user", "hello")] for c in range(300, 420)}
    convs[1000] = [("user", f"t{k % 7}") for k in range(1500)]
    convs[1001] = convs[1000][:900]
    rows = [(c, k, role, text) for c, seq in convs.items() for k, (role, text) in enumerate(seq)]
    assert result(trie.prefix_trie(trie.ordered(turns(spark, rows)), per_task=1500)) == plain(convs)


def test_nulls_repeats_and_ties(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, -5, "", ""), (2, 0, "user", "a"), (None, 0, "user", "a"), (3, 1, "b", "y"), (3, 1, "a", "z")]
    convs = {1: [("", ""), ("user", "a"), ("user", "a")], 2: [("", ""), ("user", "a")], 3: [("a", "z"), ("b", "y")]}
    assert result(trie.prefix_trie(trie.ordered(turns(spark, rows)))) == plain(convs)
    none = turns(spark, rows).limit(0)
    assert trie.prefix_trie(trie.ordered(none)).count() == 0


def test_grafted_heads(spark):
    convs = some_convs(3, 120) | {5: [("user", "a")], 6: [("user", "b")], 8: [("user", f"{k}") for k in range(12)]}
    rows = [(c, k, role, text) for c, seq in convs.items() for k, (role, text) in enumerate(seq)]
    got, members = trie.graft(trie.ordered(turns(spark, rows)), F.expr("conv - conv % 5"), F.crc32(F.col("conv").cast("string")) % 9, 8)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    source = {c: c - (abs(c) % 5) * (1 if c >= 0 else -1) for c in convs}
    want = {c: convs.get(source[c], [])[: h[c]] + seq[h[c] :] for c, seq in convs.items()}
    assert any(not seq for seq in want.values())
    assert result(trie.prefix_trie(got, members, per_task=200)) == plain(want)


def test_next_of_a_group_over_many_partitions(spark):
    rows = [(g, v) for g in (1, 2, 7) for v in range(0, {1: 500, 2: 1, 7: 90}[g] * 3, 3)]
    got = followed(spark.createDataFrame(rows, "g long, v long").repartition(5), ["g"], "v", "next", 9).collect()
    top = {g: max(v for h, v in rows if h == g) for g in (1, 2, 7)}
    assert sorted((r.g, r.v) for r in got) == rows and all(r.next == (None if r.v == top[r.g] else r.v + 3) for r in got)


@pytest.mark.parametrize("per_task", [12, 60])
def test_list_ranking_of_scattered_lists(spark, per_task):
    r = random.Random(per_task)
    names = [(r.randrange(-(2**62), 2**62), k) for k in range(200)]
    lists = [names[:150], names[150:151], names[151:]]
    rows = [(a, k, *(seq[i + 1] if i + 1 < len(seq) else (None, None)), 1, i * i) for seq in lists for i, (a, k) in enumerate(seq)]
    got = {(x.a, x.k): (x.n, x.w) for x in trie.list_rank(spark.createDataFrame(rows, "a long, k long, sa long, sk long, n long, w long"), ["n", "w"], per_task).collect()}
    assert got == {name: (i, sum(j * j for j in range(i))) for seq in lists for i, name in enumerate(seq)}
