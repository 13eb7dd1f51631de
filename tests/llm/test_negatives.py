"""Hard negatives against brute force, the intervals against exact scores, and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from quorumspark.llm import negatives as N
from quorumspark.llm._arrow import blobs

SCHEMA = "vec_id long, label int, embedding array<float>, id string, chunk string, score double, words string, kind int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0.0, "w", 5) for r in rows], SCHEMA)


def brute(rows, every=100, n_pos=5, n_neg=10, low=30, high=90):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, y, v in {(i, y, tuple(v)) for i, y, v in ok if i % every == 0}:
        score = sorted((-dot(v, w), i, z) for i, z, w in ok)
        for s, p, _ in [x for x in score if x[2] == y and x[1] != a][:n_pos]:
            inside = [x for x in score if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out)


def some_rows(seed, n=900, dim=24, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dim))
    rows = [(int(i), int(y), (0.3 * centres[y] + 0.5 * r.normal(size=dim)).tolist()) for i, y in zip(r.permutation(3 * n)[:n], r.integers(0, labels, n), strict=True)]
    return rows + [(100, 1, rows[0][2])]


@pytest.mark.parametrize(("seed", "dim", "levels", "rows_per_task"), [(1, 24, 6, 65_536), (2, 70, 1, 100), (3, 3, 4, 60)])
def test_equals_brute_force(spark, seed, dim, levels, rows_per_task):
    rows = some_rows(seed, dim=dim)
    got = N.mine(table(spark, rows), levels=levels, rows_per_task=rows_per_task)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_ties_copies_and_odd_rows(spark):
    r = random.Random(4)
    base = [[r.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(5)] for _ in range(6)]
    # a third of the rows are one vector; many scores tie
    rows = [(i, i % 3, base[0] if i % 3 == 0 else base[r.randrange(6)]) for i in range(400)]
    rows += [(None, 1, base[1]), (500, None, base[1]), (501, 1, None), (502, 1, [0.5, None, 0.5, 0.5, 0.5]), (600, 2, [math.nan] * 5), (700, 2, [math.inf] + [0.5] * 4)]
    rows += [(800, 1, [0.5, 0.5]), (801, 1, []), (900, 1, [0.0] * 5), (300, 0, base[0]), (300, 0, base[0]), (301, 1, base[2]), (301, 1, base[2])]
    rows = [(i, y, v) for i, y, v in rows]
    got = sorted(map(tuple, N.mine(table(spark, rows), rows_per_task=50).collect()))
    assert got == brute(rows) and got


def test_empty_and_no_answers(spark):
    rows = some_rows(5, 30)
    assert N.mine(table(spark, rows).limit(0)).count() == 0
    assert N.mine(table(spark, [(i, 1, v) for i, _, v in rows])).count() == 0
    assert N.mine(table(spark, [(100, 1, [1.0]), (101, 2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="too long"):
        N.mine(table(spark, [(100, 1, [3e6])]))


@pytest.mark.parametrize("dim", [1, 5, 64, 65, 300])
def test_intervals_hold_every_score(dim):
    r = np.random.default_rng(dim)
    x = np.concatenate([np.floor(256 * r.normal(size=(300, dim))), np.zeros((1, dim)), np.full((1, dim), 7.0), np.floor(1e6 * r.normal(size=(5, dim)))])
    words, align, left = N.codes(x, N.width_of(dim), 6)
    n, stops = len(x), np.arange(1, len(x) + 1)
    t = pa.table({"id": np.arange(n), "label": np.zeros(n, np.int64), "ints": blobs(x.astype(np.int32), stops), "words": blobs(words.reshape(n, -1), stops), "factors": blobs(np.concatenate((align, left, np.linalg.norm(x, axis=1)[:, None]), axis=1), stops)})
    chunk = N.Chunk(t, dim, 6)
    width = None
    for q, coded in zip(x[-12:].astype(np.int64), chunk.anchors(x[-12:].astype(np.int64)), strict=True):
        exact, rows = x.astype(np.int64) @ q, np.arange(n)
        each = chunk.bounds(coded, rows)
        low, up = next(each)
        for _ in range(5):
            assert (low <= exact).all() and (exact <= up).all()
            width = (up - low)[:300].mean()
            low, up = each.send(np.ones(n, bool))
        assert (low <= exact).all() and (exact <= up).all()
    # the interval narrows with every level
    assert (up - low)[:300].mean() < width
