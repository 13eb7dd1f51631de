"""Regressions against numpy on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumspark.operators import absorb, regress, resample


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [(f"e{i % 9}", f"i{i % 5}", float(x), float(z), float(1 + 2 * x - z + (i % 9) / 3 + e)) for i, (x, z, e) in enumerate(rng.normal(size=(300, 3)))]
    return rows, spark.createDataFrame([*rows, ("e0", "i0", None, 1.0, 1.0)], "entity string, item string, x double, z double, y double")


def test_draws_are_weighted_least_squares(spark, table):
    rows, df = table
    w = resample.weights(df.select("entity").distinct(), 3)
    weight = {(r.draw, r.entity): r.w for r in w.collect()}
    got = {(r.draw, r.term): r.x for r in regress.wls_draws(df, w, [], F.col("y"), {"x": F.col("x"), "z": F.col("z")}).collect()}
    a, y = np.array([(1, r[2], r[3]) for r in rows]), np.array([r[4] for r in rows])
    for draw in {d for d, _ in weight}:
        v = np.sqrt([weight.get((draw, r[0]), 0) for r in rows])
        want = np.linalg.lstsq(a * v[:, None], y * v, rcond=None)[0]
        assert np.allclose([got[draw, t] for t in ("intercept", "x", "z")], want)


def test_singular_draws_are_null(spark, table):
    _, df = table
    w = resample.weights(df.select("entity").distinct(), 1)
    assert all(r.x is None for r in regress.wls_draws(df, w, [], F.col("y"), {"x": F.col("x"), "twice": 2 * F.col("x")}).collect())


def dummies(rows, k):
    return np.array([[r[k] == v for v in sorted({r[k] for r in rows})] for r in rows], float)


def by_hand(a, y, groups, k):
    """Coefficients of the last k columns, their clustered covariance, r2 and rank, by numpy on all columns."""
    inverse = np.linalg.pinv(a.T @ a)
    beta = inverse @ a.T @ y
    u = y - a @ beta
    s = np.array([(a * u[:, None])[np.array(groups) == g].sum(axis=0) for g in sorted(set(groups))])
    n, g, rank = len(y), len(s), np.linalg.matrix_rank(a)
    cov = inverse @ s.T @ s @ inverse * g / (g - 1) * (n - 1) / (n - rank)
    return beta[-k:] if k else beta[:0], cov[-k:, -k:] if k else cov[:0, :0], 1 - u @ u / ((y - y.mean()) ** 2).sum(), rank


@pytest.mark.parametrize("factors", [[], ["entity"], ["entity", "item"], ["entity", "item", "year"]])
def test_absorbed_factors_equal_dummies(spark, factors):
    rng = np.random.default_rng(11)
    rows = [(f"e{min(rng.integers(0, 9), rng.integers(0, 9))}", f"i{rng.integers(0, 5)}", int(rng.integers(0, 4)), float(x), float(z), float(2 * x - z + e)) for x, z, e in rng.normal(size=(240, 3))]
    rows = [(*r[:5], r[5] + int(r[0][1]) / 3 - int(r[1][1]) / 2 + r[2]) for r in rows]
    df = spark.createDataFrame([*rows, ("e0", "i0", 1, None, 1.0, 1.0)], "entity string, item string, year int, x double, z double, y double")
    fit = absorb.fit(df, F.col("y"), {"x": F.col("x"), "z": F.col("z")}, factors, "entity")
    at = {"entity": 0, "item": 1, "year": 2}
    a = np.column_stack([np.ones(len(rows)), *(dummies(rows, at[f]) for f in factors), [r[3] for r in rows], [r[4] for r in rows]])
    beta, cov, r2, rank = by_hand(a, np.array([r[5] for r in rows]), [r[0] for r in rows], 2)
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov) and np.isclose(fit.r2, r2) and fit.n_params == rank and (fit.n, fit.n_clusters) == (240, 9)
    got = {(r.term_a, r.term_b): r.v for r in fit.covariance().collect()}
    assert np.isclose(got["x", "z"], cov[0, 1]) and len(got) == 4


def test_rank_counts_the_components_of_the_level_graph(spark):
    # two blocks that share no level, and one of a single pair
    rows = [(f"a{b}{i}", f"b{b}{j}", float((i * 7 + j * 3 + b) % 5), float(i + j + b)) for b in range(2) for i in range(4) for j in range(3)] + [("lone", "only", 1.0, 2.0), ("lone", "only", 2.0, 3.0)]
    fit = absorb.fit(spark.createDataFrame(rows, "a string, b string, x double, y double"), F.col("y"), {"x": F.col("x")}, ["a", "b"], "a")
    a = np.column_stack([dummies(rows, 0), dummies(rows, 1), [r[2] for r in rows]])
    assert fit.n_params == np.linalg.matrix_rank(a)


def test_many_levels_need_no_matrix_of_levels(spark):
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    rows = spark.range(20_000).select(h(1, 2500).alias("a"), h(2, 40).alias("b"), (h(3, 101) / 50.0).alias("x")).withColumn("y", 3 * F.col("x") + F.col("a") / 1000 - F.col("b") / 500)
    fit = absorb.fit(rows, F.col("y"), {"x": F.col("x")}, ["a", "b"], "a", tol=1e-7)
    assert abs(fit.beta[0] - 3) < 1e-5 and fit.r2 > 0.999999
    levels = sum(rows.agg(F.count_distinct(c)).first()[0] for c in "ab")
    assert fit.n_params == levels - 1 + 1 > 2500


def test_size_levels_and_marginals_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{rng.integers(0, 8)}", f"i{rng.integers(0, 4)}", int(n), float(rng.normal() + 1 / n)) for n in rng.integers(1, 9, 300)]
    df = spark.createDataFrame(rows, "entity string, item string, n int, y double")
    levels, steps = absorb.size_levels(df, "y", "n", ["entity", "item"], "entity", 3, 6)
    level, step = ({(r.series, r["size"]): r for r in t.collect()} for t in (levels, steps))
    size, y, groups = np.array([min(r[2], 6) for r in rows]), np.array([r[3] for r in rows]), [r[0] for r in rows]
    raw = np.array([size == s for s in range(1, 7)], float).T
    b, v, _, _ = by_hand(raw, y, groups, 6)
    assert np.allclose([level["raw", s].est for s in range(1, 7)], b) and np.allclose([step["raw", s].d for s in range(2, 7)], np.diff(b))
    assert np.allclose([step["raw", s].se for s in range(2, 7)], [np.sqrt(v[i, i] + v[i - 1, i - 1] - 2 * v[i, i - 1]) for i in range(1, 6)])
    others = [s for s in range(1, 7) if s != 3]
    c, w, _, _ = by_hand(np.column_stack([dummies(rows, 0), dummies(rows, 1), *(size == s for s in others)]), y, groups, 5)
    full, cov = np.insert(c, 2, 0.0), np.insert(np.insert(w, 2, 0.0, axis=0), 2, 0.0, axis=1)
    assert np.allclose([level["adjusted", s].est for s in range(1, 7)], full + b[2]) and level["adjusted", 3].se == 0
    assert np.allclose([step["adjusted", s].d for s in range(2, 7)], np.diff(full))
    assert np.allclose([step["adjusted", s].se for s in range(2, 7)], [np.sqrt(cov[i, i] + cov[i - 1, i - 1] - 2 * cov[i, i - 1]) for i in range(1, 6)])
    zones = {r.zone: r for r in absorb.zones(steps.where("series = 'adjusted'"), {"low": (2, 3), "high": (4, 99)}).collect()}
    assert zones["low"].positions == 2 and np.isclose(zones["high"].mean_d, np.diff(full)[2:].mean(), atol=1e-6)


def test_sizes_that_do_not_occur_have_rows_without_estimates(spark):
    rows = [(f"e{i % 5}", f"i{i % 3}", 9 - (i % 7 == 0) * 5, float(i % 11)) for i in range(60)]  # 4 and 9, of 2 to 6 or more
    df = spark.createDataFrame(rows, "entity string, item string, n int, y double")
    levels, steps = absorb.size_levels(df, "y", "n", ["entity", "item"], "entity", 5, 6, 2)
    level, step = ({(r.series, r["size"]): r for r in t.collect()} for t in (levels, steps))
    assert set(level) == {(s, n) for s in ("raw", "adjusted") for n in range(2, 7)} and set(step) == {(s, n) for s in ("raw", "adjusted") for n in range(3, 7)}
    assert all(np.isnan(r.est) for r in level.values()) and all(np.isnan(r.d) and np.isnan(r.se) for r in step.values())
    assert {k for k, r in level.items() if not np.isnan(r.se)} == {("adjusted", 5)} and level["adjusted", 5].se == 0
    zones = {r.zone: r for r in absorb.zones(steps.where("series = 'adjusted'"), {"low": (2, 3), "high": (4, 99)}).collect()}
    assert (zones["low"].positions, zones["high"].positions) == (1, 3) and np.isnan(zones["high"].mean_d) and np.isnan(zones["low"].most_d)
    # all sizes occur, but two entities have one size each: the size is the entity
    own = spark.createDataFrame([(f"e{i % 2}", "i", 2 + i % 2, float(i % 5)) for i in range(20)], "entity string, item string, n int, y double")
    got = {(r.series, r["size"]): r.est for r in absorb.size_levels(own, "y", "n", ["entity", "item"], "entity", 2, 3, 2)[0].collect()}
    assert np.isclose(got["raw", 2], 2.0) and np.isnan(got["adjusted", 3])


def test_empty_fit_and_groupings(spark):
    none = spark.createDataFrame([], "a string, x double, y double")
    fit = absorb.fit(none, F.col("y"), {"x": F.col("x")}, ["a"], "a")
    assert fit.n == 0 and np.isnan(fit.beta[0])
    rows = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 4.0), ("b", "q", 5.0), ("b", "q", None)], "g string, h string, y double")
    got = {r.grouping: (r.r2, r.n_levels) for r in absorb.nested_r2(rows, "y", {"g": ["g"], "both": ["g", "h"]}).collect()}
    assert got == {"g": (0.9, 2), "both": (1.0, None)}


def test_ranks_of_groups(spark):
    rows = spark.createDataFrame([(f"g{i}", None if i == 5 else float(i * i % 7)) for i in range(12)], "g string, r2 double")
    got = [r.g for r in regress.ranked(rows, "r2", ["g"]).orderBy("rank").collect()]
    assert got == [r.g for r in rows.orderBy(F.desc_nulls_last("r2"), "g").collect()]
