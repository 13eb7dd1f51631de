"""Order statistics, samples, name swaps and count bootstraps against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumspark.functions.core import u
from quorumspark.operators import evidence, identity, resample, select, texts


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    groups = {"wide": np.concatenate([r.normal(size=300) * 1e300, [-1.7e308, 1.7e308, 0.0]]), "ties": r.integers(0, 4, 500).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: r.lognormal(0, 9, 400)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("ties", None), ("none", None)]
    got = {x.g: x.q for x in select.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], F.col("x"), [0.0, 0.025, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v / 4, [0.0, 0.025, 0.5, 0.9, 1.0]) * 4, rtol=1e-9)
    assert [x.q for x in select.quantiles(spark.createDataFrame([], "x double"), [], F.col("x"), [0.5]).collect()] == [[None]]


@pytest.mark.parametrize("k", [0, 1, 37, 10_000])
def test_smallest_equal_a_sort(spark, k):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g")).where("g < 2 OR id < 30").withColumn("h", u("t", "id"))
    # a third of all rows share one hash
    rows = rows.withColumn("h", F.when(F.col("id") % 9 == 0, F.lit(12345)).otherwise(F.col("h")))
    got = {r.id for r in select.mark_smallest(rows, ["g"], k, "h", ["id"]).where("smallest").collect()}
    own = {}
    for r in rows.collect():
        own.setdefault(r.g, []).append((r.h, r.id))
    assert got == {i for v in own.values() for _, i in sorted(v)[:k]}
    assert select.mark_smallest(rows, ["g"], k, "h", ["id"]).count() == rows.count()


@pytest.mark.parametrize(("budget", "floor"), [(40, 2), (5, 3), (0, 1), (10_000, 1)])
def test_stratified_equals_a_sort(spark, budget, floor):
    rows = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"), (F.col("id") % 7 % 4).alias("level"))
    got = {r.id for r in texts.stratified(rows, spark.createDataFrame([("a", budget), ("b", 3)], "s string, budget long"), "s", "level", ["id"], floor).collect()}
    want, have = set(), {r.id: r for r in rows.withColumn("h", u("sample", "id")).collect()}
    for s, n in (("a", budget), ("b", 3)):
        own, firsts = sorted((r.h, r.id) for r in have.values() if r.s == s), set()
        for level in range(4):
            firsts |= {i for _, i in [x for x in own if have[x[1]].level == level][:floor]}
        want |= set([i for _, i in own if i in firsts][:n] + [i for _, i in own if i not in firsts][: max(0, n - len(firsts))])
    assert got == want
    assert texts.random_rows(rows, 11, ["id"], "x").count() == 11


def test_derangements_of_all_cycle_types(spark):
    names = [(f"e{r}_{i}", r) for r in range(60) for i in range(4)]
    got = {x.source: x.named for x in identity.derangement(spark.createDataFrame(names, "entity string, region int")).collect()}
    assert set(got) == set(got.values()) == {n for n, _ in names}
    assert all(a != b and a.split("_")[0] == b.split("_")[0] for a, b in got.items())
    # of the nine derangements of four, three are pairs of swaps; about a third of 60 regions have one
    swaps = sum(all(got[got[f"e{r}_{i}"]] == f"e{r}_{i}" for i in range(4)) for r in range(60))
    assert 8 < swaps < 34
    with pytest.raises(Exception, match="region with one entity"):
        identity.derangement(spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "entity string, region int")).collect()


def test_count_bootstrap_draws_as_many_as_there_are(spark):
    r = np.random.default_rng(2)
    rows = [("a", float(x)) for x in r.integers(0, 9, 500)] + [(None, float(x)) for x in r.normal(size=300)] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = resample.count_boot(df, 430, ["g"], F.col("x"), per_block=20).collect()
    assert len(got) == 2 * 431
    for g, n in (("a", 500), (None, 300)):
        values = np.array([x for h, x in rows if h == g and x is not None])
        own = {x.draw: x for x in got if x.g == g}
        assert {x.n for x in own.values()} == {n} and np.isclose(own[0].x, values.mean())
        draws = np.array([own[d].x for d in range(1, 431)])
        se = values.std() / np.sqrt(n)
        assert abs(draws.mean() - values.mean()) < 5 * se / np.sqrt(430) and 0.85 < draws.std() / se < 1.15
    again = {(x.draw, x.g): x.x for x in resample.count_boot(df.repartition(7), 430, ["g"], F.col("x"), per_block=20).collect()}
    assert all(np.isclose(again[x.draw, x.g], x.x) for x in got)
    assert resample.count_boot(df.limit(0), 5, ["g"], F.col("x")).count() == 0


def test_records_of_ratings(spark):
    rows = spark.createDataFrame([(1, "t", 3), (2, None, 4)], "id long, text string, r int")
    got = evidence.training_records(rows, F.lit("s"), F.col("text"), F.col("r"), "text", ["id"]).collect()
    assert [(r.id, [(m.role, m.content) for m in r.messages]) for r in got] == [(1, [("system", "s"), ("user", "t"), ("assistant", '{"rating": 3}')])]
