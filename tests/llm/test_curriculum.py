"""Mixing by a curriculum against a plain computation, and its edge cases."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quorumspark.llm import curriculum as C
from quorumspark.llm._order import running

SCHEMA = "doc_id long, text string, source string, size string, row int, target double, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 0.0, 2) for i, t, s in rows], SCHEMA)


def water_level(sizes, weights, share, most):
    """Targets by dealing the excess again until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    limit, target, left = {s: most * sizes[s] for s in names}, dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while left > 1e-9 and open_:
        total, spare = sum(w[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            target[s] += left * w[s] / total
            if target[s] > limit[s]:
                spare += target[s] - limit[s]
                target[s] = limit[s]
        open_ = {s for s in open_ if target[s] < limit[s]}
        left = spare
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, "é": 500, None: 7}, {"z": 3}, {"a": 0, "b": 5}, {f"s{i}": (i * 7919) % 101 for i in range(40)}])
def test_targets_equal_the_plain_loop(spark, sizes):
    got = {r.source: r.target for r in C.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water_level(sizes, C.WEIGHTS, 1.5, 2.0)
    assert got == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}


def test_running_sums_over_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("x"))
    got = sorted(map(tuple, running(rows, ["k"], {"before": "x"}, 7).collect()))
    total = 0
    for k, x, before in got:
        assert before == total
        total += x
    assert running(rows.limit(0), ["k"], {"before": "x"}).count() == 0


def test_position_inverts_the_integral(spark):
    for knots in [*C.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.25, 1.0), (1.0, 0.0))]:
        area = lambda t: sum((max(0, min(t, b[0]) - a[0]) * (a[1] + (a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0]))) / 2) for a, b in zip(knots, knots[1:], strict=False) if b[0] > a[0] and t > a[0])  # noqa: E731, B023
        for r in spark.range(21).select((F.col("id") / 20).alias("x")).withColumn("t", C.position(F.col("x"), knots)).collect():
            assert area(r.t) / area(1.0) == pytest.approx(r.x, abs=1e-9) and 0 <= r.t <= 1
    with pytest.raises(ValueError):
        C.position(F.lit(0.0), ((0.0, 0.0), (1.0, 0.0)))


ROWS = [(i, " ".join(["w"] * (i % 40)), f"s{i % 3 if i % 2 else 0}") for i in range(200)] + [(500, None, "s1"), (501, "", None), (502, "a b  c", None), (502, "a b  c", None), (None, "x y", "s2"), (503, "one\x0btwo three \n four" * 3000, "long")]


@pytest.fixture(scope="module")
def mixed(spark):
    return C.order(C.assign(docs(spark, ROWS))).collect()


def test_mix_meets_its_targets_and_limits(spark, mixed):
    sizes, taken, target, per_row = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for i, t, s in ROWS:
        sizes[s] += len(re.findall(C.WORD, t or ""))
    for r in mixed:
        taken[r.source] += r.words or 0
        per_row[r.row] += r.words or 0
        target[r.source] = r.target
    want = water_level(sizes, C.WEIGHTS, 1.5, 2.0)
    assert target == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}
    assert all(target[s] - 1 < taken[s] <= target[s] + 1e-6 for s in target)
    assert len(per_row) == len(ROWS) and all(per_row[r.row] <= 2 * r.size for r in mixed)
    got = C.digest(C.order(C.assign(docs(spark, ROWS)))).collect()
    assert len(got) == len(ROWS) and sum(r.taken for r in got) == sum(per_row.values())
    assert {(r.doc_id, r.taken) for r in got if not r.size} == {(i, 0) for i, t, _ in ROWS if not re.search(C.WORD, t or "")}


def test_places_are_gapless_and_in_order(mixed):
    some = sorted((r for r in mixed if r.words), key=lambda r: r["at"])
    total = 0
    for a, b in zip(some, some[1:], strict=False):
        assert a["at"] == total and a.position <= b.position
        total += a.words
    # the first source falls, the third rises
    mean = lambda s: sum(r.position * r.words for r in some if r.source == s) / sum(r.words for r in some if r.source == s)
    assert mean("s1") > 0.55 and mean("long") < 0.5


def test_reruns_and_partitions_agree(spark, mixed):
    again = C.order(C.assign(docs(spark, ROWS).repartition(9))).collect()
    key = lambda rows: sorted((str(r.doc), r.begin, str(r["pass"]), r.words or 0, r["at"] if r.words else 0) for r in rows)
    assert key(again) == key(mixed)


def test_stream_gives_whole_texts_but_for_the_last_of_a_source(spark):
    rows = [r for r in ROWS if r[0] not in (None, 502)]
    texts = {i: t for i, t, _ in rows}
    got = C.stream(docs(spark, rows)).collect()
    assert [r["at"] for r in got] == sorted(r["at"] for r in got)
    cut = [r for r in got if r.text != texts[r.doc]]
    assert len(cut) <= 5 and all(texts[r.doc].startswith(r.text) for r in cut)
    assert all(len(re.findall(C.WORD, r.text)) == r.words for r in got)


def test_empty_table(spark):
    assert C.digest(C.order(C.assign(docs(spark, ROWS).limit(0)))).count() == 0
    assert C.stream(docs(spark, ROWS).limit(0)).count() == 0
