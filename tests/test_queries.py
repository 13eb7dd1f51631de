"""Queries against DuckDB on the small tables, and operators on hand-made rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quorumspark.functions import core
from quorumspark.operators import evidence, identity, metrics, panel, resample, texts, workforce
from quorumspark.plans import ORACLES, QUERIES
from quorumspark.sources import views

SF = "/root/testdata/sf0.001"
CHOSEN = ["a7_last_written", "a9_pending_jobs", "b3_human_mae", "b7_rails", "c2_mad_table", "c9_kappa", "c10_alpha", "c23_difficulty_curve", "d3_mae_ci", "d14_did", "f7_flips", "g3_tracking", "g13_reid_rates", "i8_fill_in", "j22_stratified_sample", "j26_group_split", "j5_evidence", "j11_assembled", "j12_prompts", "d17_treatment_contrast", "g11_summary_arms", "f5_dose_degradation", "a2_runs_with_distributions", "i4_leading_edge", "b16_quintiles"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def near(a, b):
    if isinstance(b, Decimal):
        b = float(b)
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    rel = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    want = sorted(rel.fetchall(), key=str)
    assert len(got) == len(want)
    key = lambda r: tuple(round(float(x), 3) if isinstance(x, (float, Decimal)) else str(x) for x in r)
    for x, y in zip(sorted(got, key=lambda r: str(key(r))), sorted(want, key=lambda r: str(key(r))), strict=True):
        assert all(near(p, q) for p, q in zip(x, y, strict=True)), (x, y)


def test_every_query_has_a_name_of_its_own():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_half_rounding(spark):
    r = spark.range(1).select(core.half_even(F.lit(2.5)).alias("e"), core.half_up(F.lit(2.5)).alias("u")).first()
    assert (r.e, r.u) == (2.0, 3)


def test_own_difficulty_has_slope_one(spark):
    v = views.Views(spark, SF)
    h = panel.human_mae(v.ratings)
    loo = panel.human_loo(v.ratings).join(h.select(*panel.CELL, "h"), panel.CELL)
    assert abs(metrics.tracking_slope(loo, [], "e", "h").first().slope - 1) < 1e-6


def test_weights_sum_to_the_number_of_clusters(spark):
    names = spark.createDataFrame([(f"e{i}",) for i in range(7)], "entity string")
    w = resample.weights(names, 20).groupBy("draw").agg(F.sum("w").alias("s")).collect()
    assert len(w) == 21 and all(r.s == 7 for r in w)


def test_derangement(spark):
    rows = spark.createDataFrame([(f"e{i}", i % 2) for i in range(9)], "entity string, region int")
    pairs = identity.derangement(rows).collect()
    assert {p.source for p in pairs} == {p.named for p in pairs} and all(p.source != p.named for p in pairs)


def found(df):
    return {r.section: r.text for r in df.collect()}


NUMBERED = """It was a turbulent year.

Section 1. Integrity of the Person
a. Arbitrary Killings
There were killings by security forces.
b. Disappearance
None known.
Section 2. Civil Liberties
a. Freedom of Expression
The press freedom was limited.
  c. Freedom of Religion
See the other report.
Section 5. Scrutiny
a. small letters begin no part
"""


def test_sections(spark):
    one = lambda t: found(texts.sections(spark.createDataFrame([(1, t)], "doc_id int, text string"), ["doc_id"]))
    got = one(NUMBERED)
    assert set(got) == {"exec_summary", "1", "1a", "1b", "2", "2a", "2c", "5"} and got["exec_summary"] == "It was a turbulent year."
    assert got["1"].startswith("Section 1. Integrity") and "killings by security forces" in got["1a"] and "killings" not in got["1b"] and got["2c"].startswith("c. Freedom")
    assert set(one("Summary\nSection  1 . Person\na. Killings\nx\nSection  2 . Liberties\ny")) == {"exec_summary", "1", "1a", "2"}
    assert set(one("Section 1. Person\na. Killings occurred.\n")) == {"1", "1a"} and one("") == {}
    again = one("Section 1. Old\na. First\nSection 1. New\nno part")
    assert again["1"] == "Section 1. New\nno part" and again["1a"] == "a. First"


def test_second_source(spark):
    one = lambda t: found(texts.lettered_blocks(spark.createDataFrame([(1, t)], "doc_id int, text string"), ["doc_id"]))
    got = one("over\n## A Process\nalpha\n\nScore Change: up because\nof it\n\nmore\n## PR Political Rights\n## header2 B Rights\nbeta\n\n## Country Facts\nside")
    assert got["A"] == "## A Process\nalpha\n\n\n\nmore" and got["B"] == "## B Rights\nbeta" and got["exec_summary"] == "over"
    assert not any(x in " ".join(got.values()) for x in ("side", "Score Change", "PR Political"))
    assert set(one("## A Process\nA1. Held.\n")) == {"A"} and one("") == {} and one("text\n\nBe the first to know\nmail") == {"exec_summary": "text"}


SIX = "Section 6. Abuses\nWomen\nworkplace discrimination\nNational/Racial/Ethnic Minorities\nhousing discrimination\nTrafficking in Persons\ncases of trafficking\nWomen and more\nOther Societal Violence or Discrimination\nattacks"


def test_named_parts(spark):
    rows = spark.createDataFrame([(k, y) for k in ("women", "minorities", "trafficking", "other_societal") for y in (2018, 2020, 2021)], "key string, year int")
    got = {(r.key, r.year): r.x for r in rows.select("key", "year", texts.named_part(F.lit(SIX), texts.part_header(F.col("key"), F.col("year"))).alias("x")).collect()}
    assert got["women", 2021] == "workplace discrimination" and got["minorities", 2018] == "housing discrimination" and got["other_societal", 2018] == "attacks"
    assert got["trafficking", 2018] == "cases of trafficking\nWomen and more" and got["minorities", 2020] is None and got["minorities", 2021] is None
    assert spark.range(1).select(texts.named_part(F.lit("Nothing here."), F.lit("Women")).alias("x")).first().x is None


def test_budget(spark):
    cut = lambda t, n: spark.range(1).select(texts.within_budget(F.lit(t), n).alias("x")).first().x
    assert cut(SIX, 10_000) == SIX and cut(SIX, 60) == SIX[: SIX.index("National")].strip()
    assert cut("first par\n\nsecond par\n\nthird", 25) == "first par\n\nsecond par" and cut("x" * 50, 20) == "x" * 20


def test_evidence_follows_the_plan(spark):
    keys = ["iso", "year"]
    shelf = spark.createDataFrame(
        [("first", "NGA", 2019, NUMBERED.replace("Section 5", SIX + "\nSection 5")), ("second", "NGA", 2019, "overview\n## A Elections\nflawed election\n## D Belief\nbelief"), ("third", "NGA", 2019, "religious practices"), ("first", "GHA", 2019, "A summary\nSection 3. Else\nx")],
        "source string, iso string, year int, text string",
    )
    plan = spark.createDataFrame([("body", "first", 0, "2a", None), ("body", "first", 1, "1a", None), ("belief", "first", 0, "2c", None), ("belief", "second", 0, "D", None), ("gone", "first", 0, "99", None), ("women", "first", 0, "6", "women"), ("children", "first", 0, "6", "minorities_2")], "indicator string, source string, pos int, section string, part string")
    indicators = spark.createDataFrame([(i, s) for i in ("body", "belief", "gone", "women", "children", "none") for s in ("first", "second")], "indicator string, source string")
    got = {(r.iso, r.indicator, r.source): r.evidence for r in evidence.evidence(shelf, indicators, plan, keys).collect()}
    body = got["NGA", "body", "first"]
    assert body.index("press freedom") < body.index("killings") and texts.RULE in body and "turbulent" not in body
    assert got["NGA", "belief", "first"] == "religious practices" and ("GHA", "belief", "first") not in got
    assert got["NGA", "gone", "first"] == got["NGA", "none", "first"] == "It was a turbulent year." and got["GHA", "body", "first"] == "A summary"
    assert got["NGA", "women", "first"] == "workplace discrimination" and got["NGA", "children", "first"].startswith("Section 6. Abuses")
    assert got["NGA", "none", "second"] == "overview" and ("GHA", "none", "second") not in got
    plain = {(r.iso, r.indicator, r.source): r.evidence for r in evidence.plain_evidence(shelf, plan, keys).collect()}
    assert plain["NGA", "body", "first"].startswith("It was a turbulent year." + texts.RULE) and plain["NGA", "belief", "second"].startswith("overview")
    miss = {(r.iso, r.indicator): r.missing for r in evidence.missing_sections(shelf, plan, keys).collect()}
    assert miss["NGA", "gone"] == "99" and miss["GHA", "body"] == "2a,1a" and miss["GHA", "belief"] == "third"


def test_assembled_summaries_stand_in_only_without_body(spark):
    plan = spark.createDataFrame([("kill", "first", 0, "1a", None), ("kill", "first", 1, "1b", None), ("kill", "second", 0, "F", None), ("relig", "first", 0, "2c", None), ("relig", "second", 0, "D", None)], "indicator string, source string, pos int, section string, part string")
    indicators = spark.createDataFrame([(i, s) for i in ("kill", "relig") for s in ("first", "second")], "indicator string, source string")

    def kept(*rows):
        cached = spark.createDataFrame([(s, 1, c, t) for s, c, t in rows], "source string, k int, section string, text string")
        return {r.indicator: r.text for r in evidence.assembled(cached, indicators, plan, ["k"]).collect()}

    both = [("first", "exec_summary", "EXEC 1"), ("second", "exec_summary", "EXEC 2")]
    got = kept(*both, ("first", "1a", "BODY a"), ("second", "F", "BODY F"), ("second", "D", "BODY D"))
    assert got["kill"] == f"*{evidence.LABELS['first']}*\n\nBODY a{texts.RULE}*{evidence.LABELS['second']}*\n\nBODY F" and "EXEC 1" not in got["relig"]
    assert "EXEC 1" in kept(*both)["kill"] and "EXEC 2" in kept(*both)["kill"]
    got = kept(("first", "third", "THIRD"), both[0], ("second", "D", "BODY D"))
    assert "THIRD" in got["relig"] and "EXEC 1" not in got["relig"] and kept(("second", "Z", "x")) == {}


def test_ratings_of_answers(spark):
    good = '{"rating": 3, "justification": "as said"}'
    cases = {f"```json\n{good}\n```": 3, good: 3, '{"rating": 3}': 3, '{"rating": 9, "justification": "x"}': None, "rating: 42": 4, '"rating": 7': None, "none": None, 'I say "Rating" = 2': 2, '{"rating": "1", "justification": "y"}': 1}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", texts.rating_of(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases


def test_token_distribution(spark):
    schema = "t array<struct<token: string, logprob: double, alternatives: array<struct<token: string, logprob: double>>>>"
    rating = [('"rat', -1.0, []), ('ing"', -1.0, []), (": ", -1.0, [])]
    rows = [
        [*rating, ("2", -0.1, [("2", 0.0), (" 3", -1.0), ("x", -1.0), ("3", -9.0), ("7", 0.0)])],
        [("4", -0.1, [("4", 0.0)]), *rating, ("1", -0.5, [("0", -1.0)]), ("3", 0.0, [("3", 0.0)])],
        [("2", -0.1, [("2", 0.0)])],
    ]
    got = [r.d for r in spark.createDataFrame([(r,) for r in rows], schema).select(texts.token_distribution(F.col("t")).alias("d")).collect()]
    assert got == [[0, 0, 1, 0.367879, 0], [0.367879, 0.606531, 0, 0, 0], None]


def test_prompts_hide_the_focal_entity(spark):
    df = spark.sql("SELECT array(named_struct('entity', 'A', 'year', 2017, 'raw_mean', 1.0D, 'text', 'x'), named_struct('entity', 'B', 'year', 2018, 'raw_mean', 2.5D, 'text', 'y')) AS e")
    one = lambda focal, named: df.select(texts.prompt("Q {CATS}\n{SHOTS}", CATS=texts.numbered(F.array(F.lit("no"), F.lit("yes"))), SHOTS=texts.few_shot_block(F.col("e"), F.lit(focal), F.lit(named))).alias("p")).first().p
    assert one("A", True) == "Q - **0**: no\n- **1**: yes\n**Example 1 — B, 2018** (Panel mean: 2.50)\n\ny"
    assert "A, 2017" in one("C", True) and "2017" not in one("C", False) and "{" not in one("C", False)
    with pytest.raises(Exception, match="without examples"):
        df.select(texts.few_shot_block(F.filter("e", lambda e: e.entity == "A"), F.lit("A"), F.lit(True)).alias("p")).collect()


def test_few_shot_is_greedy(spark):
    means = [("e1", 2000, "i", 0.1), ("e1", 2001, "i", 1.0), ("e2", 2000, "i", 1.1), ("e3", 2000, "i", 0.9), ("e4", 2000, "i", 2.2)]
    rows = spark.createDataFrame(means, "entity string, year int, indicator string, raw_mean double")
    regions = spark.createDataFrame([("e1", 1), ("e2", 1), ("e3", 2), ("e4", 2)], "entity string, region int")
    got = {r.level: r.entity for r in texts.few_shot(rows, regions).collect()}
    assert got == {0: "e1", 1: "e3", 2: "e4"}
    only = spark.createDataFrame([("e1", 2001), ("e2", 2000), ("e1", 2000)], "entity string, year int")
    assert {r.level: r.entity for r in texts.few_shot(rows, regions, only).collect()} == {0: "e1", 1: "e2"}


def test_examples_are_picked_from_sql_too(spark):
    from quorumspark.functions import tables

    tables.register(spark)
    rows = [("i", level, dist, e, 2000, r) for level, dist, e, r in [(0, 0.1, "e1", 1), (0, 0.2, "e2", 2), (1, 0.0, "e1", 1), (1, 0.1, "e3", 1), (1, 0.3, "e2", 2), (2, 0.0, "e2", 2), (2, 0.1, "e1", 1)]] + [("j", 3, 0.5, "e9", 1999, 1)]
    spark.createDataFrame(rows, "indicator string, level int, dist double, entity string, year int, region int").repartition(5).createOrReplaceTempView("candidates_")
    got = spark.sql("SELECT * FROM pick_examples(TABLE(candidates_))").collect()
    # a new region first; where there is none a new entity; else the closest
    assert sorted((r.indicator, r.level, r.entity) for r in got) == [("i", 0, "e1"), ("i", 1, "e2"), ("i", 2, "e2"), ("j", 3, "e9")]


def test_held_out_groups_never_train(spark):
    rows = spark.createDataFrame([(f"g{i % 40}", i) for i in range(400)], "g string, i int")
    got = texts.group_split(rows, ["g"], 0.25, 45)
    n = {r.split: (r.cells, r.n) for r in got.groupBy("split").agg(F.count_distinct("g").alias("cells"), F.count("*").alias("n")).collect()}
    assert n == {"train": (30, 300), "validation": (5, 50), "unused": (5, 50)}
    assert got.groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


def test_running_totals_and_windows(spark, tmp_path):
    from quorumspark.streaming import logs

    events = spark.read.parquet(f"{SF}/events.parquet")
    kinds = dict(events.dtypes)
    rows = events.select("event_type", F.col("value").cast("double").alias("value"), F.timestamp_seconds(F.col("event_id") * 60).alias("ts"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    run(logs.running_totals(stream, ["event_type"], "value"), "totals")
    want = {r.event_type: (r.n, round(r.total, 6)) for r in logs.running_totals(rows, ["event_type"], "value").collect()}
    assert {r.event_type: (r.n, round(r.total, 6)) for r in spark.table("totals").collect()} == want and kinds
    run(logs.windowed(stream, "1 hour", "10 days", ["event_type"]), "hours")
    assert spark.table("hours").agg(F.sum("n")).first()[0] == rows.count()


def test_slope_grid(spark):
    from quorumspark.operators import regress

    fit = spark.createDataFrame([("x", 2.0, 0.1), ("xm", -1.0, 0.2)], "term string, est double, se double")
    got = {r["at"]: (round(r.slope, 6), round(r.lo, 6), round(r.hi, 6)) for r in regress.slope_grid(fit, "x", "xm", -0.5, 0.5, 0.5).collect()}
    assert got == {-0.5: (2.5, 2.5, 2.5), 0.0: (2.0, 1.804, 2.196), 0.5: (1.5, 1.108, 1.892)}


def test_runs_reader_skips_broken_lines(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"country": "A", "year": 2000, "indicator": "i", "condition": "c-zeroshot", "model_key": "m-local", "rating": 2}\n\n{broken\n{"country": "A"}\n')
    rows = views.read_runs(spark, str(tmp_path / "runs.jsonl")).collect()
    assert [(r.model_key, r.condition, r.rating) for r in rows] == [("m", "c", 2)]


def test_bands_are_right_closed(spark):
    rows = spark.createDataFrame([(3,), (4,), (5,), (8,)], "n int").select(workforce.band(F.col("n")).alias("b")).collect()
    assert [r.b for r in rows] == ["1-3", "4", "5-7", "8+"]


def test_rails_and_directions_of_constant_values(spark):
    rows = [(e, y, "i", 1.0 + (y == 2001) * k / 4, 3) for k, e in enumerate(("A", "B", "C")) for y in (2000, 2001)]
    means = spark.createDataFrame(rows, "entity string, year int, indicator string, raw_mean double, n_coders long")
    ord_ = spark.createDataFrame([(e, y, "i", 2) for e in "AB" for y in (2000, 2001)], "entity string, year int, indicator string, ord int")
    got = {r.rail: r for r in panel.rails(means, ord_, means.withColumn("abs_dev", F.lit(0.5))).collect()}
    # last year's means are all 1 and so is the ordinal 2: no correlation, but an error and a count of each
    assert math.isnan(got["persist"].r) and (got["persist"].n, got["persist"].mae) == (3, 0.25)
    assert math.isnan(got["ord"].r) and got["ord"].n == 4 and got["rounding"].r == 0.87831
    pairs = spark.createDataFrame([("none", 1.0, None), ("one", 1.0, 2.0), ("flat", 0.1, 1.0), ("flat", 0.1, 2.0), ("flat", 9.0, None), ("line", 1.0, 2.0), ("line", 2.0, 4.0)], "k string, x double, y double")
    r = {k: v for k, v in pairs.groupBy("k").agg(core.corr(F.col("x"), F.col("y")).alias("r")).collect()}
    assert r["none"] is None and math.isnan(r["one"]) and math.isnan(r["flat"]) and abs(r["line"] - 1) < 1e-12


def test_readout_filter_is_judged_on_cells(spark, duck):
    df = QUERIES["c15_readout_gain"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and not any("md5" in line for line in plan.splitlines() if "Join" in line)
    want = duck.execute(ORACLES["c15_readout_gain"]).fetchall()
    assert len(want) > 0 and all(near(x, y) for a, b in zip(sorted(df.collect()), sorted(want), strict=True) for x, y in zip(a, b, strict=True))
