import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

from quorumspark.sources import files, views

GOOD = [{"country": f"C{i % 7}", "year": 1990 + i % 11, "indicator": "i" * (1 + i % 40), "condition": "c-zeroshot", "model_key": "m-local" if i % 3 else "n", "rating": i % 5} for i in range(300)]
BAD = [b"{broken", b'{"country": "A"}', b"[1]", b"7", b'{"country": "A", "year": "x", "indicator": "i"}', b'{"country": null, "year": 2000, "indicator": "i"}', b'{"country": "A", "year": 2000, "indicator": "i", "rating": 2.5}', b"\xff\xfe", b'{"country": "\xff", "year": 2000, "indicator": "i"}', b'{"country": "A", "year": 2000, "indicator": "i"}{"country": "A", "year": 2000, "indicator": "i"}', b'{"country": "A", "year": 5000000000, "indicator": "i"}']


def _log() -> bytes:
    """Good lines with a bad one after every twenty-fifth and blank ones between, some ended by a carriage return."""
    out = []
    for i, row in enumerate(GOOD):
        out.append(json.dumps(row).encode() + (b"\r" if i % 13 == 0 else b""))
        if i % 25 == 24:
            out += [BAD[(i // 25) % len(BAD)], b"", b"  "]
    return b"\n".join(out)


@pytest.mark.parametrize("size", [1, 2, 7, 50, 111, 4096, 1 << 20])
def test_ranges_hold_every_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(files, "_LEAST", 1)
    monkeypatch.setattr(files, "_CHUNK", 64)
    (tmp_path / "a.jsonl").write_bytes(_log())
    (tmp_path / "b.jsonl").write_bytes(b"\n\nlast line \n")
    (tmp_path / "_SUCCESS").write_bytes(b"no log")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    reader = files.RunsReader(T.StructType(), {"path": str(tmp_path), "split_bytes": str(size)})
    parts = reader.partitions()
    got = [x for p in parts for piece in p.pieces for x in reader.lines(piece)]
    assert got == [*_log().split(b"\n"), b"", b"", b"last line "]
    assert all(sum(piece.end - piece.start for piece in p.pieces) <= size for p in parts)


def test_rows_and_skipped_lines_in_one_pass(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(_log())
    with gzip.open(tmp_path / "b.jsonl.gz", "wb") as f:
        f.write(_log())
    rows = views.read_runs(spark, [f"file://{tmp_path}/a.jsonl", str(tmp_path / "b.jsonl.gz")], skipped=True)
    assert rows.agg(F.sum("skipped")).first()[0] == 24
    got = sorted(tuple(r)[:6] for r in rows.where("skipped IS NULL").collect())
    assert got == sorted(2 * [(g["country"], g["year"], g["indicator"], "c", g["model_key"].removesuffix("-local"), g["rating"]) for g in GOOD])


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(_log())
    rows = views.read_runs(spark, str(tmp_path)).where("model_key = 'm' AND year IN (1991, 1992) AND rating > 1 AND length(indicator) > 3 AND NOT country = 'C1'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "model_key" not in plan.split("Filter", 1)[1].split("\n")[0] and "length" in plan
    want = [g for g in GOOD if g["model_key"] == "m-local" and g["year"] in (1991, 1992) and g["rating"] > 1 and len(g["indicator"]) > 3 and g["country"] != "C1"]
    assert sorted((r.country, r.year, r.rating) for r in rows.collect()) == sorted((g["country"], g["year"], g["rating"]) for g in want) and want
    reader = files.RunsReader(T.StructType().add("year", "integer").add("skipped", "long"), {"path": ""})
    left = IsNull(("year",)), EqualTo(("skipped",), 1), EqualTo(("year", "deep"), 1)
    assert tuple(reader.pushFilters([In(("year",), (1, 2)), *left])) == left
    assert reader.passing(pa.table({"year": [2, 3, None]})).to_pylist() == [{"year": 2}]


def test_nested_columns_and_odd_values(spark, tmp_path):
    key = '"country": "A", "year": 2000, "indicator": "i"'
    lines = [f'{{{key}, "rating_dist": [1, null, 0.5], "section_keys": {{"s": ["a", "b"]}}, "tokens": {{"input": 3, "other": 1}}, "raw_response": {{"a": [1]}}}}', f'{{{key}, "raw_response": "half \\ud83d pair \\ud83d\\ude00"}}', f'{{{key}, "rating_dist": [1, "x"]}}', f'{{{key}, "raw_response": "{"long " * 500000}"}}', f'{{{key}, "rating_dist": [], "tokens": null}}', f"{{{key}, \"tokens\": {'[' * 100000}}}"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = views.read_runs(spark, str(tmp_path), ("rating_dist", "section_keys", "tokens", "raw_response"), skipped=True)
    got = rows.where("skipped IS NULL").collect()
    assert [r.rating_dist for r in got] == [[1.0, None, 0.5], None, None, []] and rows.agg(F.sum("skipped")).first()[0] == 2
    assert got[0].section_keys == {"s": ["a", "b"]} and (got[0].tokens.input, got[0].tokens.output) == (3, None) and got[0].raw_response == '{"a":[1]}'
    assert got[1].raw_response == "half ? pair \U0001f600" and len(got[2].raw_response) == 2500000 and got[3].tokens is None


def test_empty_folder(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    assert views.read_runs(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        views.read_runs(spark, str(tmp_path / "nowhere")).collect()


def test_reports_outside_the_filter_stay_closed(spark, tmp_path):
    for source, year, slug, text in [("first", 1999, "a b", "x\n"), ("first", 2000, "a%20b", "y\n\n"), ("second", 2000, "c", "")]:
        (tmp_path / source / str(year)).mkdir(parents=True, exist_ok=True)
        (tmp_path / source / str(year) / f"{slug}.txt").write_text(text)
    (tmp_path / "notes.txt").write_text("no report")
    rows = views.read_reports(spark, str(tmp_path))
    assert sorted(tuple(r) for r in rows.collect()) == [("first", 1999, "a b", "x"), ("first", 2000, "a%20b", "y\n"), ("second", 2000, "c", "")]
    assert [r.slug for r in rows.where("year = 2000 AND source = 'second'").collect()] == ["c"]
    reader = files.ReportsReader(T.StructType(), {"path": str(tmp_path)})
    assert not list(reader.pushFilters([GreaterThan(("year",), 1999), EqualTo(("source",), "first")]))
    assert [p.path.split("/")[-1] for x in reader.partitions() for p in x.pieces] == ["a%20b.txt"]
    spark.createDataFrame([("first", 2001, "a/b %", "t"), ("first", 2002, "d", "u\nv")], "source string, year int, slug string, text string").transform(lambda d: views.write_reports(d, f"{tmp_path}/w") or d)
    again = sorted(tuple(r) for r in views.read_reports(spark, f"file:{tmp_path}/w").collect())
    assert again == [("first", 2001, "a/b %", "t"), ("first", 2002, "d", "u\nv")]


def test_logs_are_read_from_sql(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"year": 2000}\n{broken\n{"year": 2001}\n')
    files.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW logged (year int, skipped long) USING panel_runs OPTIONS (path '{tmp_path}')")
    assert spark.sql("SELECT count(year), sum(skipped) FROM logged").first()[:] == (2, 1)
    assert [r.year for r in spark.sql("SELECT year FROM logged WHERE year > 2000").collect()] == [2001]
