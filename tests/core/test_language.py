import pytest
from helpers import events

from tidemark.plans.compiler import query, run, to_result
from tidemark.plans.language import Condition, QueryError, parse, tokenize

ROWS = [("server-42", 1000, "cpu", 42.0), ("server-42", 1010, "cpu", 85.5), ("server-42", 1015, "deployment", "v2.8.1"), ("server-42", 1020, "cpu", 94.2), ("server-99", 1000, "cpu", 20.0)]


@pytest.fixture(scope="module")
def five(spark):
    return events(spark, ROWS, {1: {"region": "us", "n": 5}, 2: {"region": "eu", "n": "5"}, 4: {"n": True}}).cache()


def values(text, df):
    return [r.value for r in query(text, df).collect()]


def test_every_clause_of_find():
    p = parse("FIND cpu FROM server-42 BETWEEN 1000 AND 1020 WHERE value >= 80 ORDER BY timestamp DESC LIMIT 5")
    assert (p.command, p.targets, p.entity, p.start, p.end, p.conditions, p.descending, p.limit) == ("FIND", ("cpu",), "server-42", 1000, 1020, [Condition("value", ">=", 80)], True, 5)


def test_slots_and_synonyms():
    p = parse("select * from a where entity = 'b' and type == cpu and x != -1.5")
    assert (p.entity, p.targets, p.conditions) == ("b", ("cpu",), [Condition("x", "!=", -1.5)])
    p = parse("find cpu where type = memory")
    assert p.targets == ("cpu",) and p.conditions == [Condition("type", "=", "memory")]
    assert parse("FIND a, B, c").targets == ("a", "b", "c")
    assert parse("FIND").targets == () and parse("FIND events LIMIT 2.7").limit == 2


@pytest.mark.parametrize("text", ["FIND 'open", "FIND cpu host:80", "FIND cpu LAST 5", "FIND cpu WHERE value 1.2.3", "FIND cpu LIMIT -1", "DROP x", "", "FIND a WHERE x", "FIND cpu WHERE value > 1.2.3", "ANALYZE cpu GROUP BY week", "FIND cpu BETWEEN soon AND 3", "FIND cpu extra"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_error_position():
    with pytest.raises(QueryError) as e:
        tokenize("FIND cpu\n  ;")
    assert (e.value.line, e.value.column) == (2, 3)


def test_find(five):
    assert values("FIND cpu FROM server-42 WHERE value > 80 ORDER BY timestamp ASC", five) == ["85.5", "94.2"]
    assert values("FIND CPU FROM server-42 LIMIT 0", five) == []
    assert len(values("FIND cpu, deployment", five)) == 5
    assert values("FIND events ORDER BY value DESC LIMIT 2", five) == ["v2.8.1", "94.2"]
    with pytest.raises(ValueError):
        query("FIND cpu ORDER BY nothing", five)


def test_attributes_and_kinds(five):
    assert values("FIND * WHERE region = us", five) == ["42.0"]
    assert values("FIND * WHERE region != us", five) == ["85.5"]  # a missing field fails even !=
    assert values("FIND * WHERE n = 5", five) == ["42.0"]  # never the text "5"
    assert values("FIND * WHERE n != 5", five) == ["85.5", "94.2"]
    assert values("FIND * WHERE n = 1", five) == ["94.2"]  # true counts as 1
    assert values("FIND * WHERE n > 'a'", five) == []
    assert values("FIND * WHERE value = 'v2.8.1'", five) == ["v2.8.1"]
    assert values("FIND deployment WHERE value != 3", five) == ["v2.8.1"]
    assert values("FIND deployment WHERE value > 3", five) == []


def test_analyze_diff_state(five):
    r = query("ANALYZE cpu FROM server-42", five).first()
    assert (r["count"], r["min"], r["max"]) == (3, 42.0, 94.2)
    assert query("ANALYZE cpu GROUP BY minute", five).count() == 1
    d = {r.metric: r for r in query("DIFF server-42 FROM 1000 TO 1020", five).collect()}
    assert d["cpu"].absolute_diff == pytest.approx(52.2) and d["deployment"].value_t1 is None and d["deployment"].value_t2 == 0.0
    s = {r.type: r.value_str for r in query("STATE server-42 AS OF 1015", five).collect()}
    assert s == {"cpu": "85.5", "deployment": "v2.8.1"}


def test_telemetry(five):
    rows, seen = run("FIND cpu FROM server-42 WHERE value > 80", five)
    assert (len(rows), seen.returned, seen.scanned) == (2, 2, 3)


def test_filters_reach_the_scan(spark, five, tmp_path):
    five.write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = query("FIND cpu FROM server-42 BETWEEN 1 AND 2000 WHERE value > 80", spark.read.parquet(str(tmp_path / "e")))._jdf.queryExecution().toString()
    for wanted in ("EqualTo(entity,server-42)", "EqualTo(type,cpu)", "GreaterThan(value_num,80.0)", "LessThanOrEqual(timestamp,2000)"):
        assert wanted in plan
    assert "attributes" not in plan.split("ReadSchema")[-1]


def test_result_as_plain_data(five):
    import json

    got = to_result("FIND * FROM server-42 ORDER BY timestamp ASC LIMIT 3", five)
    assert got["columns"] == ["timestamp", "entity", "type", "value", "event_id"]
    assert [r[3] for r in got["rows"]] == [42, 85.5, "v2.8.1"] or [r[3] for r in got["rows"]] == [42.0, 85.5, "v2.8.1"]
    assert set(got["metadata"]) == {"scanned_rows", "returned_rows", "segments_touched", "index_hits", "execution_time_ms"} and got["metadata"]["returned_rows"] == 3
    assert json.loads(json.dumps(got)) == got
    assert to_result("ANALYZE cpu", five)["columns"][0] == "type"


def test_skipped_segments(spark, five, tmp_path):
    path = str(tmp_path / "e")
    for entity in ("server-42", "server-99"):
        five.filter(f"entity = '{entity}'").coalesce(1).write.mode("append").parquet(path)
    _, seen = run("FIND cpu FROM server-99", spark.read.parquet(path))
    assert (seen.files, seen.skipped, seen.scanned) == (2, 1, 1)
