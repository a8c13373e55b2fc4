import json

import pytest
from helpers import events
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.timestamps import parse_literal, parse_text
from tidemark.sources import jsonl, pages
from tidemark.sources.table import EventTable
from tidemark.streaming import ingest as streaming

CASES = {
    "1700000000": 1700000000, "2026-08-30T14:02:00Z": 1788098520, "invalid-date-string": None, "17000000": 17000000, "2024": 2024, "1e3": 1000, "12.7": 12,
    "20240101": 1704067200, "2024-01-01": 1704067200, "2024-01-01T01:00:00+01:00": 1704067200, "2024-W01-1": 1704067200, " 2024-01-01 00:00:05.9 ": 1704067205,
    "2024-01-01T00:00": 1704067200, "2024-13-01": None, "": None, "nan": None, "-5": -5, "2024-01-01T05:30:00+0530": 1704067200,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "s string")
    assert {r.s: r.t for r in df.select("s", parse_text(F.col("s")).alias("t")).collect()} == CASES
    for k, v in CASES.items():
        if v is None:
            with pytest.raises(ValueError):
                parse_literal(k)
        else:
            assert parse_literal(k) == v


def lines(spark, items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "line_no long, raw string").coalesce(1)


def test_batch_report_and_sequence(spark):
    good = '{"entity": " srv ", "timestamp": %d, "type": " CPU ", "value": 1}'
    checked = jsonl.ingest(jsonl.keep_payload(lines(spark, [good % 1, "# note", "", good % 2, "not json", '{"value": 3}', good % 3])))
    rep = jsonl.report(checked)
    assert (rep["total"], rep["accepted"], rep["rejected"]) == (5, 3, 2)
    got = jsonl.accepted(checked).orderBy("timestamp").collect()
    assert [(r.entity, r.type, r.sequence_num) for r in got] == [("srv", "cpu", 1), ("srv", "cpu", 2), ("srv", "cpu", 4)]
    assert len({r.event_id for r in got}) == 3 and all(len(r.event_id) == 24 for r in got)


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ('{"timestamp": 1, "type": "a"}', "missing or empty field: entity"),
        ('{"entity": 5, "timestamp": 1, "type": "a"}', "missing or empty field: entity"),
        ('{"entity": "e", "type": "a"}', "missing field: timestamp"),
        ('{"entity": "e", "timestamp": [1], "type": "a"}', "invalid timestamp"),
        ('{"entity": "e", "timestamp": -1, "type": "a"}', "negative timestamp"),
        ('{"entity": "e", "timestamp": 1}', "missing or empty field: type"),
        ('{"entity": "e", "timestamp": 1, "type": "a", "value": [1]}', "value is not a number, text or boolean"),
        ('{"entity": "e", "timestamp": 1, "type": "a", "attributes": 3}', "attributes is not an object"),
        ("[1]", "event is not a JSON object"),
        ('{"entity": "", "timestamp": "x"}', "missing or empty field: entity"),
    ],
)
def test_first_failing_check(spark, line, error):
    assert jsonl.validate(lines(spark, [line]), F.lit(1)).first().error == error


def test_values_keep_kind_and_print(spark):
    values = {"17": ("number", 17.0, "17"), "84.0": ("number", 84.0, "84.0"), "true": ("bool", 1.0, "True"), '"v2"': ("string", None, "v2"), "null": ("null", None, None), '"12"': ("string", None, "12")}
    items = ['{"entity": "e", "timestamp": "1.9", "type": "a", "value": %s, "attributes": {"b": 1, "a": 2}}' % v for v in values]
    got = jsonl.accepted(jsonl.validate(lines(spark, items), F.col("line_no"))).orderBy("sequence_num").collect()
    assert [(r.value_kind, r.value_num, r.value_str) for r in got] == list(values.values())
    assert {r.timestamp for r in got} == {1} and {r.attributes for r in got} == {'{"a":2,"b":1}'}
    back = [json.loads(r.value) for r in jsonl.to_json_lines(jsonl.accepted(jsonl.validate(lines(spark, items), F.col("line_no"))).orderBy("sequence_num")).collect()]
    assert [b["value"] for b in back] == [17, 84.0, True, "v2", None, "12"] and list(back[0]) == sorted(back[0])


def test_identity(spark):
    one = '{"entity": "e", "timestamp": 1, "type": "a", "value": 1}'
    ids = [r.event_id for r in jsonl.validate(lines(spark, [one, one]), F.lit(1)).collect()] + [jsonl.validate(lines(spark, [one]), F.lit(2)).first().event_id]
    assert ids[0] == ids[1] != ids[2]
    given = '{"event_id": "mine", "entity": "e", "timestamp": 1, "type": "a"}'
    assert jsonl.validate(lines(spark, [given]), F.lit(1)).first().event_id == "mine"


def test_table_life(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "t"))
    assert table.events().count() == 0 and table.compact() is None
    for lo in (0, 3, 6):
        table.append(events(spark, [("a", 1000 + 5 * i, "cpu", 50 + i) for i in range(lo, lo + 3)]).coalesce(1))
    assert table.events().count() == 9 and table.stats()["segments"] == 3
    assert {r.status for r in table.verify().collect()} == {"HEALTHY"}
    assert table.candidates("a", ["cpu"], 1000, 1011).count() == 1 and table.candidates("zz").count() == 0 and table.candidates(start=9999).count() == 0
    assert table.compact() == 1  # the three appends share ids e1..e3
    assert table.events().count() == 3 and table.events().filter("value_num >= 53").count() == 0
    assert {r.status for r in table.verify().collect()} == {"HEALTHY"}
    extra = events(spark, [("b", 1, "cpu", 1)])
    extra.write.mode("append").parquet(f"{table.path}/v1")
    assert "UNKNOWN" in {r.status for r in table.verify().collect()}


def test_crash_before_the_pointer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path / "t"))
    for lo in (0, 3):
        table.append(events(spark, [("a", 1000 + i, "cpu", i) for i in range(lo, lo + 3)]).coalesce(1))
    with monkeypatch.context() as m:
        m.setattr(EventTable, "_point_to", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            table.compact()
    assert table.version() == 0 and table.events().count() == 6 and {r.status for r in table.verify().collect()} == {"HEALTHY"}
    assert table.compact() == 2 and table.events().count() == 3
    # the first file's rows stay, in the order of writing
    assert sorted(r.value_num for r in table.events().collect()) == [0, 1, 2]
    assert {r.status for r in table.verify().collect()} == {"HEALTHY"} and table.vacuum() == [0, 1]
    assert EventTable(spark, table.path).version() == 2 and table.events().count() == 3 and table.compact() is None


def test_append_during_compaction_is_carried_over(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path / "t"))
    for i in (1, 2):
        table.append(events(spark, [("a", i, "cpu", i)]).withColumn("event_id", F.lit(f"x{i}")))
    write, once = EventTable._write, []

    def busy(self, rows, version, mode):
        if not once:
            once.append(1)
            write(self, events(spark, [("b", 9, "cpu", 9)]), 0, "append")
        write(self, rows, version, mode)

    monkeypatch.setattr(EventTable, "_write", busy)
    assert table.compact() == 1
    assert sorted(r.event_id for r in table.events().collect()) == ["e1", "x1", "x2"]


def test_audit_reads_new_files_only(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "t"))
    table.append(events(spark, [("a", 1, "cpu", 1)]))
    newest = table._known(0).agg(F.max("modified")).first()[0]
    assert table._files(0, newest).count() >= 1
    import datetime

    assert table._files(0, newest + datetime.timedelta(hours=1)).count() == 0


def test_damaged_segment_shows(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "t"))
    table.append(events(spark, [("a", i, "cpu", i) for i in range(20)]).coalesce(1))
    table.append(events(spark, [("b", i, "cpu", i) for i in range(20)]).coalesce(1))
    found = sorted((tmp_path / "t" / "v0").glob("*.parquet"))
    found[0].unlink()
    spark.catalog.clearCache()
    assert sorted(r.status for r in table.verify().collect()) == ["HEALTHY", "MISSING"]


def test_lines_are_counted_through_in_the_order_of_files(spark, tmp_path):
    for name, n in (("b.jsonl", 40), ("a.jsonl", 3), ("c.jsonl", 7)):
        (tmp_path / name).write_text("".join(f"{name[0]}{i}\n" for i in range(n)))
    got = jsonl.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.raw for r in got] == [f"{f}{i}" for f, n in (("a", 3), ("b", 40), ("c", 7)) for i in range(n)]
    assert [r.line_no for r in got] == list(range(50))


def test_numbers_run_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(jsonl, "STRETCH", 4)
    raw = ["{}" if i % 3 else "broken" for i in range(23)]
    got = jsonl.numbered(lines(spark, raw).repartition(3), 10).orderBy("line_no").collect()
    good = [i for i in range(23) if i % 3]
    assert [r.seq for r in got] == [10 + good.index(i) if i % 3 else None for i in range(23)]


def test_python_rows(spark):
    checked = jsonl.ingest_rows(spark, [{"entity": "é", "timestamp": 5, "type": "A", "value": 1.5}, '{"entity": "b", "timestamp": 6, "type": "t", "value": true}', {"entity": "c"}])
    assert [(r.entity, r.type, r.value_num, r.value_kind, r.sequence_num) for r in jsonl.accepted(checked).orderBy("sequence_num").collect()] == [("é", "a", 1.5, "number", 1), ("b", "t", 1.0, "bool", 2)]
    assert jsonl.report(checked)["errors"][0]["error"] == "missing field: timestamp"


def test_stream_to_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = '{"entity": "s", "timestamp": %d, "type": "cpu", "value": %d, "event_id": "%s"}\n'
    (src / "a.jsonl").write_text(row % (1, 1, "x") + row % (1, 1, "x") + "broken\n" + row % (5, 2, "y"))
    table = EventTable(spark, str(tmp_path / "t"))
    go = lambda: streaming.ingest_stream(streaming.read_stream(spark, str(src)), table, str(tmp_path / "c"), str(tmp_path / "bad")).awaitTermination()
    go()
    assert sorted(r.event_id for r in table.events().collect()) == ["x", "y"]
    assert spark.read.json(str(tmp_path / "bad")).count() == 1
    (src / "b.jsonl").write_text(row % (9, 3, "z"))
    go()
    assert sorted(r.event_id for r in table.events().collect()) == ["x", "y", "z"]


def test_windowed_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join('{"entity": "s", "timestamp": %d, "type": "cpu", "value": %d}\n' % (t, t) for t in (100, 110, 3700, 90000)))
    out = streaming.windowed(streaming.stream_events(streaming.read_stream(spark, str(tmp_path))))
    q = out.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start.timestamp(), r.event_count) for r in spark.sql("SELECT * FROM w").collect()}
    assert sorted(got) == [(0.0, 2), (3600.0, 1)]


def test_pages(spark):
    html = "<TITLE> A\nb </TITLE><meta charset=x><meta name='description' content='about it'><h1 class=k>Hi <b>you</b></h1><a href=/x>1</a><a href='mailto:q'>2</a><a HREF=\"http://y\">3</a><script></script><SCRIPT/><img><form>"
    df = spark.createDataFrame([(1, "https://h.example:8080/p?q", html), (2, "plain.example/x", "<p>no</p>"), (3, None, None)], "page_id long, url string, html string")
    a, b, c = pages.describe(df).orderBy("page_id").collect()
    assert (a.entity, a.scheme, a.title, a.description, a.heading, a.links) == ("h.example:8080", "HTTPS", "A\nb", "about it", "Hi you", ["/x", "http://y"])
    assert (a.n_links, a.n_scripts, a.n_images, a.n_forms, a.size_kb) == (3, 2, 1, 1, round(len(html) / 1024, 2))
    assert (b.entity, b.title, b.description, b.heading) == ("plain.example", "Unknown Domain", "No meta description defined.", "No primary heading")
    assert (c.entity, c.size_kb) == ("web-target", 0.0)
    made = pages.page_events(df, F.lit(1000), F.lit(120.0), F.when(F.col("page_id") == 2, 502).otherwise(200)).filter("entity = 'plain.example'").orderBy("sequence_num").collect()
    assert [(r.sequence_num, r.timestamp, r.type, r.value_num) for r in made] == [
        (16, 955, "latency", 108.0), (17, 956, "cpu", 9.0), (18, 957, "memory", 32.0), (19, 970, "latency", 132.0), (20, 971, "cpu", 12.2), (21, 972, "memory", 32.8),
        (22, 985, "latency", 156.0), (23, 986, "cpu", 15.4), (24, 987, "memory", 33.6), (25, 1000, "latency", 180.0), (26, 1001, "cpu", 18.6), (27, 1002, "memory", 34.4),
        (28, 1001, "size_kb", 0.01), (29, 1002, "status_code", 502.0), (30, 1003, "errors", 1.0),
    ]
    assert json.loads(made[0].attributes) == {"phase": "POWER", "sample": 0, "status": 502, "url": "plain.example/x"} and json.loads(made[14].attributes)["error_type"] == "HTTP_ERROR"
    four = pages.page_events(df, F.lit(1000), F.array(*[F.lit(x) for x in (1.5, 2.5, 3.5, 4.5)])).filter("type = 'latency' AND sequence_num <= 15").orderBy("sequence_num")
    assert [r.value_num for r in four.collect()] == [1.5, 2.5, 3.5, 4.5]


def test_cli(spark, tmp_path, capsys):
    d = str(tmp_path / "db")
    (tmp_path / "in.jsonl").write_text('{"entity": "s", "timestamp": 1, "type": "cpu", "value": 90}\nnope\n')
    for argv in (["init"], ["ingest", str(tmp_path / "in.jsonl")], ["query", "FIND cpu WHERE value > 80"], ["analyze", "s"], ["analyze", "s", "--metric", "cpu"], ["verify"], ["compact"], ["stats"], ["flush"]):
        assert cli.main(["--dir", d, *argv]) == 0
    assert "1 rows, 1 scanned" in capsys.readouterr().out
    bench = cli.bench_events(spark)
    assert bench.filter("entity = 'server-1'").count() == 1000 and bench.filter("entity = 'server-1' AND value_num > 80").count() == 200
