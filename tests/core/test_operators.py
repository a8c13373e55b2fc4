import pytest
from helpers import DEMO, T, events
from pyspark.sql import functions as F

from tidemark.operators import anomalies, correlation, scan, statistics, temporal


@pytest.fixture(scope="module")
def demo(spark):
    return events(spark, DEMO).cache()


def test_summary_of_the_demo(demo):
    got = {r.type: r for r in statistics.metric_summary(demo).collect()}
    want = {
        "cpu": (6, 39.9, 94.2, 53.333333, 41.85, 19.736908, 77.8, 86.0, 92.56),
        "memory": (2, 48.5, 49.1, 48.8, 48.8, 0.3, 49.04, 49.07, 49.094),
        "errors": (3, 2, 41, 20, 17, 16.062378, 36.2, 38.6, 40.52),
        "latency": (1, 84, 84, 84, 84, 0, 84, 84, 84),
    }
    assert set(got) == set(want)
    for k, v in want.items():
        assert [got[k][c] for c in statistics.SUMMARY] == pytest.approx(v, abs=1e-5)


def test_summary_of_five_and_of_none(spark):
    r = statistics.metric_summary(events(spark, [("a", i, "m", 10 * i) for i in range(1, 6)]), ()).first()
    assert (r["count"], r["mean"], r["p90"], r["p95"]) == (5, 30, 46, 48) and r.stddev == pytest.approx(14.1421, abs=1e-3) and r.p99 == pytest.approx(49.6)
    r = statistics.metric_summary(events(spark, [("a", 1, "m", None)]), ()).first()
    assert tuple(r) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_profile(spark, demo):
    r = statistics.profile(demo, anomalies.detect(demo)).first()
    assert (r.total_events, r.active_span_seconds, r.anomaly_count, r.total_anomalies_detected) == (13, 720, 1, 1)
    assert set(r.metrics) == {"cpu", "memory", "errors", "latency"} and r.recent_anomalies[0]["value"] == 94.2
    report = correlation.diagnostic_report(statistics.profile(demo, anomalies.detect(demo)), correlation.correlate(demo)).first()
    assert [(c["metric_a"], c["metric_b"], c["correlation"]) for c in report.correlations] == [("cpu", "errors", 0.844), ("cpu", "memory", 0.974)]


def test_anomalies_and_evidence(demo):
    found = anomalies.with_evidence(anomalies.detect(demo), demo).collect()
    assert len(found) == 1
    r = found[0]
    assert r.value_num == 94.2 and r.severity == "MEDIUM" and r.z_score == pytest.approx(2.070571, abs=1e-5) and r.deviation_pct == pytest.approx(76.625)
    assert r.evidence == ["errors (seq 11, val=17)", "errors (seq 13, val=41)", "latency (seq 10, val=84.0)", "cpu (seq 9, val=61.4)", "deployment (seq 8, val=v2.8.1)"]
    assert anomalies.detect(demo, anomalies.CONTRACT).count() == 0
    assert [x.severity for x in anomalies.detect(demo, anomalies.CONTRACT, threshold=2.0).collect()] == ["MEDIUM"]


def test_spike_flat_and_few(spark):
    spike = [("a", 1000 + 10 * i, "cpu", 40 + i % 3) for i in range(10)] + [("a", 1105, "deployment", "v2"), ("a", 1110, "cpu", 95)]
    df = events(spark, spike)
    r = anomalies.with_evidence(anomalies.detect(df, anomalies.CONTRACT), df).collect()
    assert [x.value_num for x in r] == [95.0] and any(t.startswith("deployment") for t in r[0].evidence)
    assert anomalies.detect(events(spark, [("a", i, "m", 5) for i in range(9)])).count() == 0
    assert anomalies.detect(events(spark, [("a", i, "m", v) for i, v in enumerate((1, 1, 99))])).count() == 0
    drop = anomalies.detect(events(spark, [("a", i, "m", v) for i, v in enumerate((50, 50, 51, 50, 50, 50, 2))]))
    words = anomalies.with_evidence(drop, drop).first().assessment
    assert "(+-" in words


def test_booleans_count_and_text_does_not(spark):
    df = events(spark, [("a", 1, "up", True), ("a", 2, "up", False), ("a", 3, "up", "yes"), ("a", 4, "up", None)])
    r = statistics.metric_summary(df).first()
    assert (r["count"], r["mean"]) == (2, 0.5)


def test_correlation_goldens(spark, demo):
    got = {(r.metric_a, r.metric_b): r for r in correlation.correlate(demo).collect()}
    assert set(got) == {("cpu", "memory"), ("cpu", "errors")}
    assert got["cpu", "errors"].samples == 4 and got["cpu", "errors"].correlation == pytest.approx(0.843923052463)
    assert got["cpu", "memory"].correlation == pytest.approx(0.974354703692) and got["cpu", "memory"].relationship == "STRONG_POSITIVE"


def test_correlation_cases(spark):
    up = [("a", 10 * i, "x", i) for i in range(5)] + [("a", 10 * i, "y", -2 * i) for i in range(5)] + [("a", 10 * i, "flat", 7) for i in range(5)]
    up += [("a", 40, "x", 100), ("b", 1, "x", 1)]  # the last value of a second wins
    got = {(r.metric_a, r.metric_b): r.correlation for r in correlation.correlate(events(spark, up)).collect()}
    assert got["x", "flat"] == 0.0 and got["y", "flat"] == 0.0 and -1 <= got["x", "y"] < -0.7
    assert correlation.correlate(events(spark, up).limit(0)).count() == 0


def test_buckets(spark, demo):
    df = events(spark, [("a", 1000, "cpu", 10), ("a", 1050, "cpu", 20), ("a", 2000, "cpu", 50)])
    got = [(r.window_start, r.event_count, r["mean"]) for r in temporal.buckets(df, 500).orderBy("window_start").collect()]
    assert got == [(1000, 2, 15.0), (1500, 0, 0.0), (2000, 1, 50.0)]
    got = [(r.window_start - T, r.event_count, round(r["mean"], 3), r["min"], r["max"]) for r in temporal.buckets(demo, 300, ()).orderBy("window_start").collect()]
    assert got == [(0, 5, 44.42, 40.8, 49.1), (300, 5, 46.825, 2, 84), (600, 3, 50.733, 17, 94.2)]
    with pytest.raises(ValueError):
        temporal.buckets(demo, 0)


def test_state_and_difference(spark):
    df = events(spark, [("a", 1000, "cpu", 40), ("a", 1005, "memory", 70), ("a", 1007, "gone", 3), ("a", 1008, "gone", None), ("a", 1010, "cpu", 90), ("a", 1020, "cpu", 99)])
    got = {r.type: (r.value_num, r.value_kind) for r in temporal.state_as_of(df, 1008).collect()}
    assert got == {"cpu": (40, "number"), "memory": (70, "number"), "gone": (None, "null")}
    assert tuple(temporal.last_event_as_of(df, 1006).first()) == ("a", "memory", 1005)
    df = events(spark, [("a", 1000, "cpu", 40), ("a", 1005, "deployment", "v2.0"), ("a", 1010, "cpu", 80)])
    r = temporal.difference(df.filter("type = 'cpu'"), 1000, 1010).first()
    assert (r.value_t1, r.value_t2, r.absolute_diff, r.percent_diff) == (40, 80, 40, 100)
    assert [r.text for r in temporal.intervening(df, "cpu", 1000, 1010).collect()] == ["deployment (val=v2.0 at t=1005)"]
    assert temporal.intervening(df, "cpu", 1005, 1010).count() == 0  # open on the left


def test_rate_timeline_and_dedup(spark, demo):
    rates = {r.event_id: r.rate for r in temporal.rate_of_change(demo).filter("type = 'memory'").collect()}
    assert rates == {"e2": None, "e4": pytest.approx(0.6 / 120)}
    latest = scan.timeline(demo, limit=3).collect()
    assert [r.event_id for r in latest] == ["e13", "e12", "e11"] and {r.total for r in latest} == {13}
    twice = demo.unionByName(demo.withColumn("sequence_num", F.col("sequence_num") + 100).withColumn("value_str", F.lit("later")))
    once = scan.dedup_by_id(twice)
    assert once.count() == 13 and once.filter("value_str = 'later'").count() == 0
