"""Registered queries of the event engine and their DuckDB twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import canonical_json, event_id
from .functions.timestamps import parse_text
from .model import from_clickstream
from .operators import anomalies, correlation, scan, statistics, temporal
from .plans.compiler import query
from .sources import jsonl, pages
from .session import shared_folder
from .sources.table import EventTable, prune, segment_bounds

T1, T2 = 1_705_000_000, 1_706_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_clickstream(spark.read.parquet(f"{sf_dir}/events.parquet"))


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ten entities, dense enough for evidence and correlation."""
    return from_clickstream(spark.read.parquet(f"{sf_dir}/events.parquet"), F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")))


def _ev(entity: str = "'user-' || user_id") -> str:
    return f"""WITH ev AS (SELECT CAST(event_id AS VARCHAR) AS event_id, {entity} AS entity, epoch_us(ts) // 1000000 AS timestamp,
  lower(trim(event_type)) AS type, CAST(value AS DOUBLE) AS value_num, CAST(value AS DOUBLE) AS v, props AS attributes, event_id AS sequence_num FROM events)"""


EV, HOST = _ev(), _ev("'host-' || (user_id % 10)")
FIND_COLS = "timestamp, entity, type, CAST(v AS VARCHAR) AS value, value_num, event_id"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("FIND purchase FROM user-12 WHERE value > 50 ORDER BY timestamp DESC LIMIT 5", events(spark, sf_dir))


def _find(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(text, events(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 8, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _register(name: str, sql: str | None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


REGISTRY["find_filter_order_limit"] = (
    _find("FIND purchase FROM user-12 WHERE value > 50 ORDER BY timestamp DESC LIMIT 5"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE type = 'purchase' AND entity = 'user-12' AND value_num > 50 ORDER BY timestamp DESC, sequence_num, event_id LIMIT 5",
)
REGISTRY["find_order_by_value"] = (
    _find("SELECT view, click WHERE value >= 20 ORDER BY value DESC LIMIT 50"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE type IN ('view', 'click') AND value_num >= 20 ORDER BY value_num DESC NULLS LAST, timestamp, sequence_num, event_id LIMIT 50",
)
REGISTRY["find_between"] = (
    _find("FIND error BETWEEN '2024-01-03T00:00:00Z' AND 1704900000 WHERE value != 6.55"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE type = 'error' AND timestamp BETWEEN 1704240000 AND 1704900000 AND value_num <> 6.55",
)
REGISTRY["find_attribute_filter"] = (
    _find("FIND * WHERE k >= 90 AND type != 'view' AND k != 95"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE CAST(json_extract(attributes, '$.k') AS BIGINT) >= 90 AND type <> 'view' AND CAST(json_extract(attributes, '$.k') AS BIGINT) <> 95",
)
REGISTRY["find_attribute_number"] = (
    _find("FIND events WHERE k < 10 AND k != 'x'"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE CAST(json_extract(attributes, '$.k') AS BIGINT) < 10",
)
REGISTRY["find_multi_target"] = (
    _find("FIND purchase, signup FROM user-7 WHERE timestamp > 1704200000"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE type IN ('purchase', 'signup') AND entity = 'user-7' AND timestamp > 1704200000",
)
REGISTRY["find_where_slots"] = (
    _find("find events from user-1 where entity = 'user-3' and type = error and value <= 10"),
    f"{EV} SELECT {FIND_COLS} FROM ev WHERE entity = 'user-3' AND type = 'error' AND value_num <= 10",
)


@_register("timeline_latest", f"{EV}, t AS (SELECT *, count(*) OVER () AS total FROM ev) SELECT event_id, timestamp, entity, type, value_num, total FROM t ORDER BY timestamp DESC, sequence_num DESC, event_id DESC LIMIT 200")
def timeline_latest(spark, sf_dir):
    return scan.timeline(events(spark, sf_dir)).select("event_id", "timestamp", "entity", "type", "value_num", "total")


STATS_SQL = (
    "count(*) AS count, round(min(v), 8) AS min, round(max(v), 8) AS max, round(avg(v), 8) AS mean, round(quantile_cont(v, 0.5), 8) AS median, "
    "round(stddev_pop(v), 8) AS stddev, round(quantile_cont(v, 0.9), 8) AS p90, round(quantile_cont(v, 0.95), 8) AS p95, round(quantile_cont(v, 0.99), 8) AS p99"
)


@_register("metric_summary", f"{EV} SELECT entity, type, {STATS_SQL} FROM ev WHERE v IS NOT NULL GROUP BY ALL")
def metric_summary(spark, sf_dir):
    return _rounded(statistics.metric_summary(events(spark, sf_dir)))


@_register("entity_profile", f"{EV} SELECT entity, count(*) AS total_events, min(timestamp) AS first_seen, max(timestamp) AS last_seen, max(timestamp) - min(timestamp) AS active_span_seconds FROM ev GROUP BY entity")
def entity_profile(spark, sf_dir):
    return statistics.profile_totals(events(spark, sf_dir))


def _anomaly_sql(ev: str, least: int, z: float, critical: float, high: float, medium: float) -> str:
    return f"""{ev}, b AS (SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS stddev, count(*) OVER w AS samples FROM ev WINDOW w AS (PARTITION BY entity, type)),
z AS (SELECT *, (v - mean) / stddev AS z FROM b WHERE samples >= {least} AND stddev >= 1e-5),
a AS (SELECT *, CASE WHEN abs(z) >= {critical} THEN 'CRITICAL' WHEN abs(z) >= {high} THEN 'HIGH' WHEN abs(z) >= {medium} THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM z WHERE abs(z) >= {z})"""


ANOMALY_COLS = "event_id, entity, type, value_num, round(mean, 8) AS mean, round(stddev, 8) AS stddev, round(z, 8) AS z_score, round(CASE WHEN mean = 0 THEN 0 ELSE (v - mean) / mean * 100 END, 8) AS deviation_pct, severity"


def _anomalies(preset):
    def run(spark, sf_dir):
        found = anomalies.detect(events(spark, sf_dir), preset)
        cols = ["event_id", "entity", "type", "value_num", *[F.round(c, 8).alias(c) for c in ("mean", "stddev", "z_score")], F.round("deviation_pct", 8).alias("deviation_pct"), "severity"]
        return found.select(*cols)

    return run


REGISTRY["anomalies_primary"] = (_anomalies(anomalies.PRIMARY), f"{_anomaly_sql(EV, 4, 1.5, 3.5, 2.5, 1.5)} SELECT {ANOMALY_COLS} FROM a")
REGISTRY["anomalies_contract"] = (_anomalies(anomalies.CONTRACT), f"{_anomaly_sql(EV, 5, 2.5, 4.0, 3.0, 2.0)} SELECT {ANOMALY_COLS} FROM a")


@_register(
    "anomaly_evidence",
    f"""{_anomaly_sql(HOST, 4, 1.5, 3.5, 2.5, 1.5)},
n AS (SELECT a.entity, a.event_id AS anomaly_id, e.event_id, abs(e.timestamp - a.timestamp) AS distance,
 e.type || ' (seq ' || e.sequence_num || ', val=' || coalesce(CAST(e.v AS VARCHAR), 'None') || ')' AS text,
 row_number() OVER (PARTITION BY a.entity, a.event_id ORDER BY abs(e.timestamp - a.timestamp), e.timestamp, e.sequence_num, e.event_id) AS rank
 FROM a JOIN ev e ON e.entity = a.entity AND abs(e.timestamp - a.timestamp) <= 300 AND e.event_id <> a.event_id)
SELECT entity, anomaly_id, CAST(rank AS INT) AS rank, event_id, distance, text FROM n WHERE rank <= 5""",
)
def anomaly_evidence(spark, sf_dir):
    rows = host_events(spark, sf_dir)
    return anomalies.evidence_rows(anomalies.detect(rows), rows)


def _correlation_sql(ev: str) -> str:
    return f"""{ev}, s AS (SELECT entity, type, timestamp AS ts, arg_max(v, sequence_num) AS v, min(sequence_num) AS seen FROM ev WHERE v IS NOT NULL GROUP BY ALL),
m AS (SELECT entity, type, min(sequence_num) AS f FROM ev WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT a.entity, a.type AS metric_a, b.type AS metric_b FROM m a JOIN m b ON a.entity = b.entity AND a.f < b.f),
n AS (SELECT c.*, l.ts, l.v AS x, r.v AS y, row_number() OVER (PARTITION BY c.entity, metric_a, metric_b, l.ts ORDER BY abs(l.ts - r.ts), r.seen) AS k
 FROM c JOIN s l ON l.entity = c.entity AND l.type = metric_a JOIN s r ON r.entity = c.entity AND r.type = metric_b AND abs(l.ts - r.ts) <= 120),
p AS (SELECT entity, metric_a, metric_b, count(*) AS samples, CASE WHEN count(*) * stddev_pop(x) * stddev_pop(y) < 1e-9 THEN 0 ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r FROM n WHERE k = 1 GROUP BY ALL HAVING count(*) >= 3)
SELECT entity, metric_a, metric_b, samples, round(r, 8) AS correlation, CASE WHEN r >= .7 THEN 'STRONG_POSITIVE' WHEN r >= .3 THEN 'MODERATE_POSITIVE' WHEN r <= -.7 THEN 'STRONG_NEGATIVE' WHEN r <= -.3 THEN 'MODERATE_NEGATIVE' ELSE 'NEGLIGIBLE' END AS relationship FROM p"""


@_register("metric_correlations", _correlation_sql(HOST))
def metric_correlations(spark, sf_dir):
    return _rounded(correlation.correlate(host_events(spark, sf_dir)))


@_register("metric_correlations_global", _correlation_sql(_ev("'all'")))
def metric_correlations_global(spark, sf_dir):
    found = correlation.correlate(events(spark, sf_dir), ())
    return _rounded(found.withColumn("entity", F.lit("all")))


def _bucket_sql(key: str, width: int) -> str:
    return f"""{EV}, g AS (SELECT {key}, min(timestamp) AS t0, max(timestamp) AS t1 FROM ev GROUP BY ALL),
b AS (SELECT ev.{key}, (timestamp - t0) // {width} AS slot, count(*) AS event_count, avg(v) AS mean, min(v) AS min, max(v) AS max FROM ev JOIN g USING ({key}) GROUP BY ALL),
s AS (SELECT {key}, t0, unnest(generate_series(0, (t1 - t0) // {width})) AS slot FROM g)
SELECT {key}, t0 + slot * {width} AS window_start, t0 + slot * {width} + {width} AS window_end, coalesce(event_count, 0) AS event_count,
 round(coalesce(mean, 0), 8) AS mean, round(coalesce(min, 0), 8) AS min, round(coalesce(max, 0), 8) AS max FROM s LEFT JOIN b USING ({key}, slot)"""


@_register("time_buckets", _bucket_sql("entity", 86400))
def time_buckets(spark, sf_dir):
    return _rounded(temporal.buckets(events(spark, sf_dir), 86400))


@_register("analyze_group_by_hour", _bucket_sql("type", 3600))
def analyze_group_by_hour(spark, sf_dir):
    return _rounded(query("ANALYZE * GROUP BY hour", events(spark, sf_dir)))


@_register("analyze_metric", f"{EV} SELECT type, {STATS_SQL} FROM ev WHERE type = 'purchase' AND entity = 'user-12' GROUP BY type")
def analyze_metric(spark, sf_dir):
    return _rounded(query("ANALYZE purchase FROM user-12", events(spark, sf_dir)))


@_register("state_as_of", f"{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, type ORDER BY timestamp DESC, sequence_num DESC, event_id DESC) AS k FROM ev WHERE timestamp <= {T2}) SELECT entity, type, value_num, timestamp AS last_time FROM r WHERE k = 1")
def state_as_of(spark, sf_dir):
    return query(f"STATE AS OF {T2}", events(spark, sf_dir)).select("entity", "type", "value_num", "last_time")


@_register("last_event_as_of", f"{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY timestamp DESC, sequence_num DESC, event_id DESC) AS k FROM ev WHERE timestamp <= {T1}) SELECT entity, type AS last_event_type, timestamp AS last_event_time FROM r WHERE k = 1")
def last_event_as_of(spark, sf_dir):
    return temporal.last_event_as_of(events(spark, sf_dir), T1)


@_register(
    "temporal_diff",
    f"""{EV}, a AS (SELECT entity, type, arg_max(v, sequence_num) AS x FROM ev WHERE timestamp <= {T1} GROUP BY ALL),
b AS (SELECT entity, type, arg_max(v, sequence_num) AS y FROM ev WHERE timestamp <= {T2} GROUP BY ALL)
SELECT entity, type AS metric, round(x, 8) AS value_t1, round(y, 8) AS value_t2, round(coalesce(y, 0) - coalesce(x, 0), 8) AS absolute_diff,
 round(CASE WHEN coalesce(x, 0) = 0 THEN 0 ELSE (coalesce(y, 0) - x) / x * 100 END, 8) AS percent_diff FROM b LEFT JOIN a USING (entity, type)""",
)
def temporal_diff(spark, sf_dir):
    return _rounded(query(f"DIFF FROM {T1} TO {T2}", events(spark, sf_dir)))


@_register("intervening_events", f"{EV} SELECT entity, timestamp, event_id, type, type || ' (val=' || coalesce(CAST(v AS VARCHAR), 'None') || ' at t=' || timestamp || ')' AS text FROM ev WHERE entity = 'user-12' AND timestamp > {T1} AND timestamp <= {T2} AND type <> 'purchase'")
def intervening_events(spark, sf_dir):
    rows = scan.scan(events(spark, sf_dir), "user-12")
    return temporal.intervening(rows, "purchase", T1, T2).select("entity", "timestamp", "event_id", "type", "text")


@_register(
    "rate_of_change",
    f"{EV}, r AS (SELECT *, timestamp - lag(timestamp) OVER w AS dt, v - lag(v) OVER w AS dv FROM ev WINDOW w AS (PARTITION BY entity, type ORDER BY timestamp, sequence_num, event_id)) SELECT event_id, round(CASE WHEN dt > 0 THEN dv / dt END, 8) + 0.0 AS rate FROM r",
)
def rate_of_change(spark, sf_dir):
    return temporal.rate_of_change(events(spark, sf_dir)).select("event_id", (F.round("rate", 8) + 0.0).alias("rate"))


@_register("compact_dedup", f"{EV}, u AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (sequence_num + 1 AS sequence_num, v + 1 AS value_num) FROM ev WHERE sequence_num % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, sequence_num) AS k FROM u) SELECT event_id, entity, timestamp, type, value_num, sequence_num FROM r WHERE k = 1")
def compact_dedup(spark, sf_dir):
    rows = events(spark, sf_dir)
    again = rows.filter(F.col("sequence_num") % 3 == 0).withColumn("sequence_num", F.col("sequence_num") + 1).withColumn("value_num", F.col("value_num") + 1)
    return scan.dedup_by_id(rows.unionByName(again)).select("event_id", "entity", "timestamp", "type", "value_num", "sequence_num")


@_register(
    "prune_candidates",
    f"""{EV}, d AS (SELECT timestamp // 86400 AS day, count(*) AS n_rows, min(timestamp) AS min_ts, max(timestamp) AS max_ts, bool_or(entity = 'user-12') AS has_e, bool_or(type = 'purchase') AS has_t FROM ev GROUP BY ALL)
SELECT day, n_rows, min_ts, max_ts FROM d WHERE has_e AND has_t AND max_ts >= {T1} AND min_ts <= {T2}""",
)
def prune_candidates(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp") / 86400))
    return prune(segment_bounds(rows, "day"), "user-12", ["purchase"], T1, T2).select("day", "n_rows", "min_ts", "max_ts")


@_register(
    "event_id_hash",
    f"{EV} SELECT event_id, substr(sha256(sequence_num || ':' || entity || ':' || timestamp || ':' || type || ':' || coalesce(CAST(v AS VARCHAR), 'None') || ':' || CAST(json(attributes) AS VARCHAR)), 1, 24) AS id_hash FROM ev",
)
def event_id_hash(spark, sf_dir):
    rows = events(spark, sf_dir)
    made = event_id(F.col("sequence_num"), F.col("entity"), F.col("timestamp"), F.col("type"), F.col("value_str"), canonical_json(F.col("attributes")))
    return rows.select("event_id", made.alias("id_hash"))


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver rows as JSON lines, some of them spoiled."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, props = F.col("event_id"), F.coalesce("props", F.lit("{}"))
    ts = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    entity = F.when(i % 11 == 0, F.lit('"  "')).otherwise(F.concat(F.lit('"user-'), F.col("user_id").cast("string"), F.lit('"')))
    stamp = F.when(i % 13 == 0, F.lit('"soon"')).when(i % 2 == 0, F.concat(F.lit('"'), ts, F.lit('"'))).otherwise(ts)
    value = F.when(i % 17 == 0, F.lit("[1]")).when(i % 19 == 0, F.lit("true")).otherwise(F.col("value").cast("string"))
    attributes = F.when(i % 23 == 0, F.lit("3")).otherwise(props)
    line = F.concat(F.lit('{"entity": '), entity, F.lit(', "timestamp": '), stamp, F.lit(', "type": " '), F.upper("event_type"), F.lit(' ", "value": '), value, F.lit(', "attributes": '), attributes, F.lit("}"))
    line = F.when(i % 29 == 0, F.substring(line, 1, 20)).otherwise(line)
    return e.select(i.alias("line_no"), line.alias("raw"))


_CHECK = """CASE WHEN event_id % 29 = 0 THEN 'invalid JSON' WHEN event_id % 11 = 0 THEN 'missing or empty field: entity' WHEN event_id % 13 = 0 THEN 'invalid timestamp'
 WHEN event_id % 17 = 0 THEN 'value is not a number, text or boolean' WHEN event_id % 23 = 0 THEN 'attributes is not an object' ELSE 'accepted' END"""


@_register("validate_report", f"SELECT {_CHECK} AS outcome, count(*) AS n_lines FROM events GROUP BY ALL")
def validate_report(spark, sf_dir):
    checked = jsonl.validate(jsonl.keep_payload(_raw_lines(spark, sf_dir)), F.col("line_no"))
    return checked.groupBy(F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n_lines"))


@_register("ingest_events", f"""SELECT event_id AS sequence_num, 'user-' || user_id AS entity, epoch_us(ts) // 1000000 AS timestamp, lower(event_type) AS type,
 CASE WHEN event_id % 19 = 0 THEN 1.0 ELSE value END AS value_num, CASE WHEN event_id % 19 = 0 THEN 'bool' ELSE 'number' END AS value_kind FROM events WHERE {_CHECK} = 'accepted'""")
def ingest_events(spark, sf_dir):
    checked = jsonl.validate(jsonl.keep_payload(_raw_lines(spark, sf_dir)), F.col("line_no"))
    return jsonl.accepted(checked).select("sequence_num", "entity", "timestamp", "type", "value_num", "value_kind")


@_register(
    "ingest_report",
    f"""WITH o AS (SELECT event_id, {_CHECK} AS outcome, CASE WHEN event_id % 29 = 0 THEN 0 ELSE 1 END AS ok FROM events),
n AS (SELECT *, sum(ok) OVER (ORDER BY event_id) AS seq FROM o)
SELECT outcome, count(*) AS n_lines, min(event_id) AS first_line, min(CASE WHEN ok = 1 THEN CAST(seq AS BIGINT) END) AS first_seq, max(CASE WHEN ok = 1 THEN CAST(seq AS BIGINT) END) AS last_seq FROM n GROUP BY ALL""",
)
def ingest_report(spark, sf_dir):
    """Lines numbered over those that parse, and the outcome of each."""
    checked = jsonl.ingest(jsonl.keep_payload(_raw_lines(spark, sf_dir)))
    seq = F.when(F.col("parsed"), F.col("sequence_num"))
    return checked.groupBy(F.coalesce("error", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


@_register(
    "timestamp_forms",
    "SELECT event_id, epoch_us(ts) // 1000000 AS iso, epoch_us(ts) // 1000000 - 7200 AS shifted, epoch_us(date_trunc('day', ts)) // 1000000 AS day, epoch_us(ts) // 1000000 AS number FROM events",
)
def timestamp_forms(spark, sf_dir):
    """The same moment in ISO 8601 forms, with a zone, as a date and as numeric text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    texts = {"iso": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "shifted": F.date_format(at, "yyyy-MM-dd HH:mm:ss'+02:00'"), "day": F.date_format(at, "yyyyMMdd"), "number": F.unix_seconds(at).cast("string")}
    rows = e.select("event_id", *[t.alias(f"t_{n}") for n, t in texts.items()])
    return rows.select("event_id", *[parse_text(F.col(f"t_{n}")).alias(n) for n in texts])


def _stored(spark: SparkSession, sf_dir: str) -> EventTable:
    """The driver's events in a table of three appends, one of them repeated, in the folder that executors share."""
    table = EventTable(spark, f"{shared_folder(spark)}/tidemark-table-{uuid.uuid4().hex}")
    rows = events(spark, sf_dir)
    for k in (0, 1, 2, 0):
        table.append(rows.filter(F.col("sequence_num") % 3 == k))
    return table


@_register("table_compact", f"{EV} SELECT event_id, entity, timestamp, type, value_num, sequence_num FROM ev")
def table_compact(spark, sf_dir):
    """Written, read back, compacted: every event once."""
    table = _stored(spark, sf_dir)
    table.compact()
    table.vacuum()
    return table.events().select("event_id", "entity", "timestamp", "type", "value_num", "sequence_num")


@_register("table_verify", "SELECT 'HEALTHY' AS status, count(*) + sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_rows FROM events")
def table_verify(spark, sf_dir):
    return _stored(spark, sf_dir).verify().groupBy("status").agg(F.sum("n_rows").alias("n_rows"))


@_register("table_stats", f"{EV} SELECT count(*) + sum(CASE WHEN sequence_num % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_rows, min(timestamp) AS min_ts, max(timestamp) AS max_ts, min(sequence_num) AS min_seq, max(sequence_num) AS max_seq FROM ev")
def table_stats(spark, sf_dir):
    return _stored(spark, sf_dir).segments().agg(F.sum("n_rows").alias("n_rows"), *[f(c).alias(c) for c, f in (("min_ts", F.min), ("max_ts", F.max), ("min_seq", F.min), ("max_seq", F.max))])


@_register(
    "page_metrics",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://([^/?#]*)', 1, 'i'), ''), 'web-target') AS entity,
 CASE WHEN regexp_matches(html, '<title>(.*?)</title>', 'is') THEN trim(regexp_extract(html, '<title>(.*?)</title>', 1, 'is')) ELSE 'Unknown Domain' END AS title,
 CASE WHEN regexp_matches(html, '<h1[^>]*>(.*?)</h1>', 'is') THEN trim(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]+>', '', 'g')) ELSE 'No primary heading' END AS heading,
 CASE WHEN regexp_matches(html, '<meta[^>]*name=[''"]description[''"][^>]*content=[''"](.*?)[''"]', 'i') THEN trim(regexp_extract(html, '<meta[^>]*name=[''"]description[''"][^>]*content=[''"](.*?)[''"]', 1, 'i')) ELSE 'No meta description defined.' END AS description,
 len(regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1, 'i')) AS n_links,
 array_to_string(list_filter(regexp_extract_all(html, 'href=[''"]?([^''" >]+)', 1, 'i'), lambda x: starts_with(x, 'http') OR starts_with(x, '/'))[1:5], ' ') AS links,
 len(regexp_extract_all(html, '<script', 0, 'i')) AS n_scripts, len(regexp_extract_all(html, '<img', 0, 'i')) AS n_images, len(regexp_extract_all(html, '<form', 0, 'i')) AS n_forms,
 round_even(octet_length(encode(html)) / 1024.0, 2) AS size_kb FROM pages""",
)
def page_metrics(spark, sf_dir):
    found = pages.describe(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "entity", "title", "description", "heading", "n_links", F.array_join("links", " ").alias("links"), "n_scripts", "n_images", "n_forms", "size_kb")


@_register(
    "page_events",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1, 'i') AS entity, round_even(octet_length(encode(html)) / 1024.0, 2) AS kb, len(regexp_extract_all(html, '<script', 0, 'i')) AS s,
 10.0 + page_id % 7 AS ms, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS code FROM pages),
t AS (SELECT *, unnest(range(4)) AS i FROM p), u AS (SELECT *, round(ms * (0.9 + 0.2 * i), 2) AS l, 1700000000 - 15 * (3 - i) AS tm FROM t),
e AS (SELECT page_id, entity, 3 * i AS place, tm, 'latency' AS type, l AS v FROM u
 UNION ALL SELECT page_id, entity, 3 * i + 1, tm + 1, 'cpu', floor(least(100.0, greatest(2.5, l / 12.0 + s * 1.5 + i * 1.2)) * 10 + 0.5) / 10 FROM u
 UNION ALL SELECT page_id, entity, 3 * i + 2, tm + 2, 'memory', floor(least(100.0, greatest(15.0, kb / 4.0 + 32.0 + i * 0.8)) * 10 + 0.5) / 10 FROM u
 UNION ALL SELECT page_id, entity, 12, 1700000001, 'size_kb', kb FROM p UNION ALL SELECT page_id, entity, 13, 1700000002, 'status_code', code FROM p
 UNION ALL SELECT page_id, entity, 14, 1700000003, 'errors', CASE WHEN code >= 400 THEN 1.0 ELSE 0.0 END FROM p)
SELECT entity, (page_id - 1) * 15 + place + 1 AS sequence_num, tm AS timestamp, type, round(v, 6) AS value_num FROM e""",
)
def page_events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    made = pages.page_events(rows, F.lit(1_700_000_000), F.lit(10.0) + F.col("page_id") % 7, status)
    return made.select("entity", "sequence_num", "timestamp", "type", F.round("value_num", 6).alias("value_num"))


@_register(
    "entity_report",
    f"""{_anomaly_sql(HOST, 4, 1.5, 3.5, 2.5, 1.5)},
f AS (SELECT entity, type, min((timestamp, sequence_num, event_id)) AS first, {STATS_SQL} FROM ev WHERE v IS NOT NULL GROUP BY entity, type),
r AS (SELECT a.entity, a.event_id, row_number() OVER (PARTITION BY a.entity ORDER BY f.first, a.timestamp, a.sequence_num, a.event_id) AS k FROM a JOIN f USING (entity, type)),
n AS (SELECT entity, count(*) AS anomaly_count, least(count(*), 10) AS total_anomalies_detected, string_agg(CASE WHEN k <= 10 THEN event_id END, ',' ORDER BY k) AS recent FROM r GROUP BY entity),
o AS (SELECT entity, string_agg(metric_a || '~' || metric_b || ':' || samples || ':' || relationship, ',' ORDER BY metric_a, metric_b) AS correlated FROM ({_correlation_sql(HOST)}) GROUP BY entity),
t AS (SELECT entity, count(*) AS total_events, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev GROUP BY entity)
SELECT t.*, coalesce(anomaly_count, 0) AS anomaly_count, coalesce(total_anomalies_detected, 0) AS total_anomalies_detected, coalesce(recent, '') AS recent, coalesce(correlated, '') AS correlated,
 f.type AS metric, f.* EXCLUDE (entity, type, first) FROM t LEFT JOIN n USING (entity) LEFT JOIN o USING (entity) LEFT JOIN f USING (entity)""",
)
def entity_report(spark, sf_dir):
    """Profile of every entity with its first anomalies and its correlations, a row for each metric."""
    rows = host_events(spark, sf_dir)
    report = correlation.diagnostic_report(statistics.profile(rows, anomalies.detect(rows)), correlation.correlate(rows))
    recent = F.coalesce(F.array_join(F.transform("recent_anomalies", lambda a: a["event_id"]), ","), F.lit(""))
    told = lambda c: F.concat(c["metric_a"], F.lit("~"), c["metric_b"], F.lit(":"), c["samples"].cast("string"), F.lit(":"), c["relationship"])
    correlated = F.coalesce(F.array_join(F.transform("correlations", told), ","), F.lit(""))
    flat = report.select("entity", "total_events", "first_seen", "last_seen", "anomaly_count", "total_anomalies_detected", recent.alias("recent"), correlated.alias("correlated"), F.explode_outer("metrics").alias("metric", "m"))
    return _rounded(flat.select(*[c for c in flat.columns if c != "m"], "m.*"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
