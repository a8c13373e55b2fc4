"""Descriptive statistics of numeric events, and entity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import numeric, order_key

SUMMARY = ("count", "min", "max", "mean", "median", "stddev", "p90", "p95", "p99")


def summary_columns(value: str = "value_num") -> list[Column]:
    """count, min, max, mean, median, population stddev and interpolated percentiles; zeros without a value."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.count(v).alias("count"),
        zero(F.min(v)).alias("min"),
        zero(F.max(v)).alias("max"),
        zero(F.avg(v)).alias("mean"),
        zero(F.get(q, 0)).alias("median"),
        zero(F.stddev_pop(v)).alias("stddev"),
        zero(F.get(q, 1)).alias("p90"),
        zero(F.get(q, 2)).alias("p95"),
        zero(F.get(q, 3)).alias("p99"),
    ]


def metric_summary(events: DataFrame, by: tuple[str, ...] = ("entity", "type")) -> DataFrame:
    """One row for each group of `by`; with no group, one row even without events."""
    return numeric(events).groupBy(*by).agg(*summary_columns())


def profile_totals(events: DataFrame) -> DataFrame:
    """Per entity: number of all events, first and last second, and the span between."""
    return events.groupBy("entity").agg(
        F.count("*").alias("total_events"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        (F.max("timestamp") - F.min("timestamp")).alias("active_span_seconds"),
    )


def profile(events: DataFrame, anomalies: DataFrame, most: int = 10) -> DataFrame:
    """profile_totals with `metrics`, a map from type to its summary, and the first `most` anomalies in order.

    The order is by the metric's first event, then by event. `anomaly_count` is uncapped.
    """
    per_type = numeric(events).groupBy("entity", "type").agg(*summary_columns(), F.min(order_key()).alias("first"))
    maps = per_type.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct(*SUMMARY)))).alias("metrics"))
    shown = anomalies.join(per_type.select("entity", "type", "first"), ["entity", "type"])
    shown = shown.select("entity", "first", order_key().alias("at"), "type", "event_id", "value_num", "z_score", "severity")
    # of a busy entity only the first `most` are ever gathered
    place = Window.partitionBy("entity").orderBy("first", "at", "type", "event_id")
    few = shown.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    few = few.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "at", "type", "event_id", "value_num", "z_score", "severity"))).alias("a"))
    shown = shown.groupBy("entity").agg(F.count("*").alias("anomaly_count")).join(few, "entity")
    shown = shown.select("entity", "anomaly_count", F.transform("a", lambda x: F.struct(x["at"]["timestamp"].alias("timestamp"), x["type"].alias("type"), x["event_id"].alias("event_id"), x["value_num"].alias("value"), x["z_score"].alias("z_score"), x["severity"].alias("severity"))).alias("recent_anomalies"))
    out = profile_totals(events).join(maps, "entity", "left").join(shown, "entity", "left")
    return out.withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0))).withColumn("total_anomalies_detected", F.least("anomaly_count", F.lit(most)))
