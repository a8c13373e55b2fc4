"""Deviations from a metric's mean, and the events around them.

The baseline of a metric is its own population mean and deviation within the scope, the
outlier included. It is aggregated and joined back, so a hot metric needs no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import numeric

#: Evidence lies this close, inclusive.
NEARBY_SECONDS = 300
FLAT = 1e-5


@dataclass(frozen=True)
class Preset:
    least_samples: int
    threshold: float
    critical: float
    high: float
    medium: float


PRIMARY = Preset(4, 1.5, 3.5, 2.5, 1.5)
CONTRACT = Preset(5, 2.5, 4.0, 3.0, 2.0)


def detect(events: DataFrame, preset: Preset = PRIMARY, threshold: float | None = None, scope: tuple[str, ...] = ("entity",), metric: str | None = None) -> DataFrame:
    """Numeric events with |z| at or beyond the threshold: all their columns, mean, stddev, z_score, deviation_pct and severity."""
    limit = preset.threshold if threshold is None else threshold
    values = numeric(events)
    if metric is not None:
        values = values.filter(F.col("type") == metric.lower())
    by = [*scope, "type"]
    base = values.groupBy(*by).agg(F.avg("value_num").alias("mean"), F.stddev_pop("value_num").alias("stddev"), F.count("*").alias("samples"))
    base = base.filter((F.col("samples") >= preset.least_samples) & (F.col("stddev") >= FLAT)).drop("samples")
    z = (F.col("value_num") - F.col("mean")) / F.col("stddev")
    size = F.abs("z_score")
    severity = F.when(size >= preset.critical, "CRITICAL").when(size >= preset.high, "HIGH").when(size >= preset.medium, "MEDIUM").otherwise("LOW")
    deviation = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide(F.col("value_num") - F.col("mean"), F.col("mean")) * 100)
    return values.join(base, by).withColumn("z_score", z).filter(size >= limit).withColumn("deviation_pct", deviation).withColumn("severity", severity)


def evidence_rows(anomalies: DataFrame, events: DataFrame, scope: tuple[str, ...] = ("entity",), most: int = 5) -> DataFrame:
    """(anomaly_id, rank, event_id, distance, text): the nearest other events of each anomaly.

    A banded join: the anomaly is filed under its own and the two neighbouring bins of
    NEARBY_SECONDS, so the join is on equality and local to the bin. Of the events of one
    second only the first `most` + 1 can be among an anomaly's nearest (it may be one of them
    itself), so a busy second is thinned to these, before the shuffle where Spark can.
    """
    bin_ = F.floor(F.col("timestamp") / NEARBY_SECONDS)
    left = anomalies.select(*scope, F.col("event_id").alias("anomaly_id"), F.col("timestamp").alias("at"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bin_ + d)).alias("bin"))
    shown = F.concat(F.col("type"), F.lit(" (seq "), F.col("sequence_num").cast("string"), F.lit(", val="), F.coalesce("value_str", F.lit("None")), F.lit(")"))
    second = Window.partitionBy(*scope, "timestamp").orderBy("sequence_num", "event_id")
    thin = events.select(*scope, "event_id", "timestamp", "type", "sequence_num", "value_str").withColumn("place", F.row_number().over(second)).filter(F.col("place") <= most + 1)
    right = thin.select(*scope, "event_id", "timestamp", "sequence_num", shown.alias("text"), bin_.alias("bin"))
    near = left.join(right, [*scope, "bin"]).withColumn("distance", F.abs(F.col("timestamp") - F.col("at"))).filter((F.col("distance") <= NEARBY_SECONDS) & (F.col("event_id") != F.col("anomaly_id")))
    w = Window.partitionBy(*scope, "anomaly_id").orderBy("distance", "timestamp", "sequence_num", "event_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(*scope, "anomaly_id", "rank", "event_id", "distance", "text")


def with_evidence(anomalies: DataFrame, events: DataFrame, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Anomalies with `evidence`, texts from the nearest on, and an `assessment` in words."""
    rows = evidence_rows(anomalies, events, scope).groupBy(*scope, F.col("anomaly_id").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("e"))
    out = anomalies.join(rows.select(*scope, "event_id", F.transform("e", lambda x: x["text"]).alias("evidence")), [*scope, "event_id"], "left")
    words = F.concat(F.lit("Significant "), "type", F.lit(" deviation (+"), F.format_string("%.1f", "deviation_pct"), F.lit("%), z="), F.format_string("%.2f", "z_score"))
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>"))).withColumn("assessment", words)
