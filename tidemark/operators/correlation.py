"""Correlation of metrics over nearest-in-time pairs.

A series has one value per second, the last written. Each second of the first metric takes
the nearest second of the other within TOLERANCE, the earlier-seen one of a tie; a second
of the other may serve many times. The nearest partner is found by an equality join on time
bins as wide as the tolerance, so no series passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import numeric, order_key

TOLERANCE = 120
LEAST_PAIRS = 3


def pearson(x: str = "x", y: str = "y") -> Column:
    """Aggregate: 0 for fewer than three pairs or a constant side, else within [-1, 1]."""
    n = F.count("*")
    spread = n * F.stddev_pop(x) * F.stddev_pop(y)
    r = F.try_divide(F.covar_pop(x, y) * n, spread)
    return F.when((n < LEAST_PAIRS) | (spread < 1e-9), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def label(r: str = "correlation") -> Column:
    c = F.col(r)
    return (
        F.when(c >= 0.7, "STRONG_POSITIVE")
        .when(c >= 0.3, "MODERATE_POSITIVE")
        .when(c <= -0.7, "STRONG_NEGATIVE")
        .when(c <= -0.3, "MODERATE_NEGATIVE")
        .otherwise("NEGLIGIBLE")
    )


def series(events: DataFrame, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, type, ts, v, seen): the last value of each second, and when the second was first seen."""
    return numeric(events).groupBy(*scope, "type", F.col("timestamp").alias("ts")).agg(F.max_by("value_num", order_key()).alias("v"), F.min(F.struct("sequence_num", "event_id")).alias("seen"))


def correlate(events: DataFrame, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, metric_a, metric_b, samples, correlation, relationship) for pairs of metrics in first-seen order with at least three matches."""
    points = series(events, scope)
    metrics = numeric(events).groupBy(*scope, "type").agg(F.min(F.struct("sequence_num", "timestamp", "event_id")).alias("first"))
    a, b = metrics.select(*scope, F.col("type").alias("metric_a"), F.col("first").alias("fa")), metrics.select(*scope, F.col("type").alias("metric_b"), F.col("first").alias("fb"))
    # without a scope the few metrics meet under a constant
    on = [*scope] or ["__all"]
    if not scope:
        a, b, points = (d.withColumn("__all", F.lit(0)) for d in (a, b, points))
    pairs = a.join(b, on).filter((F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("metric_a") < F.col("metric_b")))).select(*on, "metric_a", "metric_b")
    bin_ = F.floor(F.col("ts") / TOLERANCE)
    left = points.select(*on, F.col("type").alias("metric_a"), F.col("ts").alias("ta"), F.col("v").alias("x"))
    left = left.join(pairs, [*on, "metric_a"]).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("ta") / TOLERANCE) + d)))
    right = points.select(*on, F.col("type").alias("metric_b"), F.col("ts").alias("tb"), F.col("v").alias("y"), "seen", bin_.alias("bin"))
    near = left.join(right, [*on, "metric_b", "bin"]).withColumn("d", F.abs(F.col("ta") - F.col("tb"))).filter(F.col("d") <= TOLERANCE)
    best = near.groupBy(*on, "metric_a", "metric_b", "ta").agg(F.first("x").alias("x"), F.min_by("y", F.struct("d", "seen")).alias("y"))
    found = best.groupBy(*on, "metric_a", "metric_b").agg(F.count("*").alias("samples"), pearson().alias("correlation")).filter(F.col("samples") >= LEAST_PAIRS)
    return found.withColumn("relationship", label()).select(*scope, "metric_a", "metric_b", "samples", "correlation", "relationship")


def diagnostic_report(profiles: DataFrame, correlations: DataFrame) -> DataFrame:
    """Profiles with `correlations`, an array ordered by metric names, rounded to three decimals."""
    rows = correlations.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("metric_a", "metric_b", "samples", F.round("correlation", 3).alias("correlation"), "relationship"))).alias("correlations"))
    return profiles.join(rows, "entity", "left")
