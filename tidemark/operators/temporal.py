"""Tumbling windows, state at a point in time, and differences between two points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import order_key

_VALUE = ("value_kind", "value_num", "value_str")
UNITS = {"minute": 60, "hour": 3600, "day": 86400}


def buckets(events: DataFrame, width: int = 3600, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, window_start, window_end, event_count, mean, min, max): every window from the first event of the scope to its last.

    Windows are anchored at the scope's earliest event, not at the epoch. Empty windows and
    windows without a number show zeros.
    """
    if width <= 0:
        raise ValueError("width is positive")
    on = [*scope] or ["__all"]
    rows = events if scope else events.withColumn("__all", F.lit(0))
    ends = rows.groupBy(*on).agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    slot = F.floor((F.col("timestamp") - F.col("t0")) / width)
    counted = rows.join(ends, on).groupBy(*on, slot.alias("slot")).agg(F.count("*").alias("event_count"), F.avg("value_num").alias("mean"), F.min("value_num").alias("min"), F.max("value_num").alias("max"))
    every = ends.select(*on, "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / width))).alias("slot"))
    out = every.join(counted, [*on, "slot"], "left")
    start = F.col("t0") + F.col("slot") * width
    return out.select(*scope, start.alias("window_start"), (start + width).alias("window_end"), F.coalesce("event_count", F.lit(0)).alias("event_count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "min", "max")])


def _latest(until: Column | None = None) -> Column:
    """Aggregate: the value of the last event, of those with `until` true. A null value is a value."""
    order = order_key() if until is None else F.when(until, order_key())
    return F.max_by(F.struct(*_VALUE), order)


def state_as_of(events: DataFrame, at: int, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, type, value_kind, value_num, value_str, last_time): the last value of each type at or before `at`."""
    rows = events.filter(F.col("timestamp") <= at)
    got = rows.groupBy(*scope, "type").agg(_latest().alias("v"), F.max("timestamp").alias("last_time"))
    return got.select(*scope, "type", "v.*", "last_time")


def last_event_as_of(events: DataFrame, at: int, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, last_event_type, last_event_time)."""
    rows = events.filter(F.col("timestamp") <= at)
    return rows.groupBy(*scope).agg(F.max_by("type", order_key()).alias("last_event_type"), F.max("timestamp").alias("last_event_time"))


def difference(events: DataFrame, t1: int, t2: int, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """(scope, metric, value_t1, value_t2, absolute_diff, percent_diff) in one pass over the events.

    A metric without a value, or with a null one, shows null and counts as zero; text shows
    and counts as zero.
    """
    rows = events.filter(F.col("timestamp") <= max(t1, t2))
    got = rows.groupBy(*scope, F.col("type").alias("metric")).agg(_latest(F.col("timestamp") <= t1).alias("a"), _latest(F.col("timestamp") <= t2).alias("b"))
    shown = lambda s: F.when(F.col(s).isNull() | (F.col(f"{s}.value_kind") == "null"), None).otherwise(F.coalesce(F.col(f"{s}.value_num"), F.lit(0.0)))
    got = got.select(*scope, "metric", shown("a").alias("value_t1"), shown("b").alias("value_t2"))
    x, y = F.coalesce("value_t1", F.lit(0.0)), F.coalesce("value_t2", F.lit(0.0))
    return got.withColumn("absolute_diff", y - x).withColumn("percent_diff", F.when(x == 0, 0.0).otherwise(F.try_divide(y - x, x) * 100))


def intervening(events: DataFrame, metric: str, t1: int, t2: int) -> DataFrame:
    """Events of other types with t1 < timestamp <= t2, with their `text`."""
    rows = events.filter((F.col("timestamp") > t1) & (F.col("timestamp") <= t2) & (F.col("type") != metric.lower()))
    text = F.concat("type", F.lit(" (val="), F.coalesce("value_str", F.lit("None")), F.lit(" at t="), F.col("timestamp").cast("string"), F.lit(")"))
    return rows.select("entity", "timestamp", "sequence_num", "event_id", "type", text.alias("text"))


def rate_of_change(events: DataFrame, scope: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Each numeric event with its change per second since the metric's event before; null for the first and within one second."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*scope, "type").orderBy("timestamp", "sequence_num", "event_id")
    rows = events.filter(F.col("value_num").isNotNull())
    step = F.col("timestamp") - F.lag("timestamp").over(w)
    return rows.withColumn("rate", F.when(step > 0, (F.col("value_num") - F.lag("value_num").over(w)) / step))
