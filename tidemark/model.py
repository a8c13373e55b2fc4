"""The event table: one fixed schema, and the order that breaks every tie.

A value is split when an event enters: `value_kind` is null, number, bool, string;
`value_num` holds numbers and booleans (true counts as 1), `value_str` the printed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("value_kind", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_str", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("sequence_num", T.LongType()),
    ]
)

#: Total order of events.
ORDER = ("timestamp", "sequence_num", "event_id")


def order_key(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ORDER])


def numeric(events: DataFrame) -> DataFrame:
    """Events whose value counts as a number."""
    return events.filter(F.col("value_num").isNotNull())


def from_clickstream(rows: DataFrame, entity: Column | None = None) -> DataFrame:
    """The driver's table (event_id, ts, user_id, event_type, value, props) as events."""
    value = F.col("value").cast("double")
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        (F.concat(F.lit("user-"), F.col("user_id").cast("string")) if entity is None else entity).alias("entity"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.lower(F.trim("event_type")).alias("type"),
        F.when(value.isNull(), "null").otherwise("number").alias("value_kind"),
        value.alias("value_num"),
        value.cast("string").alias("value_str"),
        F.coalesce(F.col("props"), F.lit("{}")).alias("attributes"),
        F.col("event_id").cast("long").alias("sequence_num"),
    )
