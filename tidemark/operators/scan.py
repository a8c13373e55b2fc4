"""Scan, residual filters, ordering and listings over the event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from ..model import ORDER

TEXT_FIELDS = {"event_id", "entity", "type"}
NUMBER_FIELDS = {"timestamp", "sequence_num"}
#: Mixed values sort by kind first.
_KIND_RANK = {"bool": 1, "number": 1, "string": 2}


def scan(events: DataFrame, entity: str | None = None, types: Iterable[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Conjunction of exact matches and inclusive bounds; every one reaches the Parquet scan."""
    if entity is not None:
        events = events.filter(F.col("entity") == entity)
    if types is not None:
        types = [t.lower() for t in types]
        events = events.filter(F.col("type") == types[0] if len(types) == 1 else F.col("type").isin(types))
    if start is not None:
        events = events.filter(F.col("timestamp") >= start)
    if end is not None:
        events = events.filter(F.col("timestamp") <= end)
    return events


def _compare(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def _holds(op: str, literal: float | str, present: Column, number: Column, text: Column) -> Column:
    """A missing field fails everything; kinds that differ are unequal and have no order."""
    own = text if isinstance(literal, str) else number
    if op == "!=":
        return present & ~F.coalesce(own == F.lit(literal), F.lit(False))
    return F.coalesce(_compare(op, own, F.lit(literal)), F.lit(False))


def predicate(field: str, op: str, literal: float | str) -> Column:
    """`field op literal` over an envelope column, or else over a top-level attribute."""
    none = F.lit(None)
    if field in TEXT_FIELDS:
        if isinstance(literal, str) and op != "!=":
            return _compare(op, F.col(field), F.lit(literal))
        return _holds(op, literal, F.col(field).isNotNull(), none.cast("double"), F.col(field))
    if field in NUMBER_FIELDS:
        if not isinstance(literal, str) and op != "!=":
            return _compare(op, F.col(field), F.lit(literal))
        return _holds(op, literal, F.col(field).isNotNull(), F.col(field), none.cast("string"))
    if field == "value":
        if not isinstance(literal, str) and op != "!=":
            return _compare(op, F.col("value_num"), F.lit(literal))
        return _holds(op, literal, F.col("value_kind") != "null", F.col("value_num"), F.when(F.col("value_kind") == "string", F.col("value_str")))
    if field == "attributes":
        return F.col("attributes").isNotNull() if op == "!=" else F.lit(False)
    # the text is parsed once: what follows reads the field's own small JSON
    written = variants.written(F.try_parse_json("attributes"), field)
    return F.exists(F.array(written), lambda j: _holds(op, literal, F.coalesce(j != "null", F.lit(False)), variants.number(j), variants.text(j)))


def ordering(field: str = "timestamp", descending: bool = False) -> list[Column]:
    """Sort columns for ORDER BY; ties follow the total order. Ascending puts null values first, descending last."""
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if field == "value":
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KIND_RANK.items() for x in kv]), F.col("value_kind")), F.lit(0))
        return [rank.desc() if descending else rank.asc(), turn("value_num"), turn("value_str"), *[F.col(c) for c in ORDER]]
    if field not in TEXT_FIELDS | NUMBER_FIELDS:
        raise ValueError(f"cannot order by {field!r}")
    return [turn(field), *[F.col(c) for c in ORDER if c != field]]


def project(events: DataFrame) -> DataFrame:
    """The columns of a FIND result. `value` is the printed form; `value_num` its number."""
    return events.select("timestamp", "entity", "type", F.col("value_str").alias("value"), "value_num", "event_id")


def timeline(events: DataFrame, entity: str | None = None, limit: int = 200) -> DataFrame:
    """The latest events first, each with `total`, the number before the limit."""
    found = scan(events, entity)
    latest = found.orderBy(F.desc("timestamp"), F.desc("sequence_num"), F.desc("event_id")).limit(limit)
    return latest.withColumn("total", found.agg(F.count("*")).scalar()).orderBy(F.desc("timestamp"), F.desc("sequence_num"), F.desc("event_id"))


def dedup_by_id(events: DataFrame, first: Column | None = None) -> DataFrame:
    """One row per event_id: the least by `first`, else by time, number and a hash of the row. Pre-aggregated, so a hot id gathers nowhere."""
    others = [c for c in events.columns if c != "event_id"]
    order = F.struct("timestamp", "sequence_num", F.xxhash64(*others)) if first is None else first
    return events.groupBy("event_id").agg(F.min_by(F.struct(*others), order).alias("row")).select("event_id", *[F.col(f"row.{c}").alias(c) for c in others]).select(*events.columns)
