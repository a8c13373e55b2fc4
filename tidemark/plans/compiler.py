"""Plans to DataFrames, and the counts of a run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import statistics, temporal
from ..operators.scan import ordering, predicate, project, scan
from .language import Plan, parse


@dataclass(frozen=True)
class Telemetry:
    """scanned: rows after the pushed filters; returned: rows of the result; skipped: files that no filter of the scan leaves a row of."""

    scanned: int
    returned: int
    files: int
    skipped: int
    milliseconds: float


def _source(plan: Plan, events: DataFrame) -> DataFrame:
    bounds = (plan.start, plan.end) if plan.command in ("FIND", "ANALYZE") else (None, None)
    return scan(events, plan.entity, plan.targets or None, *bounds)


def compile_plan(plan: Plan, events: DataFrame) -> DataFrame:
    rows = _source(plan, events)
    for c in plan.conditions:
        rows = rows.filter(predicate(c.field, c.op, c.literal))
    if plan.command == "FIND":
        rows = rows.orderBy(*ordering(plan.order_by, plan.descending))
        return project(rows if plan.limit is None else rows.limit(plan.limit))
    if plan.command == "ANALYZE":
        if plan.group_by is None:
            return statistics.metric_summary(rows, ("type",))
        return temporal.buckets(rows, temporal.UNITS[plan.group_by], ("type",)).orderBy("type", "window_start")
    if plan.command == "DIFF":
        return temporal.difference(rows, plan.start, plan.end)
    return temporal.state_as_of(rows, plan.at)


def query(text: str, events: DataFrame) -> DataFrame:
    return compile_plan(parse(text), events)


def run(text: str, events: DataFrame) -> tuple[list, Telemetry]:
    """Collect a result with its telemetry.

    Rows scanned are counted on their own, over no column: a sort samples its input first,
    which would count an observed row twice.
    """
    began, plan = time.perf_counter(), parse(text)
    rows = compile_plan(plan, events).collect()
    took = (time.perf_counter() - began) * 1000
    source, files = _source(plan, events), len(events.inputFiles())
    if files:
        seen = source.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    else:
        seen = (source.count(), 0)
    return rows, Telemetry(seen[0], len(rows), files, files - seen[1], took)


def _plain(printed: str | None, number: float | None):
    """A stored value in its own kind."""
    if number is None:
        return printed
    if printed in ("True", "False"):
        return printed == "True"
    return int(number) if printed is not None and printed.lstrip("-").isdigit() else number


def to_result(text: str, events: DataFrame) -> dict:
    """A query's answer as plain data for JSON: columns, rows and metadata. FIND gives the value in its own kind."""
    rows, seen = run(text, events)
    columns = compile_plan(parse(text), events).columns
    data = [r.asDict(recursive=True) for r in rows]
    if parse(text).command == "FIND":
        data = [r | {"value": _plain(r["value"], r["value_num"])} for r in data]
        columns = [c for c in columns if c != "value_num"]
    metadata = {"scanned_rows": seen.scanned, "returned_rows": seen.returned, "segments_touched": seen.files - seen.skipped, "index_hits": seen.skipped, "execution_time_ms": round(seen.milliseconds, 3)}
    return {"columns": columns, "rows": [[r[c] for c in columns] for r in data], "metadata": metadata}
