"""Command line over an event table: init, ingest, query, analyze, verify, flush, compact, stats, benchmark."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .model import EVENTS
from .operators import anomalies, correlation, statistics
from .plans.compiler import run
from .session import session
from .sources import jsonl
from .sources.table import EventTable


def bench_events(spark, rows: int = 10_000, entities: int = 10):
    """The synthetic shape: value 40 + i % 50 at second 10000 + i for server-(i % entities)."""
    i = F.col("id")
    return spark.range(rows).select(
        F.concat(F.lit("b"), i.cast("string")).alias("event_id"),
        F.concat(F.lit("server-"), (i % entities).cast("string")).alias("entity"),
        (i + 10_000).alias("timestamp"),
        F.lit("cpu").alias("type"),
        F.lit("number").alias("value_kind"),
        (F.lit(40.0) + i % 50).alias("value_num"),
        (F.lit(40.0) + i % 50).cast("string").alias("value_str"),
        F.lit("{}").alias("attributes"),
        (i + 1).alias("sequence_num"),
    )


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--dir", default="database")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "verify", "compact", "stats", "flush"):
        sub.add_parser(name)
    sub.add_parser("ingest").add_argument("file")
    sub.add_parser("query").add_argument("text")
    a = sub.add_parser("analyze")
    a.add_argument("entity")
    a.add_argument("--metric")
    sub.add_parser("benchmark")
    args = p.parse_args(argv)
    spark = session("tidemark-cli")
    table = EventTable(spark, args.dir)
    if args.command == "init":
        table.append(spark.createDataFrame([], EVENTS))
        print(f"ready: {args.dir}")
    elif args.command == "ingest":
        first = (table.events().agg(F.max("sequence_num")).first()[0] or 0) + 1
        checked = jsonl.ingest(jsonl.read_lines(spark, args.file), first).persist()
        table.append(jsonl.accepted(checked))
        print(json.dumps(jsonl.report(checked), indent=2))
    elif args.command == "query":
        rows, seen = run(args.text, table.events())
        for r in rows:
            print(*r, sep="\t")
        print(f"{seen.returned} rows, {seen.scanned} scanned, {seen.milliseconds:.0f} ms")
    elif args.command == "analyze":
        rows = table.scan(args.entity)
        found = anomalies.with_evidence(anomalies.detect(rows, metric=args.metric), rows)
        if args.metric:
            statistics.metric_summary(rows.filter(F.col("type") == args.metric.lower())).show(truncate=False)
            found.orderBy("timestamp").select("timestamp", "value_num", "z_score", "deviation_pct", "severity", "evidence").show(truncate=False)
        else:
            report = correlation.diagnostic_report(statistics.profile(rows, anomalies.detect(rows)), correlation.correlate(rows))
            for line in report.toJSON().toLocalIterator():
                print(json.dumps(json.loads(line), indent=2))
    elif args.command == "verify":
        bad = [r for r in table.verify().collect() if r.status != "HEALTHY"]
        print("DEGRADED" if bad else "HEALTHY", *bad, sep="\n")
        return int(bool(bad))
    elif args.command == "flush":
        print("appends are durable when they return; nothing is buffered")
    elif args.command == "compact":
        print(table.compact() or "nothing to compact")
    elif args.command == "stats":
        print(json.dumps(table.stats(), indent=2))
    elif args.command == "benchmark":
        began = time.perf_counter()
        table.append(bench_events(spark))
        wrote = time.perf_counter() - began
        rows, seen = run("FIND cpu FROM server-1 WHERE value > 80", table.events())
        print(f"10000 events in {wrote:.2f} s; {seen.scanned} scanned, {len(rows)} matched in {seen.milliseconds:.0f} ms")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
