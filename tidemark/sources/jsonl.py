"""JSON-lines ingest: parse, validate, number and identify events; nothing leaves the JVM.

A line is skipped when blank or a comment. The first failing check names the error, in the
order entity, timestamp, type, value, attributes. Lines that parse as JSON take a sequence
number, whether or not they are valid; lines that do not parse take none.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import variants
from ..functions.identity import canonical_json, event_id
from ..functions.timestamps import parse_text
from ..model import EVENTS

FIELDS = ("entity", "timestamp", "type", "value", "attributes", "event_id")
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw): lines of all files counted through from 0, files in the order of their names.

    Spark deals splits by size, so a line's own id says where it stands in its split only;
    the splits (a row each) are put in order by file and start.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("raw"))
    splits = lines.groupBy("__file", "__start").agg(F.min("__id").alias("__low"), F.count("*").alias("n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("__file", "__start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    return keep_payload(lines.join(splits, ["__file", "__start"]).select((F.col("__id") + F.col("__shift")).alias("line_no"), "raw"))


def keep_payload(lines: DataFrame) -> DataFrame:
    raw = strip(F.col("raw"))
    return lines.filter((raw != "") & ~raw.startswith("#")).withColumn("raw", raw)


def validate(lines: DataFrame, sequence: Column) -> DataFrame:
    """The event columns and `error` (null for a valid event), `parsed`, next to the lines' own columns."""
    rows = lines.withColumn("__f", variants.fields(F.try_parse_json("raw"), FIELDS)).withColumn("__ok", F.col("raw").startswith("{"))
    j = lambda n: F.col(f"__f.{n}")
    k = lambda n: variants.kind(j(n))
    # true and false pass as 1 and 0; numbers lose their fraction; text follows the rules of its own
    at = F.when(k("timestamp") == "string", parse_text(variants.text(j("timestamp")))).otherwise(variants.whole(j("timestamp")))
    fresh = [strip(variants.text(j("entity"))).alias("__entity"), F.lower(strip(variants.text(j("type")))).alias("__type"), at.alias("__at"), variants.printed(F.col("raw"), "value", j("value")).alias("__printed")]
    # a filter on `error` must not be pushed below these: it would parse the line anew for every field it names.
    # Nothing passes a column that depends on the partition, and the error names it.
    held = F.spark_partition_id().alias("__held")
    rows = rows.select("*", *fresh, F.when(k("attributes") == "object", j("attributes")).otherwise("{}").alias("__attributes"), held)
    entity, type_, printed, attributes = (F.col(f"__{n}") for n in ("entity", "type", "printed", "attributes"))
    error = (
        F.when(~F.col("__f.parsed") | (F.col("__held") < 0), "invalid JSON")
        .when(~F.col("__ok"), "event is not a JSON object")
        .when(F.coalesce(entity, F.lit("")) == "", "missing or empty field: entity")
        .when(k("timestamp").isin("absent", "null"), "missing field: timestamp")
        .when(F.col("__at").isNull(), "invalid timestamp")
        .when(F.col("__at") < 0, "negative timestamp")
        .when(F.coalesce(type_, F.lit("")) == "", "missing or empty field: type")
        .when(k("value").isin("list", "object"), "value is not a number, text or boolean")
        .when(~k("attributes").isin("absent", "object"), "attributes is not an object")
    )
    given = F.nullif(F.coalesce(variants.text(j("event_id")), F.when(k("event_id") == "number", j("event_id"))), F.lit(""))
    seq = sequence.cast("long")
    return rows.select(
        *lines.columns,
        error.alias("error"),
        F.col("__f.parsed").alias("parsed"),
        F.coalesce(given, event_id(seq, entity, F.col("__at"), type_, printed, attributes)).alias("event_id"),
        entity.alias("entity"),
        F.col("__at").alias("timestamp"),
        type_.alias("type"),
        F.when(k("value") == "absent", "null").otherwise(k("value")).alias("value_kind"),
        variants.number(j("value")).alias("value_num"),
        printed.alias("value_str"),
        attributes.alias("attributes"),
        seq.alias("sequence_num"),
    )


#: Lines that are numbered together: a task of `numbered` holds so many.
STRETCH = 1 << 20


def numbered(lines: DataFrame, first: int = 1) -> DataFrame:
    """Lines with `seq`, dense over the lines that parse, in the order of line_no.

    Lines are counted per stretch of line numbers and numbered within it by the stretches before, so no
    window gathers the input; the counts are a table, joined like any other.
    """
    parsed = lines.withColumn("__ok", F.try_parse_json("raw").isNotNull()).withColumn("__part", F.floor(F.col("line_no") / STRETCH))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parsed.filter("__ok").groupBy("__part").agg(F.count("*").alias("n"))
    base = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parsed.join(base, "__part", "left").withColumn("seq", F.when(F.col("__ok"), F.col("__base") + first - 1 + F.sum(F.col("__ok").cast("long")).over(within)))
    return out.select(*lines.columns, "seq")


def ingest(lines: DataFrame, first: int = 1) -> DataFrame:
    """Validated lines with sequence numbers; see `accepted`, `rejected` and `report`."""
    return validate(numbered(lines, first), F.col("seq")).drop("seq")


def ingest_rows(spark: SparkSession, rows: Iterable[dict | str], first: int = 1) -> DataFrame:
    """The same for Python rows: dictionaries, or JSON texts."""
    texts = [(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)]
    return ingest(keep_payload(spark.createDataFrame(texts, "line_no long, raw string")), first)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("error IS NULL").select(*EVENTS.fieldNames())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("error IS NOT NULL").select("line_no", "error", F.left(F.col("raw"), F.lit(100)).alias("payload"))


def report(checked: DataFrame, most: int = 50) -> dict:
    """total, accepted, rejected, and the first `most` errors with payloads cut to 100 characters."""
    n = checked.agg(F.count("*").alias("total"), F.count("error").alias("rejected")).first()
    errors = [r.asDict() for r in rejected(checked).orderBy("line_no").limit(most).collect()]
    return {"total": n["total"], "accepted": n["total"] - n["rejected"], "rejected": n["rejected"], "errors": errors}


def to_json_lines(events: DataFrame) -> DataFrame:
    """One compact JSON text per event, keys sorted, the value in its own kind."""
    value = (
        F.when(F.col("value_kind") == "null", "null")
        .when(F.col("value_kind") == "bool", F.lower("value_str"))
        .when(F.col("value_kind") == "string", F.to_json(F.array("value_str")).substr(F.lit(2), F.length(F.to_json(F.array("value_str"))) - 2))
        .otherwise(F.col("value_str"))
    )
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    parts = [
        F.lit('{"attributes":'), canonical_json(F.col("attributes")), F.lit(',"entity":'), quoted("entity"), F.lit(',"event_id":'), quoted("event_id"),
        F.lit(',"sequence_num":'), F.col("sequence_num").cast("string"), F.lit(',"timestamp":'), F.col("timestamp").cast("string"),
        F.lit(',"type":'), quoted("type"), F.lit(',"value":'), value, F.lit("}"),
    ]
    return events.select(F.concat(*parts).alias("value"))
