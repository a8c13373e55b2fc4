"""Events from stored web pages: the measures of a page, and the fifteen events of a probe.

A stored page was fetched some time ago, so latencies and status are columns of the caller;
without them latency counts as 0 ms and the status as 200.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.identity import event_id


def describe(pages: DataFrame, *more: str) -> DataFrame:
    """(page_id, url, entity, scheme, title, description, heading, links, n_links, n_scripts, n_images, n_forms, size_kb, and `more`); null html counts as empty.

    `links` is a sample of five; `n_links` counts all.
    """
    page = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        "url",
        H.entity(F.coalesce("url", F.lit(""))).alias("entity"),
        H.scheme(F.coalesce("url", F.lit(""))).alias("scheme"),
        H.title(page).alias("title"),
        H.description(page).alias("description"),
        H.heading(page).alias("heading"),
        H.links(page).alias("links"),
        F.size(H.all_links(page)).alias("n_links"),
        H.count_tag(page, "script").alias("n_scripts"),
        H.count_tag(page, "img").alias("n_images"),
        H.count_tag(page, "form").alias("n_forms"),
        H.size_kb(page).alias("size_kb"),
        *more,
    )


def _one_decimal(c: Column) -> Column:
    return F.floor(c * 10 + 0.5) / 10


def probe_cpu(latency_ms: Column, scripts: Column, sample: Column | int = 0) -> Column:
    """The load figure that a probe derives from latency and scripts."""
    return _one_decimal(F.least(F.lit(100.0), F.greatest(F.lit(2.5), latency_ms / 12.0 + scripts * 1.5 + sample * 1.2)))


def probe_memory(size_kb: Column, sample: Column | int = 0) -> Column:
    return _one_decimal(F.least(F.lit(100.0), F.greatest(F.lit(15.0), size_kb / 4.0 + 32.0 + sample * 0.8)))


#: The attributes of a probe's events.
CPU_ATTRIBUTES, MEMORY_ATTRIBUTES = '{"load_factor":"DOM_PARSING","phase":"TIME"}', '{"footprint":"V8_HEAP","phase":"SOUL"}'
SAMPLES, STEP_SECONDS = 4, 15


def page_events(pages: DataFrame, timestamp: Column, latency_ms: Column | None = None, status: Column | None = None) -> DataFrame:
    """The events of one probe of each page: four samples of latency, cpu and memory, then size_kb, status_code and errors.

    `latency_ms` is one number, spread over the samples as a probe does that could not measure again, or an
    array of four. The sequence number counts through the events in order of page_id.
    """
    first = F.lit(0.0) if latency_ms is None else latency_ms
    probed = pages.withColumn("__latency", first).withColumn("__status", F.lit(200) if status is None else status)
    spread = F.round(F.col("__latency") * (0.9 + 0.2 * F.col("sample")), 2) if dict(probed.dtypes)["__latency"] != "array<double>" else F.get("__latency", F.col("sample").cast("int"))
    d = describe(probed, "__latency", "__status").withColumn("__at", timestamp.cast("long")).withColumn("__url", F.coalesce("url", F.lit("")))
    samples = d.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("ms", spread.cast("double"))
    then = F.col("__at") - STEP_SECONDS * (SAMPLES - 1 - F.col("sample"))
    bad = F.col("__status") >= 400

    def event(place: Column, at: Column, kind: str, value: Column, attributes: Column) -> Column:
        return F.struct(place.cast("long").alias("place"), at.alias("at"), F.lit(kind).alias("type"), value.cast("double").alias("v"), attributes.alias("a"))

    i = F.col("sample")
    trend = F.array(
        event(i * 3, then, "latency", F.col("ms"), F.to_json(F.struct(F.lit("POWER").alias("phase"), "sample", F.col("__status").alias("status"), F.col("__url").alias("url")))),
        event(i * 3 + 1, then + 1, "cpu", probe_cpu(F.col("ms"), F.col("n_scripts"), i), F.lit(CPU_ATTRIBUTES)),
        event(i * 3 + 2, then + 2, "memory", probe_memory(F.col("size_kb"), i), F.lit(MEMORY_ATTRIBUTES)),
    )
    n = F.lit(3 * SAMPLES)
    snapshot = F.array(
        event(n, F.col("__at") + 1, "size_kb", F.col("size_kb"), F.to_json(F.struct(F.col("n_images").alias("images"), F.col("n_links").alias("links"), F.lit("SPACE").alias("phase"), F.col("n_scripts").alias("scripts")))),
        event(n + 1, F.col("__at") + 2, "status_code", F.col("__status"), F.to_json(F.struct(F.lit("REALITY").alias("phase"), "title"))),
        event(n + 2, F.col("__at") + 3, "errors", F.when(bad, 1.0).otherwise(0.0), F.to_json(F.struct(F.when(bad, "HTTP_ERROR").otherwise("NONE").alias("error_type"), F.lit("MIND").alias("phase")))),
    )
    rows = samples.select("page_id", "entity", F.explode(trend).alias("m")).unionByName(d.select("page_id", "entity", F.explode(snapshot).alias("m")))
    sequence = (F.col("page_id").cast("long") - 1) * (3 * SAMPLES + 3) + F.col("m.place") + 1
    return rows.select(
        event_id(sequence, F.col("entity"), F.col("m.at"), F.col("m.type"), F.col("m.v").cast("string"), F.col("m.a")).alias("event_id"),
        "entity",
        F.col("m.at").alias("timestamp"),
        F.col("m.type").alias("type"),
        F.lit("number").alias("value_kind"),
        F.col("m.v").alias("value_num"),
        F.col("m.v").cast("string").alias("value_str"),
        F.col("m.a").alias("attributes"),
        sequence.alias("sequence_num"),
    )
