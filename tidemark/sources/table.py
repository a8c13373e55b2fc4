"""The stored event table: Parquet segments under a folder, with an audit of what was written.

Layout: `v<N>/` holds the segments of version N, `audit/` one row per written file (rows, a
checksum, its time), and an empty file `CURRENT-<N>` says that version N is complete; the highest
counts. Appends go through Spark's commit protocol. Compaction writes the next version and
then adds its pointer, never taking one away first, so a reader sees the old table or the new, and
a crash leaves the old one. What was appended meanwhile is carried over before the pointer
is set. `vacuum` removes versions that were left behind. Pruning is left to Parquet footers and the
Bloom filters on entity; `candidates` reports what they would leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENTS
from ..operators.scan import dedup_by_id, scan

#: Rows per file before a writer starts another.
MAX_ROWS = 5_000_000


def row_checksum() -> Column:
    """An order-free checksum of rows: the exclusive or of their hashes."""
    return F.bit_xor(F.xxhash64(*EVENTS.fieldNames()))


class EventTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- versions

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _versions(self) -> list[int]:
        """The versions that have a pointer, ascending."""
        found = self._fs.globStatus(self._path(f"{self.path}/CURRENT-*"))
        return sorted(int(f.getPath().getName().rpartition("-")[2]) for f in found or ())

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _point_to(self, version: int) -> None:
        """One new empty file: there is no moment without a pointer."""
        self._fs.create(self._path(f"{self.path}/CURRENT-{version}"), True).close()

    def _data(self, version: int | None = None) -> str:
        return f"{self.path}/v{self.version() if version is None else version}"

    # ---- reading and writing

    def events(self) -> DataFrame:
        """All stored events; a bag until compaction."""
        name = f"v{self.version()}"
        if not self._exists(name):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/{name}")

    def scan(self, entity: str | None = None, types=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return scan(self.events(), entity, types, start, end)

    def _write(self, events: DataFrame, version: int, mode: str) -> None:
        ordered = events.select(*EVENTS.fieldNames()).sortWithinPartitions("entity", "timestamp", "sequence_num")
        writer = ordered.write.mode(mode).option("parquet.bloom.filter.enabled#entity", "true").option("maxRecordsPerFile", MAX_ROWS)
        writer.parquet(self._data(version))
        self._audit(version)

    def append(self, events: DataFrame) -> None:
        self._write(events, self.version(), "append")

    def _files(self, version: int, since: object = None) -> DataFrame:
        """(file, modified, n_rows, checksum) as the files are now; `since` leaves older files unread."""
        rows = self.spark.read.schema(EVENTS).parquet(self._data(version)).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
        if since is not None:
            rows = rows.filter(F.col("modified") >= F.lit(since))
        return rows.groupBy("file").agg(F.max("modified").alias("modified"), F.count("*").alias("n_rows"), row_checksum().alias("checksum"))

    def _known(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/audit").filter(F.col("version") == version)

    def _audit(self, version: int) -> None:
        """Record the files that have no record yet. Files older than the last record are not read again."""
        if not self._exists("audit"):
            now = self._files(version)
        else:
            known = self._known(version)
            now = self._files(version, known.agg(F.max("modified")).first()[0]).join(known.select("file"), "file", "left_anti")
        now.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(f"{self.path}/audit")

    # ---- upkeep

    def compact(self, order: Column | None = None) -> int | None:
        """Merge two or more files into the next version without repeated event_ids; returns it, or None below two files.

        Of repeated ids the row of the file written first stays, then the least by time and number.
        """
        version = self.version()
        if not self._exists(f"v{version}") or len(before := self.events().inputFiles()) < 2:
            return None
        # the folder of a compaction that crashed is not written again, so the audit's rows stay true
        folders = self._fs.globStatus(self._path(f"{self.path}/v*")) or ()
        target = 1 + max(int(f.getPath().getName()[1:]) for f in folders)
        rows = self.spark.read.schema(EVENTS).parquet(*before).select("*", F.col("_metadata.file_modification_time").alias("__at"))
        order = F.struct("__at", "timestamp", "sequence_num", F.xxhash64(*EVENTS.fieldNames())) if order is None else order
        self._write(dedup_by_id(rows, order).drop("__at").repartitionByRange("entity", "timestamp"), target, "overwrite")
        if late := sorted(set(self.events().inputFiles()) - set(before)):
            self._write(self.spark.read.schema(EVENTS).parquet(*late), target, "append")
        self._point_to(target)
        return target

    def vacuum(self) -> list[int]:
        """Remove all versions but the current one, pointers last; returns them. For when nobody reads or compacts."""
        now = self.version()
        folders = self._fs.globStatus(self._path(f"{self.path}/v*")) or ()
        old = sorted({int(f.getPath().getName()[1:]) for f in folders} - {now})
        for v in old:
            self._fs.delete(self._path(f"{self.path}/v{v}"), True)
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.path}/CURRENT-{v}"), False)
        return old

    def verify(self) -> DataFrame:
        """(file, expected_rows, n_rows, status): HEALTHY, DEGRADED (rows differ from the record), MISSING or UNKNOWN."""
        version = self.version()
        now = self._files(version)
        known = self._known(version).select("file", F.col("n_rows").alias("expected_rows"), F.col("checksum").alias("expected"))
        both = known.join(now, "file", "full_outer")
        status = (
            F.when(F.col("expected").isNull() & F.col("expected_rows").isNull(), "UNKNOWN")
            .when(F.col("n_rows").isNull(), "MISSING")
            .when((F.col("n_rows") == F.col("expected_rows")) & F.col("checksum").eqNullSafe(F.col("expected")), "HEALTHY")
            .otherwise("DEGRADED")
        )
        return both.select("file", "expected_rows", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))

    def segments(self) -> DataFrame:
        """Zone map: per file its rows, bounds of time and sequence, entities and types."""
        rows = self.events().select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return segment_bounds(rows, "file").join(rows.groupBy("file").agg(F.max("bytes").alias("bytes")), "file")

    def candidates(self, entity: str | None = None, types=None, start: int | None = None, end: int | None = None) -> DataFrame:
        return prune(self.segments(), entity, types, start, end).select("file")

    def stats(self) -> dict:
        r = self.segments().agg(F.count("*").alias("segments"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("events"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        return r.asDict() | {"version": self.version()}


def segment_bounds(rows: DataFrame, by: str) -> DataFrame:
    """Zone map of any grouping of events into segments."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.min("timestamp").alias("min_ts"),
        F.max("timestamp").alias("max_ts"),
        F.min("sequence_num").alias("min_seq"),
        F.max("sequence_num").alias("max_seq"),
        F.collect_set("entity").alias("entities"),
        F.collect_set("type").alias("types"),
    )


def prune(bounds: DataFrame, entity: str | None = None, types=None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Segments that can hold a match."""
    if entity is not None:
        bounds = bounds.filter(F.array_contains("entities", entity))
    if types is not None:
        bounds = bounds.filter(F.arrays_overlap("types", F.array(*[F.lit(t.lower()) for t in types])))
    if start is not None:
        bounds = bounds.filter(F.col("max_ts") >= start)
    if end is not None:
        bounds = bounds.filter(F.col("min_ts") <= end)
    return bounds
