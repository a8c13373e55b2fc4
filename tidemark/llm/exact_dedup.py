"""Exact de-duplication with two passes over Bloom filters.

Pass one notes for every row's hash which bits of a filter it sets, and merges what the partitions
note, segment by segment, into the bits that two rows or more have set. Pass two probes these: a row with a
clear bit is the only one of its text and passes straight through, without a shuffle; only
the rest are grouped by their SHA-256, so a false positive costs a shuffled row and never a
wrong answer.

The filter grows with the rows, at `bits_per_row`. All bits of a hash lie in one segment. A filter of up to
`broadcast_bytes` is broadcast; a larger one stays where it is, and hashes (eight bytes a row,
those that repeat within a partition left out) go to their segments. The result is the same.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space. Null
text counts as empty. Of equal texts the smallest doc_id stays (null ids sort last). Rows
that repeat both text and doc_id count as copies as well: exactly one row of a group stays.
A very long text is hashed whole. An empty table gives no rows. Extra columns come back as they were from
`deduplicate`, whatever their names; `classify` does not read them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, forget, forget_state, mix64, scratch_table, whole_text

PROBES = 4
#: Hashes that are noted together.
CHUNK = 1 << 17


def text_sha256(text: str = "text") -> Column:
    return F.sha2(F.regexp_replace(whole_text(text), SPACES, " ").cast("binary"), 256)


def sha_key(sha: str = "sha") -> Column:
    """64 bits of a digest, made in the JVM."""
    return F.xxhash64(sha)


def filter_shape(rows: int, bits_per_row: int) -> tuple[int, int]:
    """Segments and bits of each: two thousand segments while they are of 64 KB to 16 MB."""
    bits = max(rows, 1) * bits_per_row
    segment_bits = 1 << min(27, max(19, (bits // 2000).bit_length()))
    return -(-bits // segment_bits), segment_bits


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _bits(keys: np.ndarray, segment_bits: int) -> np.ndarray:
    """The bits of each key within its segment, a row for each probe."""
    return np.stack([mix64(keys, i) % np.uint64(segment_bits) for i in range(PROBES)]).astype(np.int64)


def _keys(batches, name: str = "key"):
    """The hashes of a partition, a chunk at a time."""
    forget_state()
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch.column(name).to_numpy().view(np.uint64))
        n += batch.num_rows
        if n >= CHUNK:
            yield np.concatenate(waiting)
            waiting, n = [], 0
    if n:
        yield np.concatenate(waiting)


def _notes(segments: int, segment_bits: int):
    """For each chunk and segment the bits that are set, and which of them by two rows or more."""

    def run(batches):
        for keys in _keys(batches):
            # a row may hit one bit with two probes; that is not a repetition
            at = np.sort(_segment(keys, segments) * segment_bits + _bits(keys, segment_bits), axis=0)
            own = np.ones(at.shape, dtype=bool)
            own[1:] = at[1:] != at[:-1]
            flat, n = np.unique(at[own], return_counts=True)
            segs, lows = np.unique(flat // segment_bits, return_index=True)
            highs = np.append(lows[1:], len(flat))
            bits = [(flat[a:b] - s * segment_bits).astype("<u4").tobytes() for s, a, b in zip(segs, lows, highs)]
            again = [np.packbits(n[a:b] > 1).tobytes() for a, b in zip(lows, highs)]
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(bits, pa.binary()), pa.array(again, pa.binary())], names=["seg", "bits", "again"])

    return run


def _merged(segment_bits: int, least: int = 2):
    """Streaming: the notes of a segment follow each other; the bits that `least` rows have set, one or two. Memory is one segment, twice."""

    def run(batches):
        seg = once = twice = None
        for batch in batches:
            for s, bits, again in zip(*(batch.column(c).to_pylist() for c in ("seg", "bits", "again"))):
                if s != seg:
                    if seg is not None:
                        yield _row(seg, twice if least == 2 else once)
                    seg, once, twice = s, np.zeros(segment_bits // 8, np.uint8), np.zeros(segment_bits // 8, np.uint8)
                at = np.frombuffer(bits, "<u4").astype(np.int64)
                byte, mask = at >> 3, (1 << (at & 7)).astype(np.uint8)
                more = np.unpackbits(np.frombuffer(again, np.uint8), count=len(at)).astype(bool) | ((once[byte] & mask) != 0)
                np.bitwise_or.at(twice, byte[more], mask[more])
                np.bitwise_or.at(once, byte, mask)
        if seg is not None:
            yield _row(seg, twice if least == 2 else once)

    return run


def _row(seg: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["seg", "bits"])


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column of bit numbers, whether all are set."""
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _probed(segments: int, segment_bits: int):
    """Streaming: a segment's bits, then the hashes that ask; the hashes that may be repeated."""

    def run(batches):
        seg = bits = None
        for batch in batches:
            out = []
            segs = batch.column("seg").to_numpy()
            cuts = np.flatnonzero(np.diff(segs, prepend=segs[0] - 1 if len(segs) else 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(segs))):
                part = batch.slice(a, b - a)
                if segs[a] != seg:
                    seg, bits = segs[a], None
                if (found := part.column("bits")[0].as_py()) is not None:
                    bits, part = np.frombuffer(found, np.uint8), part.slice(1)
                if bits is not None and part.num_rows:
                    keys = part.column("key").to_numpy().view(np.uint64)
                    out.append(keys[_set(bits, _bits(keys, segment_bits))].view(np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], names=["key"])

    return run


def _asking(segments: int):
    """The distinct hashes of each chunk with their segments."""

    def run(batches):
        for keys in _keys(batches):
            keys = np.unique(keys)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(keys, segments)), pa.array(keys.view(np.int64), pa.int64())], names=["seg", "key"])

    return run


class RepeatedFilter:
    """Tells which hashes may be repeated: exact for those it denies."""

    #: Rows that a hash must come from.
    LEAST = 2

    def __init__(self, rows: DataFrame, bits_per_row: int = 16, broadcast_bytes: int = 64 << 20):
        """Pass one, over the `key` of all rows."""
        segments, segment_bits = filter_shape(rows.count(), bits_per_row)
        self.keys = self.test = None
        large = segments * segment_bits // 8 > broadcast_bytes
        if large and self.LEAST == 1:
            self.keys = scratch_table(rows.select("key").distinct(), "listed")
            return
        notes = rows.select("key").mapInArrow(_notes(segments, segment_bits), "seg long, bits binary, again binary")
        dealt = notes.repartition(min(segments, 2000), "seg").sortWithinPartitions("seg")
        field = dealt.mapInArrow(_merged(segment_bits, self.LEAST), "seg long, bits binary")
        if large:
            field = scratch_table(field, "filter")
            asking = rows.select("key").mapInArrow(_asking(segments), "seg long, key long")
            both = asking.unionByName(field, allowMissingColumns=True).repartition(min(segments, 2000), "seg").sortWithinPartitions("seg", F.col("bits").isNull())
            self.keys = scratch_table(both.mapInArrow(_probed(segments, segment_bits), "key long").distinct(), "repeated")
            forget(field)
            return
        table = np.zeros((segments, segment_bits // 8), np.uint8)
        for r in field.toLocalIterator():  # at most broadcast_bytes in all
            table[r["seg"]] = np.frombuffer(r["bits"], np.uint8)
        shared = rows.sparkSession.sparkContext.broadcast(table.tobytes())

        def test(keys: np.ndarray) -> np.ndarray:
            return _set(np.frombuffer(shared.value, np.uint8), _segment(keys, segments) * segment_bits + _bits(keys, segment_bits))

        @F.pandas_udf("boolean")
        def maybe(key: pd.Series) -> pd.Series:
            return pd.Series(test(key.to_numpy().view(np.uint64)))

        #: For steps in Python: whether each of some unsigned hashes may be one; None where the filter is not broadcast.
        self.test, self.maybe = test, maybe

    def flag(self, rows: DataFrame) -> DataFrame:
        """Pass two: `maybe` for each row by its `key`."""
        if self.keys is None:
            return rows.withColumn("maybe", self.maybe("key"))
        return rows.join(self.keys.withColumn("__in", F.lit(True)), "key", "left").withColumn("maybe", F.col("__in").isNotNull()).drop("__in")


class MemberFilter(RepeatedFilter):
    """Tells which hashes may be among the `key` of the rows it was made of: exact for those it denies."""

    LEAST = 1


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_no, doc_id, sha, key), one row per input row, kept as a scratch table so that row_no is stable."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_sha256(text).alias("sha")).withColumn("key", sha_key())
    return scratch_table(rows.withColumn("row_no", F.monotonically_increasing_id()), "sha")


def _winners(repeated: DataFrame) -> DataFrame:
    """Per digest its size and its staying row, as a scratch table: the later join then deals both sides itself, and Spark may split a hot digest."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_no"))
    return scratch_table(repeated.groupBy("sha").agg(first.alias("w"), F.count("*").alias("group_size")).select("sha", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.row_no").alias("keep_row")), "groups")


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filter_options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = fingerprints(docs, doc_id, text)
    marked = scratch_table(RepeatedFilter(rows, **filter_options).flag(rows).drop("key"), "flagged")
    forget(rows)
    single = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    many = marked.filter("maybe").select("doc_id", "row_no", "sha")
    joined = many.join(_winners(many), "sha").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(joined)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **filter_options) -> DataFrame:
    """The input rows without later copies, all columns as they came.

    Rows whose digest is surely single never move. Of the others only those with the
    smallest id of their digest meet, pre-aggregated, to leave one of literally repeated rows.
    """
    sha = text_sha256(text).alias("sha")
    rows = scratch_table(docs.select(F.col(doc_id).alias("doc_id"), sha).withColumn("key", sha_key()), "sha")
    found = RepeatedFilter(rows, **filter_options)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id"))
    keep = scratch_table(found.flag(rows).filter("maybe").groupBy("sha").agg(order.alias("w")).select("sha", F.col("w.doc_id").alias("keep_id")), "groups")
    forget(rows)
    tagged = found.flag(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), sha).withColumn("key", sha_key()))
    single = tagged.filter(~F.col("maybe")).select("row")
    stay = tagged.filter("maybe").join(keep, "sha").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return single.unionByName(stay.groupBy("sha").agg(F.first("row").alias("row")).select("row")).select("row.*")
