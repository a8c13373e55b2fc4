"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has B byte positions. Two fingerprints that differ in at most d bits differ in
at most d bytes, so they share at least B - d positional bytes: the guaranteed minimum of
the count filter. Posting lists of a single positional byte would each hold 1/256 of the
corpus, so the index files fingerprints under tuples of four positional bytes; the tuples
cover every set of positions that the guarantee leaves intact. Partners that meet under any
tuple are tallied over all positions, pairs short of the minimum are dropped, the rest
verified bit by bit.

Equal fingerprints are one node from the start. A posting list beyond `long_list` is not
paired off: its members are filed by the rest of the fingerprint with at most one bit
flipped, and two members differ in at most two bits exactly when they share such a key, so
linking each to the smallest of the key is exact and linear.

Null text counts as empty; an empty text has the zero fingerprint and links like any other.
A very long text is hashed whole, its bits counted in stretches. Rows that repeat id or text
each have their own result; ties cannot arise, as a component is named by its smallest
doc_id. An empty table gives no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mix64, scratch_table, whole_text
from .components import components

_UPPER = bytes(range(65, 91))
_AZ = bytes.maketrans(_UPPER, _UPPER.lower())


def lower_words(text: str) -> list[bytes]:
    """The words in UTF-8, A-Z in lower case. On bytes, split() cuts at just \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").translate(_AZ).split()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; all words as one if there are fewer than `width`."""
    raw = b" ".join(lower_words(text))
    if not raw:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    if len(gaps) + 1 <= width:
        return np.array([xxhash.xxh64_intdigest(raw, 42)], np.uint64)
    begins = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(raw)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], 42) for a, b in zip(begins, ends[width - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str, width: int = 3, words64: int = 1) -> bytes:
    """The fingerprint as 8 * words64 bytes; further 64-bit words come from remixed shingle hashes."""
    hashes = shingle_hashes(text, width)
    return b"".join(majority(hashes if k == 0 else mix64(hashes, k)).to_bytes(8, "big") for k in range(words64))


def add_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, words64: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns with `fp`, the fingerprint as bytes."""
    kept = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], whole_text(text).alias("__whole"))
    names = [n for n in kept.columns if n != "__whole"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = [fingerprint(t, width, words64) for t in part.column("__whole").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(fps, pa.binary())], names=[*names, "fp"])

    return kept.mapInArrow(run, kept.drop("__whole").schema.add("fp", "binary"))


def lane_tuples() -> list[tuple[int, ...]]:
    """Four-byte tuples of an eight-byte fingerprint that leave out any two bytes: pairs of two-byte lanes."""
    lanes = [(0, 1), (2, 3), (4, 5), (6, 7)]
    return [x + y for x, y in itertools.combinations(lanes, 2)]


def _key(fp: str, positions: tuple[int, ...]) -> Column:
    """The positional bytes of a tuple in one binary value."""
    return F.concat(*[F.substring(F.col(fp), p + 1, 1) for p in positions])


def _postings(nodes: DataFrame, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(t, key, fp): each fingerprint under each tuple."""
    entries = F.array(*[F.struct(F.lit(i).alias("t"), _key("fp", p).alias("key")) for i, p in enumerate(tuples)])
    return nodes.select("fp", F.explode(entries).alias("e")).select("e.t", "e.key", "fp")


def shared_bytes(a: str, b: str, size: int) -> Column:
    """How many positional bytes two fingerprints share."""
    return sum((F.substring(F.col(a), i + 1, 1) == F.substring(F.col(b), i + 1, 1)).cast("int") for i in range(size))


def _word(c: str) -> Column:
    """An eight-byte fingerprint as a long."""
    return F.conv(F.hex(F.col(c)), 16, -10).cast("long")


def links_within_two_bits(nodes: DataFrame, long_list: int = 64) -> DataFrame:
    """(a, b): pairs of distinct eight-byte fingerprints, enough to connect all that differ in at most two bits. A scratch table.

    Every pair found in a list of up to `long_list` members is there; of longer lists, the stars of their one-flip keys.
    """
    tuples = lane_tuples()
    postings = scratch_table(_postings(nodes, tuples), "postings")
    sizes = scratch_table(postings.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
    member = scratch_table(postings.join(sizes, ["t", "key"]), "members")
    forget(postings, sizes)
    short = member.filter(F.col("n") <= long_list)
    left, right = short.select("t", "key", F.col("fp").alias("a")), short.select("t", "key", F.col("fp").alias("b"))
    # a pair met under one tuple, three or all six of them: two, three or four whole lanes; the tally goes on over all positions
    tally = left.join(right, ["t", "key"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("tuples"))
    pairs = tally.filter(F.when(F.col("tuples") >= 6, 8).otherwise(shared_bytes("a", "b", 8)) >= 6).select("a", "b")
    pairs = pairs.filter(F.bit_count(_word("a").bitwiseXOR(_word("b"))) <= 2)

    long = member.filter(F.col("n") > long_list).withColumn("w", _word("fp"))
    masks = [[0] + [1 << (8 * (7 - p) + b) for p in range(8) if p not in t for b in range(8)] for t in tuples]
    signed = [[m - (1 << 64) if m >> 63 else m for m in row] for row in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in signed]), F.col("t") + 1)
    balls = long.select("t", "fp", F.explode(F.transform(flips, lambda m: F.col("w").bitwiseXOR(m))).alias("ball"))
    balls = scratch_table(balls, "balls")
    first = scratch_table(balls.groupBy("t", "ball").agg(F.min("fp").alias("a"), F.count("*").alias("m")).filter("m > 1").drop("m"), "stars")
    stars = balls.join(first, ["t", "ball"]).select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    out = scratch_table(pairs.unionByName(stars), "near")
    forget(member, balls, first)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, long_list: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at two differing bits or fewer; the component is its smallest doc_id.

    Documents with a null doc_id belong to their component without naming it; it is null if all are null.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch_table(add_fingerprints(rows, width=width, keep=["doc_id"]), "fingerprints")
    nodes = scratch_table(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = links_within_two_bits(nodes, long_list)
    linked = components(links)
    # (fp, component as a fingerprint) -> the smallest doc_id of the component
    named = linked.join(nodes, linked["node"] == nodes["fp"]).groupBy("component").agg(F.min("low").alias("component_id"))
    named = scratch_table(named, "named")
    of_fp = linked.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    table = scratch_table(nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "classes")
    forget(nodes, links, linked, named)
    return marked.join(table, "fp").select("doc_id", "fp", "component_id")
