"""Repeated line runs by distributed prefix doubling over line-id sequences.

Every line gets a global position, ascending by document and line. Doubling round k ranks
the suffixes that start at the positions by their first 2^k lines: the pairs of ranks of the round
before are sorted by ranges, and a pair's place is its rank, so ranks are the order of the suffix
array to that depth. Suffixes whose run occurs once leave; the others' ranks are enough. Two suffixes
have a longest common prefix of m lines or more exactly when they have
the same two ranks of depth 2^k, k = floor(log2 m), at their start and ending at the m-th line: the suffixes
with one such pair are an LCP interval of depth m.

A repeated run counts from `min_words` words. For each line the shortest runs of that size
that start and that end there are looked up; runs whose interval has an earlier member
are deleted. The union of those runs is exactly the maximal repeated runs of that size or
more, less their first copies.

Lines are compared without white space at their ends. A copy may overlap what it repeats: of "x x x" in
one document the run "x x" stands twice, and all but its first copy goes. Null text counts as empty and gives
an empty text; lines that only blank runs share have no words and stay. Rows that repeat
both doc_id and text are one document and get the same result; null ids come last; a very long text is a long
stretch of positions; an empty table gives no rows. Extra columns may be kept; columns named clean_text, n_lines or n_removed
give way to the results.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, scratch_table, unpacked, whole_text

RESULTS = ("clean_text", "n_lines", "n_removed")
BLANKS = " \t\n\v\f\r"


def _shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the length of the shortest run of `least` words that starts, and that ends, there; 0 if there is none."""
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least, side="left")
    ahead = np.where(stop <= len(words), stop - at, 0)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    behind = np.where(total[1:] >= least, at + 1 - start, 0)
    return ahead, behind


def _lines(min_words: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_id", "k1", "k2", "hashes", "ahead", "behind"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                hashes, ahead, behind = [], [], []
                for text in part.column("text").to_pylist():
                    lines = [x.strip(BLANKS) for x in text.split("\n")]
                    hashes.append([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
                    a, b = _shortest_runs(np.array([len(x.split()) for x in lines]), min_words)
                    ahead.append(a)
                    behind.append(b)
                data = [*[part.column(n) for n in ("doc_id", "k1", "k2")], hashes, ahead, behind]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) if not isinstance(d, pa.Array) else d for d, k in zip(data, kinds)], names=names)

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list:
    whole = whole_text(text)
    return [F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, whole).alias("k1"), F.xxhash64(whole, F.length(whole), doc_id).alias("k2")]


def positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(pos, k1, k2, i, left, h, ahead, behind): one row per line; consecutive lines of a document have consecutive positions."""
    rows = docs.select(*_keyed(docs, doc_id, text), whole_text(text).alias("text"))
    packed = rows.mapInArrow(_lines(min_words), "doc_id long, k1 long, k2 long, hashes array<binary>, ahead array<int>, behind array<int>")
    packed = packed.groupBy("doc_id", "k1", "k2").agg(*[F.first(c).alias(c) for c in ("hashes", "ahead", "behind")])
    order = [F.col("doc_id").asc_nulls_last(), "k1", "k2"]
    packed = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = packed.select("k1", "k2", F.size("hashes").alias("n"), F.posexplode(F.arrays_zip("hashes", "ahead", "behind")).alias("i", "x"))
    lines = lines.select(F.monotonically_increasing_id().alias("pos"), "k1", "k2", "i", (F.col("n") - F.col("i")).alias("left"), F.col("x.hashes").alias("h"), F.col("x.ahead").alias("ahead"), F.col("x.behind").alias("behind"))
    return scratch_table(lines, "lines")


def _ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Keep rows whose `by` columns occur twice or more, with `c`, the place of these among all in order, and `low`, the first position that has them."""
    names = rows.groupBy(*by).agg(F.min("pos").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    names = scratch_table(names, f"{name}-names")
    ranks = scratch_table(names.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("c", F.monotonically_increasing_id()), f"{name}-ranks")
    out = scratch_table(rows.join(ranks, by), name)
    forget(names, ranks)
    return out


def repeated_runs(lines: DataFrame) -> list[DataFrame]:
    """(k1, k2, i, m): the shortest runs of the wanted size that have an earlier copy, in a scratch table for each depth."""
    ahead = lines.filter("ahead > 0").select("pos", "k1", "k2", "i", F.col("ahead").alias("m"))
    behind = lines.filter("behind > 0").select((F.col("pos") - F.col("behind") + 1).alias("pos"), "k1", "k2", (F.col("i") - F.col("behind") + 1).alias("i"), F.col("behind").alias("m"))
    runs = ahead.unionByName(behind.filter("m > 1"))
    most = runs.agg(F.max("m")).first()[0] or 0
    classes, found, k = _ranked(lines.select("pos", "left", "h"), ["h"], "ranks-0"), [], 0
    while True:
        size = 1 << k
        here = runs.filter(F.col("m").between(size, 2 * size - 1))
        a = here.join(classes.select("pos", F.col("c").alias("c1")), "pos")
        a = a.withColumn("tail", F.col("pos") + F.col("m") - size)
        a = a.join(classes.select(F.col("pos").alias("tail"), F.col("c").alias("c2")), "tail").select("pos", "k1", "k2", "i", "m", "c1", "c2")
        a = scratch_table(a, f"runs-{k}")
        first = scratch_table(a.groupBy("m", "c1", "c2").agg(F.min("pos").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n"), f"intervals-{k}")
        found.append(scratch_table(a.join(first, ["m", "c1", "c2"]).filter("pos > low").select("k1", "k2", "i", "m"), f"later-{k}"))
        forget(a, first)
        if 2 * size > most:
            break
        left = classes.filter(F.col("left") >= 2 * size).select("pos", "left", F.col("c").alias("c1"), (F.col("pos") + size).alias("next"))
        pairs = scratch_table(left.join(classes.select(F.col("pos").alias("next"), F.col("c").alias("c2")), "next").select("pos", "left", "c1", "c2"), f"pairs-{k}")
        deeper = _ranked(pairs, ["c1", "c2"], f"ranks-{k + 1}")
        forget(classes, pairs)
        classes = deeper
        if classes.isEmpty():
            break
        k += 1
    forget(classes)
    return found


def _without(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts, lines, removed = [], [], []
            for text, cuts in zip(part.column("__whole").to_pylist(), part.column("cuts").to_pylist()):
                rows = text.split("\n")
                gone = np.zeros(len(rows) + 1, np.int64)
                for c in cuts or ():
                    gone[c["i"]] += 1
                    gone[c["i"] + c["m"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                texts.append("\n".join([r for r, g in zip(rows, gone) if not g]) if cuts else text)
                lines.append(len(rows))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=["__row", *RESULTS])


def remove_repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all by default) with clean_text, n_lines and n_removed."""
    lines = positions(docs, doc_id, text, min_words)
    found = repeated_runs(lines)
    cuts = scratch_table(functools.reduce(DataFrame.unionByName, found).groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "m")).alias("cuts")), "cuts")
    forget(lines, *found)
    rows = docs.select(packed(docs, keep, *RESULTS), *_keyed(docs, doc_id, text)[1:], whole_text(text).alias("__whole"))
    # the cuts grow with the corpus: one plan at every size, not a broadcast while they are few
    joined = rows.join(cuts.hint("merge"), ["k1", "k2"], "left").select("__row", "__whole", "cuts")
    schema = joined.drop("__whole", "cuts").schema.add("clean_text", "string").add("n_lines", "long").add("n_removed", "long")
    return unpacked(joined.mapInArrow(_without, schema), *RESULTS)
