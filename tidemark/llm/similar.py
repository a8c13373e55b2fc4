"""Groups of documents whose sets of word shingles have a Jaccard similarity of `similarity` or more.

SimHash fingerprints say little at a similarity of 0.8: there some ten of 64 bits differ, so
no number of shared bytes is guaranteed. They find the closest copies; what they cannot
promise is made up by the same idea on the shingles themselves, where the minimum is
guaranteed, so that no pair is passed over:

1. Count filter on documents. Under one order of all shingles (their hashes) two sets that
   share t shingles have k in common among the first n - t + k of each. A document goes on
   when so many of these occur in another document too. Most documents end here, and only
   three tenths of their hashes were ever moved.
2. Fingerprints of the others are linked through the byte-position index (`simhash`); each link is
   verified on the sets.
3. The rest of the pairs meet in an inverted index of the shingles that are rarest among
   these documents (prefix filter), pass the size and positional filters, and are verified.

Lists of up to `long_list` members are paired off. In longer ones members are first held
against a few leaders, more in each round, which joins what is alike; then all pairs that are still in different groups are
compared, behind a lower bound of their difference from 2048-bit maps of their shingles. Limit and leaders set the
way, never the result.

Null text counts as empty; documents without words are one group. Rows that repeat doc_id and text
leave one. Of a group the smallest doc_id stays, null ids last; ties of doc_id fall to a hash
of the text. An empty table gives no rows. A very long text is one set in one task. Extra columns come back as they were,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from .common import forget, scratch_table, whole_text, window_codes, worker_state
from .components import components
from .exact_dedup import MemberFilter
from .simhash import links_within_two_bits, lower_words, majority

MEMORY = 100_000
#: Longs of a document's map of shingles.
MAP_LONGS = 32
#: Of a document's shingles this share is asked to occur elsewhere.
ASKED = 0.1


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to MEMORY words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_set(text: str, width: int, hashes: dict) -> np.ndarray:
    """The distinct 64-bit codes of the word shingles, ascending; all words as one if there are fewer than `width`."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.int64)
    if len(hashes) > MEMORY:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(window_codes(h, min(width, len(h))).view(np.int64))


def least_shared(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles a set of each size shares with any set that similar."""
    return np.ceil(similarity * sizes - 1e-9).astype(np.int64)


def _asked(sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of a set's first shingles to look at, and how many of them must occur in another set.

    A set asks for k = max(1, ASKED * size) among its first size - t + k. A partner that is smaller, by the
    similarity at most, asks for fewer; the smaller k is what both must have.
    """
    t = least_shared(sizes, similarity)
    k = np.maximum(1, np.floor(ASKED * sizes).astype(np.int64))
    smaller = np.maximum(1, np.floor(ASKED * t).astype(np.int64))
    return np.minimum(sizes, sizes - t + k), np.where(sizes > 0, np.minimum(k, smaller), 0)


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _firsts(width: int, similarity: float):
    def run(batches):
        hashes = worker_state("shingle words", _WordHashes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, width, hashes) for t in part.column("__whole").to_pylist()]
                n, k = _asked(np.array(list(map(len, sets)), np.int64), similarity)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(k, pa.int64()), _list_column([s[:m] for s, m in zip(sets, n)])], names=["k1", "k2", "k", "firsts"])

    return run


def _sets(width: int, going=None):
    """The sets of the rows whose k1 passes `going`."""

    def run(batches):
        hashes = worker_state("shingle words", _WordHashes)
        for batch in batches:
            if going:
                batch = batch.filter(pa.array(going(batch.column("k1").to_numpy().view(np.uint64)), pa.bool_()))
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t, width, hashes) for t in part.column("__whole").to_pylist()]
                fps = [majority(s.view(np.uint64)).to_bytes(8, "big") for s in sets]
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                maps = [_map(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), _list_column(maps), _list_column(sets)], names=["doc_id", "k1", "k2", "name", "size", "fp", "map", "keys"])

    return run


def _map(keys: np.ndarray) -> np.ndarray:
    """The bits that the codes fall on."""
    bits = np.zeros(64 * MAP_LONGS, bool)
    bits[(keys.view(np.uint64) % np.uint64(64 * MAP_LONGS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row by doc_id and text."""
    whole = whole_text(text)
    return [F.xxhash64(doc_id, whole).alias("k1"), F.xxhash64(whole, F.length(whole), doc_id).alias("k2")]


def with_partners(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Step 1: (k1, k2) of the rows that may have a partner: those whose first shingles occur elsewhere often enough. A scratch table."""
    marked = rows.select("k1", "k2", "__whole").mapInArrow(_firsts(width, similarity), "k1 long, k2 long, k long, firsts array<long>")
    marked = scratch_table(marked.withColumn("node", F.monotonically_increasing_id()), "firsts")
    repeated = marked.select(F.explode("firsts").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    repeated = scratch_table(repeated, "repeated")
    met = marked.select("node", "k", F.explode("firsts").alias("h")).join(repeated, "h")
    met = scratch_table(met.groupBy("node").agg(F.count("*").alias("c"), F.first("k").alias("k")).filter("c >= k").select("node"), "met")
    # documents without a shingle are all alike
    out = marked.filter("k = 0").select("k1", "k2").unionByName(marked.join(met, "node").select("k1", "k2")).distinct()
    out = scratch_table(out, "partners")
    forget(marked, repeated, met)
    return out


def _fits(similarity: float) -> str:
    """Size and positional filter: true of the first shingle that two sets of that similarity share."""
    return f"1 + least(na - 1 - pa, nb - 1 - pb) >= {similarity / (1 + similarity)!r}D * (na + nb) - 1e-6D"


def _apart(similarity: float) -> str:
    """Each bit in which two maps differ stands for a shingle that only one set has; similar sets have few of these."""
    bits = " + ".join(f"bit_count(ma[{i}] ^ mb[{i}])" for i in range(MAP_LONGS))
    return f"{bits} <= {(1 - similarity) / (1 + similarity)!r}D * (na + nb) + 1e-6D"


def _similar(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            a, b = batch.column("sa"), batch.column("sb")
            for x, y in zip(a, b):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                union = len(both) - same
                keep.append(not union or same >= least * union - 1e-9)
            yield batch.select(["a", "b", "ga", "gb"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Groups:
    """Nodes and the groups known so far; a group bears the name of its smallest node."""

    def __init__(self, nodes: DataFrame, similarity: float):
        self.nodes, self.similarity = nodes, similarity
        self.table = scratch_table(nodes.select("node", F.col("node").alias("g")), "groups")

    def link(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) of different groups (ga, gb) and join the groups of those that are similar."""
        pairs = scratch_table(pairs.select("a", "b", "ga", "gb").distinct(), "pairs")
        sets = self.nodes.select("node", "keys")
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("keys").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("keys").alias("sb")), "b")
        links = scratch_table(full.select("a", "b", "ga", "gb", "sa", "sb").mapInArrow(_similar(self.similarity), "a long, b long, ga long, gb long"), "links")
        if not links.isEmpty():
            joined = components(links, "ga", "gb")
            now = scratch_table(self.table.join(joined.withColumnRenamed("node", "g"), "g", "left").select("node", F.coalesce("component", "g").alias("g")), "groups")
            forget(self.table, joined)
            self.table = now
        forget(pairs, links)

    def of(self, members: DataFrame) -> DataFrame:
        """`members` with their groups `g`."""
        return members.join(self.table, "node")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of one fingerprint with the smallest of them, and the smallest of fingerprints within two bits."""
    fps = scratch_table(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    same = nodes.join(fps, "fp").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = links_within_two_bits(fps)
    a, b = fps.select(F.col("fp").alias("a"), F.col("low").alias("x")), fps.select(F.col("fp").alias("b"), F.col("low").alias("y"))
    near = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    out = scratch_table(same.unionByName(near), "near")
    forget(fps, links)
    return out


def _members(nodes: DataFrame, similarity: float) -> DataFrame:
    """Step 3's index: (key, node, n, p, m): shingle, its document, the set's size, the place in the set when rare shingles come first, the list's length."""
    said = nodes.select("node", "size", F.explode("keys").alias("h"))
    often = scratch_table(said.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    common = said.join(often, "h").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("common"))
    # what occurs nowhere else stands first; of the n - t + 1 first places these leave so many
    alone = F.col("size") - F.size("common")
    left = F.greatest(F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    first = common.select("node", F.col("size").alias("n"), alone.alias("alone"), F.slice("common", F.lit(1), left).alias("x"))
    postings = first.select("node", "n", "alone", F.posexplode("x").alias("i", "x")).select("node", "n", (F.col("alone") + F.col("i")).cast("long").alias("p"), F.col("x.h").alias("key"))
    postings = scratch_table(postings, "postings")
    lists = scratch_table(postings.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "lists")
    out = scratch_table(postings.join(lists, "key"), "members")
    forget(often, postings, lists)
    return out


def _side(of: DataFrame, x: str, *more: str) -> DataFrame:
    return of.select("key", *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "p", "g", *more)], F.col("node").alias(x))


def _leaders(members: DataFrame, turn: int, most: int) -> DataFrame:
    """Up to `most` members of each list. One order for all lists: lists that overlap share theirs, and few pairs are verified."""
    place = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    return members.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).drop("place")


def _join_groups(nodes: DataFrame, similarity: float, long_list: int, leaders: tuple[int, ...]) -> DataFrame:
    """(node, g): the group of each node."""
    groups = _Groups(nodes, similarity)
    near = _by_fingerprint(nodes)
    members = _members(nodes, similarity)
    fits = _fits(similarity)
    alone = members.withColumn("g", F.col("node"))
    short = alone.filter(F.col("m") <= long_list)
    met = _side(short, "a").join(_side(short, "b"), "key").filter(f"a < b AND {fits}")
    groups.link(met.select("a", "b", "ga", "gb").unionByName(near.select("a", "b", F.col("a").alias("ga"), F.col("b").alias("gb"))))
    forget(near)
    long = members.filter(F.col("m") > long_list).select("key", "node", "n", "p")
    for turn, most in enumerate((*leaders, None)):
        # a list all in one group is done
        now = scratch_table(groups.of(long), "long")
        open_ = scratch_table(now.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("key"), "open")
        if open_.isEmpty():
            forget(now, open_)
            break
        if most is not None:
            lead = scratch_table(_leaders(now.join(open_, "key"), turn, most), "leaders")
            groups.link(_side(lead, "a").join(_side(now, "b"), "key").filter(f"ga <> gb AND {fits}"))
            forget(lead)
        else:
            mapped = scratch_table(now.join(open_, "key").join(nodes.select("node", "map"), "node"), "mapped")
            groups.link(_side(mapped, "a", "map").join(_side(mapped, "b", "map"), "key").filter(f"a < b AND ga <> gb AND {fits} AND {_apart(similarity)}"))
            forget(mapped)
        forget(now, open_)
    forget(members)
    return groups.table


def _listed(keys: DataFrame, **filter_options) -> MemberFilter:
    """Tells the k1 of rows that may be among `keys`. Texts do not move while it can be broadcast."""
    return MemberFilter(keys.select(F.col("k1").alias("key")), **filter_options)


def _flag(found: MemberFilter, rows: DataFrame) -> DataFrame:
    return found.flag(rows.withColumn("key", F.col("k1"))).drop("key")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, long_list: int = 24, leaders: tuple[int, ...] = (1, 4, 16, 64), **filter_options) -> DataFrame:
    """(k1, k2, doc_id, n, keeper): the distinct rows (doc_id, text) that may have a partner, how often each came and whether it stays for its group.

    A scratch table. Groups are connected components; rows that are not listed are alone. A few rows without
    a partner are listed as well, as the filter lets them through; they are compared like the others.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), whole_text(text).alias("__whole"))
    partners = with_partners(rows, width, similarity)
    schema = rows.drop("__whole").schema.add("name", "binary").add("size", "long").add("fp", "binary").add("map", ArrayType(LongType())).add("keys", ArrayType(LongType()))
    found = _listed(partners, **filter_options)
    going = rows if found.test else _flag(found, rows).filter("maybe")
    whole = scratch_table(going.select("doc_id", "k1", "k2", "__whole").mapInArrow(_sets(width, found.test), schema), "sets")
    forget(partners)
    nodes = whole.groupBy("name").agg(*[F.first(c).alias(c) for c in ("size", "fp", "map", "keys")])
    nodes = scratch_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # from here on the nodes alone hold the sets
    marked = scratch_table(whole.select("doc_id", "k1", "k2", "name"), "marked")
    forget(whole)
    groups = _join_groups(nodes, similarity, long_list, leaders)
    named = scratch_table(nodes.select("name", "node").join(groups, "node").select("name", "g"), "named")
    placed = marked.select("doc_id", "k1", "k2", "name").join(named, "name").groupBy("doc_id", "k1", "k2", "g").agg(F.count("*").alias("n"))
    placed = scratch_table(placed, "placed")
    forget(marked, nodes, groups, named)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2")
    first = scratch_table(placed.groupBy("g").agg(F.min(order).alias("w")).select("g", F.col("w.k1").alias("w1"), F.col("w.k2").alias("w2")), "keepers")
    out = scratch_table(placed.join(first, "g").select("k1", "k2", "doc_id", "n", ((F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).alias("keeper")), "similar")
    forget(placed, first)
    return out


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input rows with one document of each group, all columns as they came. Rows that repeat both doc_id and text leave one."""
    placed = similar_groups(docs, doc_id, text, **options)
    leave = placed.filter("NOT keeper OR n > 1").select("k1", "k2")
    filter_options = {k: options[k] for k in ("bits_per_row", "broadcast_bytes") if k in options}
    rows = _flag(_listed(leave, **filter_options), docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *row_keys(doc_id, text)))
    # only rows that the filter lists are shuffled
    some = rows.filter("maybe")
    out = rows.filter("NOT maybe").select("row").unionByName(some.join(leave, ["k1", "k2"], "left_anti").select("row"))
    often = placed.filter("keeper AND n > 1").select("k1", "k2")
    if not often.isEmpty():
        out = out.unionByName(some.join(often, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
