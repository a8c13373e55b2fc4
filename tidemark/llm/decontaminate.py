"""Benchmark decontamination by greedy string tiling.

A document and a test item are candidates when they share a seed, a run of `min_match`
tokens; the item tokens that shared seeds can cover bound the coverage from above and drop
most chance meetings. For the rest, running Karp-Rabin greedy string tiling (Wise, 1993)
repeatedly marks the longest matches between unmarked tokens until none of `min_match` is
left; reordered passages are therefore still covered. An item counts as leaked when tiles
cover at least `threshold` of its tokens. An item of fewer than `min_match` tokens is its own
seed: it is leaked where its tokens stand in a row.

A benchmark of up to `block_tokens` tokens is broadcast, and documents do not move. A larger one stays a
table: a sieve of its seeds (of bounded size; a fuller one only lets more pass) picks the
documents that may hold a seed, and their seeds are joined with the items'. Both ways give the same.

Tokens are lower-cased runs of letters and digits, so case, punctuation and line breaks do
not hide a leak; in scripts that write no spaces each character is one. Null and empty texts and items have no tokens and never match. An empty
benchmark leaves every document clean. Repeated rows and ids and repeated items are each
judged on their own; of two tiles of one length the one first in the item, then first in the text, goes first. A very long text is
read whole; an empty table gives no rows. Extra columns may be kept; one named `leaks` gives way to the result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, packed, scratch_table, unpacked, whole_text, window_codes, worker_state

# Scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
TOKEN = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
HIT = "struct<item_id:long,coverage:double,n_tiles:int,longest:int>"
_HIT = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())])
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


# ---- greedy string tiling -------------------------------------------------------------


def _windows(seq: list[int], marked: list[bool], size: int):
    """(start, Karp-Rabin hash) of every window of `size` unmarked tokens."""
    top = pow(_BASE, size - 1, _PRIME)
    value = run = 0
    for i, x in enumerate(seq):
        if marked[i] or x < 0:
            value = run = 0
            continue
        if run == size:
            value = (value - (seq[i - size] + 1) * top) % _PRIME
            run -= 1
        value = (value * _BASE + x + 1) % _PRIME
        run += 1
        if run == size:
            yield i - size + 1, value


def _matches(pattern, p_marked, text, t_marked, size) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, pattern start, text start) of at least `size`, found through windows of that size."""
    at = defaultdict(list)
    for p, h in _windows(pattern, p_marked, size):
        at[h].append(p)
    found, reached = [], {}
    for t, h in _windows(text, t_marked, size):
        for p in at.get(h, ()):
            if reached.get(p - t, -1) > t:  # inside a run already extended on this diagonal
                continue
            n = 0
            while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] >= 0 and not p_marked[p + n] and not t_marked[t + n]:
                n += 1
            if n >= size:
                found.append((n, p, t))
                reached[p - t] = t + n - size + 1
    return found


def tile(pattern: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, pattern start, text start). Negative tokens never match.

    Sizes go down from the whole pattern by halves, so at each of them no match of twice the size is left.
    """
    p_marked, t_marked = [False] * len(pattern), [False] * len(text)
    tiles, size, left = [], max(min_match, len(pattern)), len(pattern)
    while left >= min_match:
        found = sorted(_matches(pattern, p_marked, text, t_marked, size), key=lambda m: (-m[0], m[1], m[2]))
        for n, p, t in found:
            if not any(p_marked[p : p + n]) and not any(t_marked[t : t + n]):
                tiles.append((n, p, t))
                p_marked[p : p + n] = t_marked[t : t + n] = [True] * n
                left -= n
        # what the taken tiles cut short is found again at this size before going down
        if found:
            continue
        if size == min_match:
            break
        size = max(min_match, size // 2)
    return tiles


def window(seq: np.ndarray, under: list[tuple[np.ndarray, int]]) -> list[int]:
    """The tokens that stand under seeds, given as places and widths, a gap of -1 between separate stretches: no tile can lie elsewhere."""
    cover = np.zeros(len(seq) + 1, np.int64)
    for at, width in under:
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
    keep = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    out, last = [], None
    for i, x in zip(keep.tolist(), seq[keep].tolist()):
        if last is not None and i != last + 1:
            out.append(-1)
        out.append(x)
        last = i
    return out


def judge(item_id: int | None, pattern: list[int], text: list[int], min_match: int, threshold: float) -> dict | None:
    tiles = tile(pattern, text, min(min_match, len(pattern)))
    coverage = sum(n for n, _, _ in tiles) / len(pattern)
    if coverage < (threshold if len(pattern) >= min_match else 1):
        return None
    return {"item_id": item_id, "coverage": coverage, "n_tiles": len(tiles), "longest": max(n for n, _, _ in tiles)}


class _TokenCodes(dict):
    """Numbers of tokens below 2^63, remembered up to MEMORY tokens."""

    def __missing__(self, token: str) -> int:
        self[token] = h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1
        return h


MEMORY = 400_000


def coded(text: str | None, codes: dict) -> np.ndarray:
    if len(codes) > MEMORY:
        codes.clear()
    found = tokens(text)
    return np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))


def seeds(seq: np.ndarray, min_match: int) -> np.ndarray:
    """The seeds of an item: its runs of `min_match` tokens, or the whole of a shorter one."""
    return window_codes(seq, min(min_match, len(seq))) if len(seq) else np.zeros(0, np.uint64)


class Sieve:
    """Which seeds can be an item's: a bit for some of each code's bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def passes(self, codes: np.ndarray) -> np.ndarray:
        """The places of codes that pass."""
        at = (codes & self.mask).astype(np.int64)
        return np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def sieve_of(places: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little")


def sieve_size(n: int, most_bytes: int = 32 << 20) -> int:
    """Bits: sixteen a seed at least, up to `most_bytes`."""
    return min(most_bytes * 8, max(1 << 16, 1 << (16 * max(n, 1) - 1).bit_length()))


# ---- a small benchmark, broadcast ------------------------------------------------------


class Block:
    """Items with their seeds: sorted seed codes, and for each code its (item, place) postings."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], min_match: int):
        self.min_match = min_match
        self.ids = [i for i, _ in items]
        self.items = [seq.tolist() for _, seq in items]
        self.widths = sorted({min(min_match, len(seq)) for _, seq in items})
        got = [seeds(seq, min_match) for _, seq in items]
        code = np.concatenate(got) if got else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(got)), list(map(len, got)))
        place = np.concatenate([np.arange(len(g)) for g in got]) if got else np.zeros(0, np.int64)
        by = np.argsort(code, kind="stable")
        self.codes, starts = np.unique(code[by], return_index=True)
        self.starts = np.append(starts, len(by)).astype(np.int64)
        self.item, self.place = item[by].astype(np.int64), place[by].astype(np.int64)
        size = sieve_size(len(self.codes))
        self.sieve = Sieve(sieve_of((self.codes & np.uint64(size - 1)).astype(np.int64), size))

    def hits(self, seq: np.ndarray, threshold: float) -> list[dict]:
        under, places = [], defaultdict(set)
        for width in self.widths:
            codes = window_codes(seq, width)
            at = self.sieve.passes(codes)
            if not len(at):
                continue
            near = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            ok = self.codes[near] == codes[at]
            under.append((at[ok], width))
            for c in np.unique(near[ok]).tolist():
                for j in range(self.starts[c], self.starts[c + 1]):
                    places[int(self.item[j])].add(int(self.place[j]))
        found, text = [], None
        for item in sorted(places):
            pattern = self.items[item]
            if reach(places[item], pattern, self.min_match) < threshold * len(pattern):
                continue
            if text is None:
                text = window(seq, under)
            if hit := judge(self.ids[item], pattern, text, self.min_match, threshold):
                found.append(hit)
        return found


def reach(places, pattern, min_match: int) -> int:
    """How many tokens of an item its shared seeds can cover."""
    return len({p + i for p in places for i in range(min(min_match, len(pattern)))})


def _against(block, threshold: float):
    def run(batches):
        codes = worker_state("leak tokens", _TokenCodes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [block.value.hits(coded(t, codes), threshold) for t in part.column("__whole").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array(found, pa.list_(_HIT))], names=["__row", "leaks"])

    return run


# ---- a benchmark of any size, joined ---------------------------------------------------


def _items(min_match: int):
    def run(batches):
        codes = worker_state("leak tokens", _TokenCodes)
        for batch in batches:
            got = [coded(t, codes) for t in batch.column("text").to_pylist()]
            codes_ = [seeds(seq, min_match).view(np.int64) for seq in got]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(g) for g in got], pa.int64()), pa.array([g.view(np.int64) for g in got], pa.list_(pa.int64())), pa.array(codes_, pa.list_(pa.int64()))], names=["item_id", "size", "tokens", "seeds"])

    return run


def _holding(sieve, widths: list[int]):
    """Texts that may hold a seed: the codes that pass the sieve, and the tokens under them."""

    def run(batches):
        codes = worker_state("leak tokens", _TokenCodes)
        for batch in batches:
            out = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                seq, under, held = coded(text, codes), [], []
                for width in widths:
                    found = window_codes(seq, width)
                    if len(at := sieve.value.passes(found)):
                        under.append((at, width))
                        held.append(found[at])
                if held:
                    out.append((k1, k2, np.unique(np.concatenate(held)).view(np.int64), np.array(window(seq, under), np.int64)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["k1", "k2", "held", "window"])

    return run


def _judged(min_match: int, threshold: float):
    def run(batches):
        for batch in batches:
            keys, hits = [], []
            for r in batch.to_pylist():
                if reach(r["places"], r["tokens"], min_match) >= threshold * r["size"] and (hit := judge(r["item_id"], r["tokens"], r["window"], min_match, threshold)):
                    keys.append((r["k1"], r["k2"]))
                    hits.append(hit)
            if hits:
                k1, k2 = zip(*keys)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hits, _HIT)], names=["k1", "k2", "hit"])

    return run


def _joined(docs: DataFrame, items: DataFrame, text: str, min_match: int, threshold: float, sieve_bytes: int) -> DataFrame:
    """(k1, k2, leaks) of the texts that hold leaks, named by two hashes. A scratch table."""
    spark = docs.sparkSession
    postings = scratch_table(items.select("item", "size", F.posexplode("seeds").alias("place", "code")), "postings")
    widths = [r[0] for r in items.select(F.least("size", F.lit(min_match)).alias("w")).distinct().orderBy("w").collect()]
    size = sieve_size(postings.count(), sieve_bytes)
    places = postings.select(F.col("code").bitwiseAND(F.lit(size - 1)).alias("at")).distinct()
    bits = np.zeros(size // 8, np.uint8)
    for got in _stretches(places, size):
        bits |= got
    sieve = spark.sparkContext.broadcast(Sieve(bits))  # at most sieve_bytes
    whole = whole_text(text)
    keyed = docs.select(*_text_keys(text), whole.alias("text"))
    held = keyed.mapInArrow(_holding(sieve, widths), "k1 long, k2 long, held array<long>, window array<long>")
    held = scratch_table(held.groupBy("k1", "k2").agg(F.first("held").alias("held"), F.first("window").alias("window")), "held")
    met = held.select("k1", "k2", F.explode("held").alias("code")).join(postings, "code")
    met = met.groupBy("k1", "k2", "item", "size").agg(F.collect_set("place").alias("places")).filter(F.size("places") * min_match >= threshold * F.col("size"))
    met = scratch_table(met, "met")
    full = met.join(items.select("item", "item_id", "tokens"), "item").join(held.select("k1", "k2", "window"), ["k1", "k2"])
    hits = full.select("k1", "k2", "item_id", "size", "places", "tokens", "window").mapInArrow(_judged(min_match, threshold), f"k1 long, k2 long, hit {HIT}")
    out = scratch_table(hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("hit")).alias("leaks")), "leaks")
    forget(postings, held, met)
    return out


def _stretches(places: DataFrame, size: int):
    """The sieve's bits, a partition at a time."""

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    for r in places.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        yield np.frombuffer(r["bits"], np.uint8)


def _text_keys(text: str) -> list:
    whole = whole_text(text)
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.length(whole), whole).alias("k2")]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 4, threshold: float = 0.5, block_tokens: int = 2_000_000, sieve_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all by default) with `leaks`, an array of (item_id, coverage, n_tiles, longest) by item_id, empty for clean rows."""
    if not 0 < threshold <= 1 or min_match < 1:
        raise ValueError("threshold lies in (0, 1] and min_match is positive")
    spark = docs.sparkSession
    source = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = source.mapInArrow(_items(min_match), "item_id long, size long, tokens array<long>, seeds array<long>").filter("size > 0")
    items = scratch_table(items.withColumn("item", F.monotonically_increasing_id()), "items")
    if (items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) > block_tokens:
        leaks = _joined(docs, items, text, min_match, threshold, sieve_bytes)
        rows = docs.select(packed(docs, keep, "leaks"), *_text_keys(text)).join(leaks, ["k1", "k2"], "left")
        forget(items)
        return unpacked(rows.withColumn("leaks", F.coalesce("leaks", F.from_json(F.lit("[]"), f"array<{HIT}>"))), "leaks")
    all_items = items.select("item_id", "tokens").orderBy("item_id", "tokens").collect()  # at most block_tokens tokens
    forget(items)
    block = spark.sparkContext.broadcast(Block([(r["item_id"], np.array(r["tokens"], np.int64).view(np.uint64)) for r in all_items], min_match))
    rows = docs.select(packed(docs, keep, "leaks"), F.col(text).cast("string").alias("__whole"))
    schema = rows.select("__row").withColumn("leaks", F.from_json(F.lit("[]"), f"array<{HIT}>")).schema
    return unpacked(rows.mapInArrow(_against(block, threshold), schema), "leaks")
