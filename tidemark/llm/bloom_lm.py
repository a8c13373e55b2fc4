"""A smoothed bigram model whose counts live in a log-frequency Bloom filter.

Counts of tokens and of token pairs are quantised on a roughly logarithmic scale; an item of
level q enters a Bloom filter q times, as (item, 1) ... (item, q) (Talbot and Osborne, 2007).
A count is read back by probing levels upwards until one is missing, so errors are one-sided
and rarer the larger the count. The filter grows with the corpus at `bits_per_entry` bits for
each training token, and for each stored level at least, so false levels stay as rare at any
size. It is cut into segments by key; a task holds one segment at a time: it builds it from
the counts of all blocks of documents and answers the keys that the blocks ask for.

The probability of a token interpolates its bigram estimate, less a discount of DISCOUNT a pair, with an add-one
unigram estimate over what was read from the filter. Counts stand for the middle of their level, so probabilities
add up to about one, with the discount rather to less. The weight depends on the level of the history and is
fitted by expectation-maximisation over all training tokens, each scored as if its own
occurrence had not been counted.

Beside the model, the exact add-one unigram score is kept as a baseline. Its counts are
joined per block of documents (a stretch of a task's rows with at most `BLOCK_TOKENS`
tokens or `BLOCK_TYPES` distinct ones, or one longer document), so no vocabulary is ever
collected and a frequent token costs one row a block.

Null text counts as empty: one end token. Null ids count as the empty id in the split.
Rows are independent given the counts: ties and repeated rows need no care; extra columns are not read, whatever
their names; a very long text is a block of its own; an empty table gives no rows, and without training rows all
counts are zero.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, forget, mix64, release_memory, scratch_table, whole_text

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The end token. No word holds a space, so it is no word.
END = " "
BLOCK_TOKENS, BLOCK_TYPES = 2_000_000, 400_000
PROBES = 3
#: Taken off each pair's count: a pair seen once says less of its history than one seen twice.
DISCOUNT = 0.5


def levels(base: float = 1.4, most: int = 1 << 50) -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... then growing by `base`."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.int64)


LEVELS = levels()
#: The count that a level stands for.
MIDDLE = np.concatenate(([0.0], (LEVELS + np.append(LEVELS[1:] - 1, LEVELS[-1])) / 2))


def split_tokens(text: str) -> list[str]:
    low = text.translate(LOWER_AZ) if not text.isascii() else text.lower()
    return [*(WORD.findall(low) if ODD_SPACES.search(low) else low.split()), END]


def trains_on(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held


def token_hash(token: str) -> int:
    """Spark's xxhash64 of the token, as unsigned."""
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 42)


#: Steps over all tokens of a block go by stretches of so many, so that their temporaries stay small.
STRETCH = 1 << 17


def stretches(n: int):
    for lo in range(0, n, STRETCH):
        yield slice(lo, min(lo + STRETCH, n))


def pair_keys(hashes: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key for each token (an index into `hashes`) with the one before it; at the places `first` the start of a text stands before."""
    out = np.empty(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        before = mix64(np.append(hashes, np.uint64(0x5EED)), 1) * np.uint64(3)
        out[1:] = before[ids[:-1]]
        out[first] = before[-1]
        for at in stretches(len(ids)):
            out[at] = mix64(out[at] + hashes[ids[at]], 2)
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, which is 32 bits wide, in a third of its memory."""
    by = np.argsort(values)
    ordered = values[by]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ordered = ordered[new]
    rank = np.cumsum(new, dtype=np.uint32)
    rank -= np.uint32(1)
    back = np.empty(len(values), np.uint32)
    back[by] = rank
    return ordered, back


# ---- the filter -----------------------------------------------------------------------


def _slots(keys: np.ndarray, level: int, probe: int, segments: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment (by the key alone) and bit of a probe."""
    seg = (keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    bit = mix64(keys, 8 + level * PROBES + probe) % np.uint64(segment_bits)
    return seg.astype(np.int64), bit.astype(np.int64)


def _cuts(keys: np.ndarray, segments: int) -> list[int]:
    """Where each segment begins among ascending keys, and where the last one ends."""
    least = np.array([-(-(s << 32) // segments) << 32 for s in range(segments)], np.uint64)
    return [*np.searchsorted(keys, least).tolist(), len(keys)]


class CountFilter:
    """Reads quantised counts back from the filter's bytes."""

    def __init__(self, data: bytes, segments: int, segment_bits: int):
        self.data = np.frombuffer(data, np.uint8)
        self.segments, self.segment_bits = segments, segment_bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        for q in range(1, len(LEVELS) + 1):
            for j in range(PROBES):
                seg, bit = _slots(keys[live], q, j, self.segments, self.segment_bits)
                at = seg * self.segment_bits + bit
                live = live[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if not len(live):
                    return out
            out[live] = q
        return out


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def _packets(segments: int):
    """All token and pair keys of each block with their counts in its training texts, a compressed packet for each segment."""

    def run(batches):
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, unzip)
                keys, by, back = block.keys()
                mask = block.training()
                counts = np.concatenate((np.bincount(block.ids[mask], minlength=len(block.hashes)), np.bincount(back[mask], minlength=len(keys) - len(block.hashes))))
                del back
                keys, counts = keys[by], counts[by]
                cuts = _cuts(keys, segments)
                out = []
                for s in range(segments):
                    lo, hi = cuts[s], cuts[s + 1]
                    if hi > lo:
                        gaps = np.diff(keys[lo:hi], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
                        out.append((s, int(hi - lo), zip_.compress(np.ascontiguousarray(gaps).tobytes()), zip_.compress(np.minimum(counts[lo:hi], 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())))
                s, m, k, c = zip(*out)
                del block, by, mask, keys, counts, gaps, out
                release_memory()
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(s), pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["block", "seg", "n", "keys", "counts"])

    return run


def _packet_keys(packed: bytes, unzip) -> np.ndarray:
    gaps = np.frombuffer(unzip.decompress(packed), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u8").reshape(-1), dtype=np.uint64)


def _packet_counts(packed: bytes, unzip) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _segment(keys: np.ndarray, q: np.ndarray, segment_bits: int) -> bytes:
    """The bits of one segment that holds each key at its level `q`."""
    bits = np.zeros(segment_bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        now = keys[q >= level]
        for j in range(PROBES):
            bits[_slots(now, level, j, 1, segment_bits)[1]] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _merge(finish):
    """Streaming: the packets of one segment follow each other; `finish` gets its sorted counts and its packets of keys."""

    def fold(parts):
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts])
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        seg, parts, waiting, packets = None, [], 0, []
        for pdf in batches:
            for block, s, n, k, c in zip(pdf["block"], pdf["seg"], pdf["n"], pdf["keys"], pdf["counts"]):
                if seg is not None and s != seg:
                    yield finish(seg, *fold(parts), packets)
                    parts, waiting, packets = [], 0, []
                seg = s
                packets.append((block, k))
                parts.append((_packet_keys(k, unzip), _packet_counts(c, unzip)))
                waiting += n
                if waiting > 4_000_000:
                    parts = [fold(parts)]
                    waiting = 0
        if seg is not None:
            yield finish(seg, *fold(parts), packets)

    return run


def filter_shape(tokens: int, bits_per_entry: int = 10, max_filter_bytes: int | None = None, segment_bytes: int = 1 << 19) -> tuple[int, int]:
    """Segments and bits per segment. No ceiling unless the caller sets `max_filter_bytes`."""
    bits = max(tokens, 1) * bits_per_entry
    if max_filter_bytes is not None:
        bits = min(bits, max_filter_bytes * 8)
    segment_bits = segment_bytes * 8
    segments = max(1, -(-bits // segment_bits))
    if segments == 1:
        segment_bits = max(1 << 16, 1 << (bits - 1).bit_length())
    return segments, segment_bits


def _dealt(blocks: DataFrame, segments: int) -> DataFrame:
    """The packets of all blocks, those of a segment one after another in one task."""
    packets = blocks.mapInArrow(_packets(segments), "block long, seg long, n long, keys binary, counts binary")
    return packets.repartition(min(segments, 2000), "seg").sortWithinPartitions("seg")


def build_filter(blocks: DataFrame, tokens: int, bits_per_entry: int = 10, max_filter_bytes: int | None = None, segment_bytes: int = 1 << 19) -> tuple:
    """All segments of the filter in one place, for corpora that small; returns (filter bytes, segments, bits per segment)."""
    segments, segment_bits = filter_shape(tokens, bits_per_entry, max_filter_bytes, segment_bytes)

    def finish(seg, keys, counts, packets):
        return pd.DataFrame({"seg": [seg], "bits": [_segment(keys, quantise(counts), segment_bits)]})

    data = bytearray(segments * segment_bits // 8)
    for r in _dealt(blocks, segments).mapInPandas(_merge(finish), "seg long, bits binary").collect():
        data[r.seg * segment_bits // 8 : (r.seg + 1) * segment_bits // 8] = r.bits
    return bytes(data), segments, segment_bits


def read_levels(blocks: DataFrame, tokens: int, bits_per_entry: int = 10, **shape) -> DataFrame:
    """(block, seg, levels): what the filter says of each block's keys, in the order of the keys, a row for each segment.

    Each segment is built and read within one task. It takes its share of the bits for
    `tokens`, the number of training tokens, and more where its entries ask for more.
    """
    segments, segment_bits = filter_shape(tokens, bits_per_entry, **shape)

    def finish(seg, keys, counts, packets):
        q = quantise(counts)
        size = max(segment_bits, -(-int(q.sum()) * bits_per_entry // 8) * 8)
        level = CountFilter(_segment(keys, q, size), 1, size).level(keys).astype(np.uint8)
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        replies = [zip_.compress(level[np.searchsorted(keys, _packet_keys(k, unzip))].tobytes()) for _, k in packets]
        return pd.DataFrame({"block": [b for b, _ in packets], "seg": seg, "levels": replies})

    return scratch_table(_dealt(blocks, segments).mapInPandas(_merge(finish), "block long, seg long, levels binary"), "levels")


# ---- blocks of documents --------------------------------------------------------------

#: A block in one row, and its tokens in rows of their own: their index and their training count.
_BLOCK = ["block", "doc_ids", "train", "sizes", "ids", "hashes"]
_BLOCK_ROW = "block long, doc_ids array<string>, train array<boolean>, sizes array<long>, ids binary, hashes binary, token string, idx int, n long"
_KINDS = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()]


#: A block after both kinds of counts were read: what its documents need for their scores.
_READ = "doc_ids array<string>, train array<boolean>, sizes array<long>, known array<long>, base array<double>, start int, now binary, pair binary, bins array<long>, times array<long>"
_READ_KINDS = [pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _to_blocks(batches):
    """Each text is split once; all later steps read token indexes."""
    from pyspark import TaskContext

    zip_ = zstandard.ZstdCompressor(level=1)
    names = [f.split()[0] for f in _BLOCK_ROW.split(", ")]
    block = TaskContext.get().partitionId() << 32

    class Index(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    index, docs, total = Index(), [], 0

    def flush():
        ids = np.concatenate([d[2] for d in docs])
        sizes = np.array([len(d[2]) for d in docs])
        train = np.array([d[1] for d in docs])
        n = np.bincount(ids[np.repeat(train, sizes)], minlength=len(index))
        words, size = list(index), len(index)
        hashes = np.fromiter(map(token_hash, words), np.uint64, size)
        packed = zip_.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())
        one = [[block], [[d[0] for d in docs]], [train.tolist()], [sizes.tolist()], [packed], [hashes.astype("<u8").tobytes()]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(one, _KINDS)], *[pa.nulls(1, k) for k in _KINDS[6:]]], names=names)
        tokens = [pa.array(words, pa.string()), pa.array(np.arange(size), pa.int32()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block), pa.int64()), *[pa.nulls(size, k) for k in _KINDS[1:6]], *tokens], names=names)

    for batch in batches:
        for doc_id, train, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "text"))):
            words = split_tokens(text)
            if docs and (total + len(words) > BLOCK_TOKENS or len(index) > BLOCK_TYPES):
                yield from flush()
                block, docs, total = block + 1, [], 0
                index.clear()
                release_memory()
            docs.append((doc_id, train, np.fromiter(map(index.__getitem__, words), "<u4", len(words))))
            total += len(words)
    if docs:
        yield from flush()
        docs.clear()
        index.clear()
    # a worker keeps what it does not give back, beside the memory of the steps that follow
    release_memory()


class Block:
    """A block read back: token indexes of all its documents in a row, and its tokens' hashes."""

    def __init__(self, row: dict, unzip):
        raw = np.frombuffer(unzip.decompress(row["ids"]), np.uint8).reshape(4, -1)
        self.ids = np.ascontiguousarray(raw.T).view("<u4").reshape(-1)
        self.hashes = np.frombuffer(row["hashes"], "<u8").astype(np.uint64)
        self.sizes, self.train, self.doc_ids = np.array(row["sizes"]), np.array(row["train"], bool), row["doc_ids"]
        self.first = np.cumsum(np.concatenate(([0], self.sizes[:-1])))

    def training(self) -> np.ndarray:
        """Which tokens stand in training documents."""
        return np.repeat(self.train, self.sizes)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the tokens, then of the distinct pairs; their ascending order; the pair of each place."""
        pairs, back = distinct(pair_keys(self.hashes, self.ids, self.first))
        keys = np.concatenate((mix64(self.hashes, 5), pairs))
        return keys, np.argsort(keys), back

    def levels(self, replies: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Levels of the token and of the pair at each place, and of the end token, from the replies in the order of the keys."""
        keys, by, back = self.keys()
        level = np.empty(len(keys), np.uint8)
        level[by] = replies
        size = len(self.hashes)
        end = np.flatnonzero(self.hashes == np.uint64(token_hash(END)))[0]
        return level[:size][self.ids], level[size:][back], int(level[end])


def estimates(now: np.ndarray, pair: np.ndarray, first: np.ndarray, start: int, n: int, v: int, own: int = 0):
    """Place, history level, bigram estimate and unigram estimate of the tokens of each stretch from the levels; `own` occurrences are taken off."""
    history = np.zeros(len(now), np.uint8)
    history[1:] = now[:-1]
    history[first] = 0
    # of what stands in no filter, the start of a text, bigrams are relative to the end tokens
    relative = history.copy()
    relative[first] = start
    for at in stretches(len(now)):
        seen = np.maximum(MIDDLE[relative[at]] - own, 0)
        bigram = np.minimum(np.divide(np.maximum(MIDDLE[pair[at]] - own - DISCOUNT, 0), seen, out=np.zeros(len(seen)), where=seen > 0), 1.0)
        yield at, history[at], bigram, (np.maximum(MIDDLE[now[at]] - own, 0) + 1) / (n + v + 1)


_BINS = 40


def fit_weights(table: dict[tuple[int, int], int], rounds: int = 60) -> np.ndarray:
    """EM for the bigram weight of each history level from counts of (level, bin of bigram / unigram)."""
    weights = np.full(len(LEVELS) + 1, 0.05)
    ratio = 10 ** (np.arange(_BINS + 1) / 4 - 2.0)
    ratio[0] = 0.0
    for level in range(len(weights)):
        n = np.array([table.get((level, b), 0) for b in range(_BINS + 1)], float)
        if not n.sum():
            continue
        w = 0.3
        for _ in range(rounds):
            mine = w * ratio / (w * ratio + 1 - w)
            w = min(0.99, max(1e-4, (n @ mine + 0.01) / (n.sum() + 1)))
        weights[level] = w
    return weights


def _ratio_bins(bigram: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        at = np.rint((np.log10(bigram / unigram) + 2.0) * 4)
    return np.where(bigram > 0, np.clip(at, 1, _BINS), 0).astype(np.int64)


def _exact_counts(asked: DataFrame, blocks: int, bucket_blocks: int) -> DataFrame:
    """(c, at, first): the count of a token and up to `bucket_blocks` places (block, idx) that ask for it; `first` marks one row of each token.

    The places of a frequent token fill many rows; their sum is joined back, so no row grows with the corpus.
    """
    buckets = -(-max(1, blocks) // bucket_blocks)
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int")
    parts = asked.groupBy("token", bucket.alias("bucket")).agg(F.sum("n").alias("c"), F.collect_list(F.struct("block", "idx")).alias("at"))
    if buckets == 1:
        return scratch_table(parts.select("c", "at", F.lit(True).alias("first")), "counts")
    parts = scratch_table(parts, "places")
    sums = scratch_table(parts.groupBy("token").agg(F.sum("c").alias("c"), F.min("bucket").alias("low")), "sums")
    out = scratch_table(parts.select("token", "bucket", "at").join(sums, "token").select("c", "at", (F.col("bucket") == F.col("low")).alias("first")), "counts")
    forget(parts, sums)
    return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, bucket_blocks: int = 2000, **filter_options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score), learning from the rows whose fold isn't `held`.

    `mean_score` is the score of a token, which texts of any length can be compared by.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), trains_on(F.col(doc_id), folds, held).alias("train"), whole_text(text).alias("text"))
    table = scratch_table(rows.mapInArrow(_to_blocks, _BLOCK_ROW), "blocks")
    blocks = table.filter("ids IS NOT NULL").select(*_BLOCK)
    asked = table.filter("token IS NOT NULL").select("token", "block", "idx", "n")
    counts = _exact_counts(asked, blocks.count(), bucket_blocks)
    sums = counts.filter("c > 0 AND first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(sums[0]), int(sums[1])
    levels = read_levels(blocks, n, **filter_options)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        rows = a.to_pylist()
        block = Block(next(r for r in rows if r["ids"] is not None), unzip)
        replies = sorted((r["seg"], r["levels"]) for r in rows if r["ids"] is None)
        now, pair, start = block.levels(np.frombuffer(b"".join(unzip.decompress(z) for _, z in replies), np.uint8))
        mask, bins, times = block.training(), [], []
        if mask.any():
            sizes = block.sizes[block.train]
            tally = np.zeros((len(LEVELS) + 1) * (_BINS + 1), np.int64)
            for _, history, bigram, unigram in estimates(now[mask], pair[mask], np.cumsum(sizes) - sizes, start, n, v, own=1):
                tally += np.bincount(history.astype(np.int64) * (_BINS + 1) + _ratio_bins(bigram, unigram), minlength=len(tally))
            bins = np.flatnonzero(tally)
            times = tally[bins]
        exact = np.zeros(len(block.hashes), np.int64)
        exact[b.column("idx").to_numpy()] = b.column("c").to_numpy()
        base = np.log10((exact + 1) / (n + (v + 1)))[block.ids]
        ends = block.first + block.sizes
        row = {
            "doc_ids": block.doc_ids,
            "train": block.train.tolist(),
            "sizes": block.sizes.tolist(),
            "known": np.add.reduceat((exact > 0)[block.ids], block.first, dtype=np.int64).tolist(),
            "base": [math.fsum(base[lo:hi].tolist()) for lo, hi in zip(block.first.tolist(), ends.tolist())],
            "start": start,
            "now": zstandard.ZstdCompressor(level=1).compress(now.tobytes()),
            "pair": zstandard.ZstdCompressor(level=1).compress(pair.tobytes()),
            "bins": np.asarray(bins, np.int64).tolist(),
            "times": np.asarray(times, np.int64).tolist(),
        }
        del block, now, pair, mask, exact, base
        release_memory()
        return pa.table({k: pa.array([x], t) for (k, x), t in zip(row.items(), _READ_KINDS)})

    replies = counts.select("c", F.explode("at").alias("a")).select(F.col("a.block").alias("block"), F.col("a.idx").alias("idx"), "c")
    asking = blocks.unionByName(levels, allowMissingColumns=True)
    # ids travel as text: a null among integers would turn them into floats
    read = scratch_table(asking.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _READ), "read")
    forget(table, counts, levels)
    seen = read.select(F.explode(F.arrays_zip("bins", "times")).alias("z")).groupBy("z.bins").agg(F.sum("z.times").alias("n")).collect()
    weights = fit_weights({divmod(r["bins"], _BINS + 1): r["n"] for r in seen})

    def finish(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                first = np.cumsum(sizes) - sizes
                now, pair = (np.frombuffer(unzip.decompress(row[k]), np.uint8) for k in ("now", "pair"))
                logs = np.empty(len(now))
                for at, history, bigram, unigram in estimates(now, pair, first, row["start"], n, v):
                    w = weights[history]
                    logs[at] = np.log10(w * bigram + (1 - w) * unigram)
                scored = {
                    "doc_id": pa.array(row["doc_ids"], pa.string()),
                    "held_out": pa.array([not t for t in row["train"]]),
                    "n_tokens": pa.array(row["sizes"], pa.int64()),
                    "n_known": pa.array(row["known"], pa.int64()),
                    "train_tokens": pa.array(np.full(len(sizes), n), pa.int64()),
                    "base_score": pa.array(row["base"], pa.float64()),
                    "score": pa.array(np.add.reduceat(logs, first), pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(scored)

    scored = read.mapInArrow(finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("mean_score", F.col("score") / F.col("n_tokens"))
