import collections
import math
import re
import zlib

import numpy as np

from tidemark.llm import bloom_lm


def split(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + [None]


def test_baseline_is_exact_and_the_model_beats_it(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: split(r.text) for r in docs.collect()}
    counts = collections.Counter()
    for i, w in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    got = bloom_lm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = rows[r.doc_id]
        want = sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w)
        assert math.isclose(r.base_score, want, rel_tol=1e-12)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_equal_a_model_without_a_filter(spark, sf):
    """Exact counts in dictionaries, rounded to the same levels; the filter's false levels are all that may differ."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: split(r.text) for r in docs.collect()}
    train = {i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    one, two = collections.Counter(), collections.Counter()
    for i in train:
        one.update(rows[i])
        two.update(zip(["<s>", *rows[i]], rows[i]))
    n, v = sum(one.values()), len(one)
    level = lambda c: int(bloom_lm.quantise(np.array([c]))[0])
    middle = lambda c, own: max(bloom_lm.MIDDLE[level(c)] - own, 0)

    def parts(words, own):
        for a, b in zip(["<s>", *words], words):
            seen = middle(one[None] if a == "<s>" else one[a], own)
            bigram = min(max(middle(two[a, b], own) - bloom_lm.DISCOUNT, 0) / seen, 1) if seen else 0.0
            yield 0 if a == "<s>" else level(one[a]), bigram, (middle(one[b], own) + 1) / (n + v + 1)

    table = collections.Counter()
    for i in train:
        for q, x, y in parts(rows[i], 1):
            table[q, int(bloom_lm._ratio_bins(np.array([x]), np.array([y]))[0])] += 1
    weights = bloom_lm.fit_weights(table)
    got = {r.doc_id: r for r in bloom_lm.score(docs).collect()}
    off = []
    for i, words in rows.items():
        want = sum(math.log10(weights[q] * x + (1 - weights[q]) * y) for q, x, y in parts(words, 0))
        off.append(abs(got[i].score - want) / abs(want))
        assert math.isclose(got[i].mean_score, got[i].score / len(words))
    # a false level weighs most in a short text
    assert sum(off) / len(off) < 0.02 and sorted(off)[int(0.95 * len(off))] < 0.05, (max(off), sum(off) / len(off))


def test_places_in_many_rows_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).repartition(5).cache()
    key = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 6))
    assert sorted(map(key, bloom_lm.score(docs).collect())) == sorted(map(key, bloom_lm.score(docs, bucket_blocks=1).collect()))


def test_filter_reads_counts_back(spark):
    df = spark.createDataFrame([("a b a b a c",)] * 20 + [("a b d",)], "text string").repartition(3)
    df = df.selectExpr("'1' AS doc_id", "true AS train", "text").mapInArrow(bloom_lm._to_blocks, bloom_lm._BLOCK_ROW).filter("ids IS NOT NULL")
    data = bloom_lm.build_filter(df, 1000)
    f = bloom_lm.CountFilter(*data)
    h = np.array([bloom_lm.token_hash(t) for t in ("a", "b", "c", "d", "zz")], np.uint64)
    level = f.level(bloom_lm.mix64(h, 5))
    assert level.tolist() == bloom_lm.quantise(np.array([61, 41, 20, 1, 0])).tolist()
    many = bloom_lm.build_filter(df, 10_000_000, segment_bytes=1 << 12, max_filter_bytes=1 << 16)
    assert many[1] == 16 and bloom_lm.CountFilter(*many).level(bloom_lm.mix64(h, 5)).tolist() == level.tolist()


def test_odd_rows(odd_docs, clashing, no_docs):
    got = bloom_lm.score(odd_docs).collect()
    assert len(got) == 11 and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert all(math.isfinite(r.score) for r in got) and sum(r.doc_id is None for r in got) == 2
    assert bloom_lm.score(clashing).count() == 11
    assert bloom_lm.score(no_docs).count() == 0


def test_false_levels_stay_rare_as_the_corpus_grows(spark):
    """Fifty times the tokens: the filter grows along, in segments that no task holds together."""
    rng = np.random.default_rng(3)
    for size in (20_000, 1_000_000):
        rows = [(str(i), i % 2 == 0, " ".join(map(str, rng.integers(0, 1 << 40, 5000)))) for i in range(2 * size // 5000)]
        df = spark.createDataFrame(rows, "doc_id string, train boolean, text string").repartition(4)
        blocks = df.mapInArrow(bloom_lm._to_blocks, bloom_lm._BLOCK_ROW).filter("ids IS NOT NULL").select(*bloom_lm._BLOCK).cache()
        replies = collections.defaultdict(list)
        for r in bloom_lm.read_levels(blocks, size, segment_bytes=1 << 14).collect():
            replies[r.block].append((r.seg, r.levels))
        false = unseen = 0
        for row in blocks.collect():
            unzip = bloom_lm.zstandard.ZstdDecompressor()
            block = bloom_lm.Block(row.asDict(), unzip)
            got = b"".join(unzip.decompress(z) for _, z in sorted(replies[row.block]))
            now, pair, _ = block.levels(np.frombuffer(got, np.uint8))
            mask = block.training()
            assert (now[mask] > 0).all() and (pair[mask] > 0).all()
            false, unseen = false + int((pair[~mask] > 0).sum()), unseen + int((~mask).sum())
        assert unseen > size and false < 0.03 * unseen
        blocks.unpersist()


def test_scores_have_no_ceiling_on_the_filter():
    sizes = [n * bits // 8 for n, bits in (bloom_lm.filter_shape(t) for t in (10**8, 5 * 10**9))]
    assert sizes[0] >= 10**8 * 10 // 8 and sizes[1] >= 5 * 10**9 * 10 // 8


def block_of(n_docs=2000, size=500, types=200_000):
    rng = np.random.default_rng(4)
    words = [str(i) for i in range(types)]
    rows = [(str(d), d % 7 != 2, " ".join([words[i] for i in np.minimum(rng.pareto(0.7, size) * 20, types - 1).astype(int)])) for d in range(n_docs)]
    return rows


def test_a_block_is_read_in_little_memory(monkeypatch):
    """Two workers stand beside the JVM of an executor: 45 bytes a token, the distinct pairs included (62 with whole-block temporaries)."""
    import tracemalloc

    import pyarrow as pa
    import pyspark

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    ids, train, texts = zip(*block_of())
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "train": train, "text": texts})
    first = next(b for b in bloom_lm._to_blocks([batch]) if b.column("ids").null_count == 0)
    n = sum(first.column("sizes")[0].as_py())
    assert n == 2000 * 501
    tracemalloc.start()
    try:
        packets = next(bloom_lm._packets(50)([first.select(bloom_lm._BLOCK)]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45 * n, peak / n
    # the keys and counts of all packets, against dictionaries
    unzip = bloom_lm.zstandard.ZstdDecompressor()
    keys = np.concatenate([bloom_lm._packet_keys(k.as_py(), unzip) for k in packets.column("keys")])
    counts = np.concatenate([bloom_lm._packet_counts(c.as_py(), unzip) for c in packets.column("counts")])
    assert (keys[1:] > keys[:-1]).all()
    segs = np.repeat(packets.column("seg").to_numpy(), packets.column("n").to_numpy())
    assert (bloom_lm._slots(keys, 1, 0, 50, 8)[0] == segs).all()
    one, two = collections.Counter(), collections.Counter()
    for i, trains, text in zip(ids, train, texts):
        words = split(text)
        one.update({w: 0 for w in words})
        two.update({p: 0 for p in zip(["<s>", *words], words)})
        if trains:
            one.update(words)
            two.update(zip(["<s>", *words], words))
    assert sorted(counts.tolist()) == sorted([*one.values(), *two.values()])


def test_stretches_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    now, pair = rng.integers(0, 60, 1000).astype(np.uint8), rng.integers(0, 60, 1000).astype(np.uint8)
    first = np.unique(np.append(0, rng.integers(0, 1000, 30)))
    hashes, ids = rng.integers(0, 2**63, 90, dtype=np.uint64), rng.integers(0, 90, 1000).astype(np.uint32)

    def all_of():
        found = [x[1:] for x in bloom_lm.estimates(now, pair, first, 5, 1000, 90, own=1)]
        return [*map(np.concatenate, zip(*found)), bloom_lm.pair_keys(hashes, ids, first)]

    whole = all_of()
    monkeypatch.setattr(bloom_lm, "STRETCH", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, all_of()))
    values, back = bloom_lm.distinct(whole[-1])
    want, at = np.unique(whole[-1], return_inverse=True)
    assert np.array_equal(values, want) and np.array_equal(back, at)
