import random
import re

import xxhash

from tidemark.llm import components, exact_dedup, similar, simhash


def words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])


def brute_fp(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 3)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(names, linked):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def test_fingerprints_and_components(spark, odd_docs, clashing, no_docs):
    rows = odd_docs.collect()
    fps = sorted({brute_fp(r.text) for r in rows})
    cls = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for r in rows:
        if r.doc_id is not None:
            c = cls[brute_fp(r.text)]
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = sorted((r.doc_id or -1, f"{brute_fp(r.text):016x}", low.get(cls[brute_fp(r.text)]) or -1) for r in rows)
    for docs in (odd_docs, clashing):
        got = simhash.near_duplicates(docs).collect()
        assert sorted((r.doc_id or -1, r.fp.hex(), r.component_id or -1) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_links_equal_brute_force_in_short_and_long_lists(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(25):
            x = seed
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for limit in (1000, 3):
        links = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.links_within_two_bits(nodes, limit).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        pairs = {(a, b) for a, b in links} | {(b, a) for a, b in links}
        assert classes(fps, lambda a, b: (a, b) in pairs) == want
        if limit == 1000:
            assert len(pairs) == sum((a ^ b).bit_count() <= 2 for a in fps for b in fps if a != b)


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for base in range(15):
        text = [rng.choice(vocab) for _ in range(250)]
        for copy in range(rng.choice([1, 2, 12])):
            own = list(text)
            for _ in range(rng.randrange(0, 12) if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((n, " ".join(own), "en", "a", n))
            n += 1
    return rows


def test_similar_groups_against_brute_force(spark):
    rows = near_rows()
    sets = {r[0]: set(shingles(r[1], 5)) for r in rows}
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = classes(sorted(sets), lambda a, b: jac(a, b) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for limit in (64, 2):
        kept = {r.doc_id for r in similar.drop_similar(df, long_list=limit).collect()}
        assert kept == {n for n, c in want.items() if n == c}


def test_drop_similar_odd_rows(odd_docs, clashing, no_docs):
    out = similar.drop_similar(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 3, 7, 8]
    wide = similar.drop_similar(clashing)
    assert wide.columns == clashing.columns and wide.count() == 5
    assert similar.drop_similar(no_docs).count() == 0


def groups_equal_brute_force(spark, texts, **options):
    sets = {n: set(shingles(t, 5)) for n, t in enumerate(texts)}
    want = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in similar.drop_similar(df, **options).collect()}
    assert kept == {n for n, c in want.items() if n == c}
    return len(texts) - len(kept)


def test_families_over_one_template(spark):
    """Many pairs of copies that share most of their text with all others: lists stay long, and no pair may be left."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    template, texts = [word() for _ in range(160)], []
    for _ in range(300):
        own = [word() for _ in range(40)]
        for _ in range(2):
            copy = list(own)
            copy[rng.randrange(40)] = word()
            texts.append(" ".join(template + copy))
    assert groups_equal_brute_force(spark, texts) == 300


def test_long_lists_are_compared_whole(spark, monkeypatch):
    """Without fingerprints and leaders every pair of the long lists must still be found."""
    monkeypatch.setattr(similar, "_by_fingerprint", lambda nodes: similar.scratch_table(nodes.selectExpr("node a", "node b").limit(0), "near"))
    rows = near_rows()
    assert groups_equal_brute_force(spark, [r[1] for r in rows], long_list=2, leaders=()) > 0
    assert groups_equal_brute_force(spark, [r[1] for r in rows], long_list=2, leaders=(1, 2)) > 0


def test_short_texts_and_mixed_sizes(spark):
    """Sets of one to forty shingles, down to texts of one word, with copies that gain or lose a few words."""
    rng = random.Random(12)
    texts = []
    for i in range(120):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 45))]
        texts += [" ".join(text), " ".join(text + ["tail"] * rng.randrange(3)), " ".join(text[: len(text) - rng.randrange(2)])]
    assert groups_equal_brute_force(spark, texts) > 100


def test_appended_and_replaced_blocks(spark):
    """One stretch differs and the similarity is just over 0.8."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for i in range(200):
        text = [word() for _ in range(300)]
        other = text + [word() for _ in range(72)] if i % 2 else text[:120] + [word() for _ in range(28)] + text[148:]
        texts += [" ".join(text), " ".join(other)]
    assert groups_equal_brute_force(spark, texts) == 200


def test_texts_do_not_move_to_meet_keys(spark, monkeypatch):
    """However long the lists of keys, only rows that they may name are shuffled with their texts."""
    rows, plans, write = near_rows(), {}, similar.scratch_table
    monkeypatch.setattr(similar, "scratch_table", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
        node = out._jdf.queryExecution().optimizedPlan()
        while node.children().size() == 1:
            node = node.children().apply(0)
        assert "Exchange" not in plans["sets"]
        assert node.nodeName() == "Union" and "Join" not in node.children().apply(0).toString()
        kept = {r.doc_id for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    sets = {r[0]: set(shingles(r[1], 5)) for r in rows}
    want = classes(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert kept == {n for n, c in want.items() if n == c}


def test_drop_similar_with_filters_too_large_to_broadcast(spark, odd_docs):
    assert groups_equal_brute_force(spark, [r[1] for r in near_rows()], broadcast_bytes=0) > 0
    assert sorted(r.doc_id or -1 for r in similar.drop_similar(odd_docs, broadcast_bytes=0).collect()) == [-1, 1, 3, 7, 8]


def test_member_filter(spark):
    keys = [xxhash.xxh64_intdigest(str(i), 7) - (1 << 63) for i in range(30000)]
    members = spark.createDataFrame([(k,) for k in keys[:20000]], "key long")
    rows = spark.createDataFrame([(k,) for k in keys], "key long").repartition(3)
    for options in ({}, {"broadcast_bytes": 0}):
        found = {r.key for r in exact_dedup.MemberFilter(members, **options).flag(rows).filter("maybe").collect()}
        assert found >= set(keys[:20000]) and len(found) < 20300
    assert exact_dedup.MemberFilter(members.limit(0)).flag(rows).filter("maybe").count() == 0
