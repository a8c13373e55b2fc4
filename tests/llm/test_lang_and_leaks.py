import collections
import math
import random
import re
import unicodedata

import regex

from tidemark.llm import decontaminate as D
from tidemark.llm import lang_id


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lang_id.train(docs.filter(lang_id.trains_on(docs.doc_id)))
    rows = lang_id.predict(docs.filter(~lang_id.trains_on(docs.doc_id)), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_model(rows):
    """Counts of words and n-grams per language, as the docstring tells them."""
    counts = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for lang, text in rows:
        for w in regex.findall(r"\p{L}+", text.lower()):
            counts[0][lang][w] += 1
            padded = f" {w} "
            for k in range(1, min(5, len(padded)) + 1):
                counts[k][lang].update(padded[i : i + k] for i in range(len(padded) - k + 1))
    return counts


def plain_score(counts, langs, text):
    known = {k: {x for c in counts[k].values() for x in c} for k in range(6)}
    total = dict.fromkeys(langs, 0.0)
    for w in regex.findall(r"\p{L}+", text.lower()):
        padded = f" {w} "
        for k in (0, 5, 4, 3, 2, 1):
            items = [w] if k == 0 else [padded[i : i + k] for i in range(len(padded) - k + 1)]
            items = [x for x in items if x in known[k] and x != " "]
            if items:
                for x in langs:
                    size = sum(counts[k][x].values())
                    floor = min(math.log10(0.5 / max(size, 1)), -6.5 if k == 0 else -5.5)
                    total[x] += sum(math.log10(counts[k][x][i] / size) if counts[k][x][i] else floor for i in items) / len(items)
                break
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(math.exp((total[x] - total[best]) * 0.5) for x in langs)


def test_scores_equal_the_plain_model(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text][:120]
    learn, ask = [(r.lang, r.text[:1500]) for r in docs[:60]], [r.text[:700] for r in docs[60:]] + ["Zyxwv qqq", "1/2 a\u0301b", "½ x"]
    counts, langs = plain_model(learn), sorted({x for x, _ in learn})
    model = lang_id.train(spark.createDataFrame([(i, *x) for i, x in enumerate(learn)], "doc_id long, lang string, text string"))
    assert model.langs == langs
    names, scores = lang_id.Scorer(model).score(ask)
    for text, name, score in zip(ask, names, scores):
        want, least = plain_score(counts, langs, text)
        assert math.isclose(score, least, rel_tol=1e-3, abs_tol=1e-6) and (name == want or score < 0.51)


def test_language_odd_rows(odd_docs, clashing, no_docs, spark):
    model = lang_id.train(odd_docs)
    got = lang_id.predict(odd_docs, model).collect()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert pred[3] == pred[4] == pred[5] == pred[8] == ("und", 0.0) and pred[1][0] == "en"
    wide = lang_id.predict(clashing.withColumnsRenamed({"fp": "score", "c": "lang_pred"}), model)
    assert wide.count() == 11 and "n" in wide.columns and {r.score for r in wide.collect()} == {r.score for r in got}
    nothing = lang_id.train(no_docs)
    assert {r.lang_pred for r in lang_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert lang_id.predict(no_docs, model).count() == 0


def test_numerals_are_no_letters(spark):
    model = lang_id.train(spark.createDataFrame([(1, "en", "the cat sat"), (2, "de", "der Hund lag")], "doc_id long, lang string, text string"))
    texts = ["½ ²", "Ⅷ①", "12 _ 34", "٣٤", "\u0301", "x½", "Ⅷ the", "一"]
    names, scores = lang_id.Scorer(model).score(texts)
    assert [n == "und" for n in names] == [True] * 5 + [False] * 3 and scores[:5] == [0.0] * 5
    assert names[6] == "en"
    assert [bool(lang_id.LETTERS.findall(t)) for t in texts] == [any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]


def slow_tiles(pattern, text, least):
    """Greedy tiling by plain comparison."""
    pm, tm, tiles = set(), set(), []
    while True:
        best = []
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] >= 0 and p + n not in pm and t + n not in tm:
                    n += 1
                best.append((n, -p, -t))
        n, p, t = max(best, default=(0, 0, 0))
        if n < least:
            return tiles
        tiles.append((n, -p, -t))
        pm |= set(range(-p, -p + n))
        tm |= set(range(-t, -t + n))


def test_tiling_covers_as_the_plain_greedy():
    rng = random.Random(8)
    for _ in range(150):
        p = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        t = [rng.randrange(-1, 4) for _ in range(rng.randrange(0, 60))]
        got, want = D.tile(p, t, 3), slow_tiles(p, t, 3)
        assert sorted((x[0] for x in got), reverse=True)[:1] == sorted((x[0] for x in want), reverse=True)[:1]
        for n, a, b in got:
            assert p[a : a + n] == t[b : b + n] and n >= 3
        assert len({i for n, a, _ in got for i in range(a, a + n)}) == sum(n for n, _, _ in got)
        left_p = {i for n, a, _ in got for i in range(a, a + n)}
        left_t = {i for n, _, b in got for i in range(b, b + n)}
        assert not slow_tiles([-2 if i in left_p else x for i, x in enumerate(p)], [-3 if i in left_t else x for i, x in enumerate(t)], 3)


def test_leaks_exact_reordered_and_clean(spark, sf, odd_docs, clashing, no_docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    docs = [(0, "x " * 50 + item.upper().replace(" ", ",\n") + " y" * 50), (1, " ".join(w[8:] + ["and"] + w[:8])), (2, " ".join(w[:6])), (3, "nothing of it"), (4, None), (5, ""), (0, item), (6, "so very TINY thing"), (7, "very a tiny"), (8, "東京都に行く")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "very tiny"), (None, " ".join(w)), (11, ""), (12, "東京都に行く。")], "item_id long, text string")
    for size in (200_000, 10):
        got = D.find_leaks(df, bench, block_tokens=size)
        assert got.columns == ["doc_id", "text", "leaks"]
        assert sorted((r.doc_id, sorted((h.item_id or 0) for h in r.leaks)) for r in got.collect()) == [(0, [0, 7, 8]), (0, [0, 7, 8]), (1, [0, 7, 8]), (2, []), (3, []), (4, []), (5, []), (6, [10]), (7, []), (8, [12])]
    real = spark.read.parquet(f"{sf}/benchmark.parquet")
    for size in (10**6, 10):
        assert D.find_leaks(df, real.limit(0), block_tokens=size).filter("size(leaks) > 0").count() == 0
        assert D.find_leaks(odd_docs, real, block_tokens=size).count() == 11
        wide = D.find_leaks(clashing, real, block_tokens=size)
        assert wide.count() == 11 and set(wide.columns) == set(clashing.columns)
        assert D.find_leaks(no_docs, real, block_tokens=size).count() == 0


def test_leaks_of_the_table_equal_tiling_of_all(spark, sf):
    """Every document against every item, without seeds' index, sieve or window."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    code = D._TokenCodes()
    items = [(r.item_id, D.coded(r.text, code).tolist()) for r in bench.collect()]
    grams = lambda s: {tuple(s[i : i + 4]) for i in range(len(s) - 3)}
    item_grams = [grams(s) for _, s in items]
    want = set()
    for r in docs.collect():
        seq = D.coded(r.text, code).tolist()
        own = grams(seq)
        for (i, s), g in zip(items, item_grams):
            if own & g:
                coverage = sum(n for n, _, _ in D.tile(s, seq, 4)) / len(s)
                if coverage >= 0.5:
                    want.add((r.doc_id, i, round(coverage, 9)))
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    plain = [(r.item_id, norm(r.text)) for r in bench.collect()]
    assert {(r.doc_id, i) for r in docs.collect() for i, t in plain if t in norm(r.text)} <= {x[:2] for x in want}
    for size in (10**6, 10):
        got = D.find_leaks(docs, bench, block_tokens=size).collect()
        assert {(r.doc_id, h.item_id, round(h.coverage, 9)) for r in got for h in r.leaks} == want


def test_long_and_uniform_texts_end(spark):
    one = "same " * 50_000
    df = spark.createDataFrame([(1, one), (2, one + "end"), (3, "word " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, one), (2, "same " * 40)], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.leaks] for r in D.find_leaks(df, bench).collect()}
    assert got == {1: [1, 2], 2: [1, 2], 3: []}
