import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
    return 12 <= len(d) <= 19 and total % 10 == 0


def brute(text):
    found = sorted((m.start(), i, m.end(), k) for i, k in enumerate(RULES) for m in re.finditer(RULES[k], text) if valid(k, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def texts():
    rng = random.Random(3)
    out = [
        "a@b.c_d@e.f", "a@b.co.x@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1", "1 2-3 4111 1111 1111 1111 4-", "+1 (017) 555-7713",
        "😀 a@b.co é +49 30 1234567", "4111111111111111 5", "", "12-", "+1", "00255.01.2.3", "9" * 20000, "a." * 10000 + "@b.c", "+1" + " " * 20000, "a@b.c " * 700, "a@b" + ".c" * 20000, "x" * 300 + "(at)" + "y" * 100 + " dot z" * 3000, "token = " + "a1" * 5000,
    ]
    return out + ["".join(rng.choice("1234567890@.+-() ab%_\n😀é4111") for _ in range(80)) for _ in range(400)]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in pii.detect(df, keep=["doc_id"]).select("doc_id", pii.spelled("base").alias("base"), pii.spelled("spans").alias("spans")).collect()}
    for i, t in rows:
        assert got[i].base == brute(t), t[:80]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_labelers_add_obfuscated_spans_and_leave_prose(spark):
    rows = [(i, f"write to user{i} (at) mail [dot] com or call (555) 123-{1000 + i}, IP 10.0.0.{i}") for i in range(20)]
    rows += [(100 + i, f"version 2.{i} of part 12 was built in 2019") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(df, keep=["doc_id"]).select("doc_id", pii.spelled("spans").alias("spans")).collect()}
    assert all(s.count("email:") == s.count("phone:") == s.count("ip:") == 1 for i, s in got.items() if i < 100)
    assert all(s == "" for i, s in got.items() if i >= 100)


def test_odd_rows_and_native_plan(odd_docs, clashing, no_docs):
    out = pii.detect(odd_docs, keep=["doc_id"])
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
    assert out.count() == 11 and pii.detect(no_docs).count() == 0
    wide = pii.detect(clashing)
    assert wide.count() == 11 and sorted(wide.columns) == sorted(clashing.columns) and dict(wide.dtypes)["spans"].startswith("array")
    assert out.filter(F.size("spans") > 0).count() == 0


def test_reliabilities_rank_the_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = tuple((1 if truth == (rng.random() < a) else -1) for a in (0.95, 0.9, 0.7, 0.6, 0.85))
        counts[votes] = counts.get(votes, 0) + 1
    prior, right = pii.estimate([(0, True, v, (), n) for v, n in counts.items()])[0]
    assert abs(prior - 0.5) < 0.05 and all(abs(a - b) < 0.06 for a, b in zip(right, (0.95, 0.9, 0.7, 0.6, 0.85)))


def test_added_spans_held_out(spark):
    """National numbers of four languages, spelled addresses and secrets, planted among prose with numbers that are none."""
    rng = random.Random(5)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    shapes = [
        ("phone", lambda: f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}"),
        ("phone", lambda: f"0{rng.randrange(1, 10)} {d(2)} {d(2)} {d(2)} {d(2)}"),
        ("phone", lambda: f"{rng.choice('679')}{d(2)} {d(3)} {d(3)} {d(3)}"),
        ("phone", lambda: f"0{rng.randrange(30, 999)} {d(3)} {d(4)}"),
        ("phone", lambda: f"0049 {rng.randrange(30, 99)} {d(7)}"),
        ("email", lambda: f"user{d(3)} " + rng.choice([f"[at] mail{d(1)} [dot] org", f"at mail{d(1)} dot org"])),
        ("secret", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"'),
    ]
    decoys = [lambda: f"in {rng.randrange(1900, 2020)} some {d(2)} of them", lambda: f"at noon the {d(1)} dogs", lambda: "dogs at home. They sleep. All", lambda: f"page {d(3)} and chapter {d(1)}.{d(1)}", lambda: f"costs {d(3)}.{d(2)} or {d(2)},{d(3)}", lambda: "the token: a word", lambda: f"score {d(1)}-{d(1)} in {d(2)}:{d(2)}"]
    rows, want = [], {}
    for i in range(600):
        kind, make = shapes[i % len(shapes)]
        before, said = rng.choice(["", "call ", "write to ", "here: "]) + "word ", make()
        if i % 2:
            said, kind = rng.choice(decoys)(), None
        rows.append((i, f"{before}{said} and more"))
        want[i] = (kind, len(before), len(before) + len(said))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = hit = 0
    for r in pii.detect(df, keep=["doc_id"]).collect():
        kind, lo, hi = want[r.doc_id]
        found += len(r.spans)
        hit += any(pii.KINDS[s.kind] == kind and s.start < hi and lo < s.end for s in r.spans)
    planted = sum(k is not None for k, _, _ in want.values())
    assert hit >= 0.95 * planted and hit >= 0.95 * found, (hit, planted, found)


def test_query_counts_each_kind(spark, tmp_path):
    """Counts and digest of the query equal the plain patterns: a kind alone, several, none, and null text."""
    import hashlib

    from tidemark.llm.queries import op3_pii

    said = {"email": "a@b.co", "ip": "10.0.0.1", "card": "4111111111111111", "phone": "+1 (017) 555-7713"}
    plain = [None, "", "none", *said.values(), "a@b.co, c@d.org", "10.0.0.1 and 10.0.0.2 and 10.0.0.3", "; ".join(said.values()), "; ".join([*said.values()][::-1] * 2), *texts()[:7]]
    spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_pii(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(plain)))
    for r in rows:
        base = brute(plain[r.doc_id] or "")
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert [r[f"n_{k}"] for k in RULES] == [kinds.count(k) for k in RULES], plain[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
