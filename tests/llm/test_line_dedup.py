import random

import pytest

from tidemark.llm import line_dedup

BLANKS = " \t\n\v\f\r"


def brute(docs, least):
    lines = [[x.strip(BLANKS) for x in t.split("\n")] for t in docs]
    runs = {}
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            n = 0
            for j in range(i, len(ls)):
                n += len(ls[j].split())
                if n >= least:
                    runs.setdefault(tuple(ls[i : j + 1]), []).append((d, i))
    gone = [set() for _ in docs]
    for run, places in runs.items():
        for d, i in places[1:]:
            gone[d] |= set(range(i, i + len(run)))
    return ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in enumerate(docs)]


@pytest.mark.parametrize("least", [3, 8])
def test_matches_every_repeated_run(spark, least):
    rng = random.Random(5)
    docs = ["\n".join(" ".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3]))) for _ in range(rng.randrange(0, 22))) for _ in range(40)]
    docs += docs[:4] + ["a\n" * 30]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = [r.clean_text for r in line_dedup.remove_repeated_runs(df, min_words=least).orderBy("doc_id").collect()]
    assert got == brute(docs, least)


def test_odd_rows(spark, odd_docs, clashing, no_docs):
    got = line_dedup.remove_repeated_runs(odd_docs, min_words=5).collect()
    assert len(got) == 11
    text = {}
    for r in got:
        text.setdefault(r.doc_id, set()).add(r.clean_text)
    assert text[3] == text[4] == {""} and text[9] == {""} and text[1] == {"The cat sat on the mat and the dog sat on the log."}
    assert len(text[None]) == 1
    wide = line_dedup.remove_repeated_runs(clashing, min_words=5)
    assert wide.count() == 11 and wide.columns[: len(clashing.columns)] == clashing.columns
    assert line_dedup.remove_repeated_runs(no_docs).count() == 0
