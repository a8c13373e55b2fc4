import hashlib
import re

import pytest

from tidemark.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in rows]
    groups = {}
    for (doc, *_), t in zip(rows, norm):
        groups.setdefault(t, []).append(doc)
    low = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted((d is None, d or 0, low[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, *_), t in zip(rows, norm))


@pytest.mark.parametrize("options", [{}, {"bits_per_row": 1}, {"broadcast_bytes": 0}, {"bits_per_row": 400_000, "broadcast_bytes": 0}])
def test_matches_brute_force_whatever_the_filter(spark, odd_docs, options):
    rows = [tuple(r) for r in odd_docs.collect()]
    got = exact_dedup.classify(odd_docs, **options).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_deduplicate_keeps_columns_and_one_row_each(odd_docs, clashing, no_docs):
    out = exact_dedup.deduplicate(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    texts = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]+", " ", r.text or "") for r in odd_docs.collect()})
    assert {r.doc_id for r in rows if r.text and r.text.startswith("The cat")} == {1}
    wide = exact_dedup.deduplicate(clashing)
    assert wide.columns == clashing.columns and wide.count() == len(rows)
    assert exact_dedup.deduplicate(no_docs).count() == 0
    assert exact_dedup.classify(no_docs).count() == 0


def test_every_text_single(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(5)
    got = exact_dedup.classify(df).collect()
    assert len(got) == 500 and all(r.kept and r.group_size == 1 for r in got)


def test_filter_left_in_place_flags_every_copy(spark):
    """Hashes that go to their segments: many segments, one text in a third of all rows."""
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same', concat('text ', id div 2)) AS text").repartition(5)
    got = exact_dedup.classify(df, bits_per_row=3000, broadcast_bytes=1000).collect()
    want = exact_dedup.classify(df).collect()
    assert exact_dedup.filter_shape(3000, 3000)[0] > 10
    key = lambda r: (r.doc_id, r.keep_id, r.group_size, r.kept)
    assert sorted(map(key, got)) == sorted(map(key, want)) and max(r.group_size for r in got) == 1000
    rows = exact_dedup.deduplicate(df, bits_per_row=3000, broadcast_bytes=1000)
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in want if r.kept)
