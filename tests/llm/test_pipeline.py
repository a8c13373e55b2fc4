import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from tidemark.llm import queries  # noqa: E402


def words(text):
    return re.findall(r"[^ \t-\r]+", text.translate({i: i + 32 for i in range(65, 91)}))


def shingle_set(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in cp.identify(spark, docs, sf).collect()}
    assert len(rows) >= 0.99 * docs.count()  # clean documents stay
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", rows[i].text), i)
    left = sorted(first.values())
    sets = {i: shingle_set(rows[i].text) for i in left}
    top = {i: i for i in left}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, a in enumerate(left):
        for b in left[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    left = [i for i in left if find(i) == i]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in left if not any(x in norm(rows[i].text) for x in items)]
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert sorted(got) == left
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i in left[:40]:
        want = library.encode(rows[i].text, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want)


def test_stages_keep_columns_on_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf)
            assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_stages_hand_clashing_columns_through(spark, sf, odd_docs):
    from pyspark.sql import functions as F

    names = ["score", "lang_pred", "leaks", "row", "k1", "k2", "sha", "key", "maybe", "g", "n", "node", "__whole", "keep_id", "map"]
    docs = odd_docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        kept = out.collect()
        assert kept and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in kept for n in names), k
    again = cp.encode(spark, odd_docs.withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(-1)), sf)
    assert len(again.columns) == len(set(again.columns)) and again.filter("n_tokens < 0").count() == 0


CONTRACT = {
    "op1_html_extract": "page_id url text n_chars",
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_bloom_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_line_dedup": "doc_id clean_text n_lines n_removed",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_lang_id": "doc_id held_out lang_pred score",
    "op9_decontaminate": "doc_id item_id coverage n_tiles longest",
    "op10_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_queries_return_their_columns(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    assert set(CONTRACT[name].split()) <= set(out.columns)
    n = spark.read.parquet(f"{sf}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()
    assert out.count() == n or name.startswith("op9_")
