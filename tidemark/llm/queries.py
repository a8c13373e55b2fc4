"""One registered query for each training-data operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, bpe, decontaminate, exact_dedup, html_extract, lang_id, line_dedup, pii, simhash, token_files
from .common import scratch_path


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), scratch_path(spark, "ids"), _tokenizer())
    back = token_files.read_token_files(spark, files)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.train(docs.filter(lang_id.trains_on(F.col("doc_id"))))
    found = lang_id.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", (~lang_id.trains_on(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_secret and n_found (spans of all kinds) follow the fixed columns; `spans` holds the four listed kinds."""
    found = pii.detect(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    # a lambda of two parameters would get the index of the element, even where the second has a default
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    counts = [count("base", kind) for kind in pii.BASE_KINDS]
    listed = F.filter("spans", lambda s: s["kind"] < len(pii.BASE_KINDS))
    more = [count("spans", "secret"), F.size("spans").cast("long").alias("n_found")]
    return found.select("doc_id", *counts, F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled(listed).alias("spans"), *more)


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_runs(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict:
    return {
        "op4_bloom_lm": op4_bloom_lm,
        "op6_line_dedup": op6_line_dedup,
        "op3_pii": op3_pii,
        "op1_html_extract": op1_html_extract,
        "op9_decontaminate": op9_decontaminate,
        "op5_simhash": op5_simhash,
        "op8_lang_id": op8_lang_id,
        "op2_token_files": op2_token_files,
        "op10_bpe_codec": op10_bpe_codec,
        "op7_exact_dedup": op7_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL}
