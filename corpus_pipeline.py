"""A small cleaning pipeline over `documents`: five stages, each a call of one operator.

Every stage takes all that its predecessor kept; run() writes each stage's rows as Parquet
to the shared folder and reads them back for the next.

In every stage a null text counts as empty. Language identification drops null and empty texts and texts
without a letter, so later stages see them only when called alone: then they are copies of each other, stay
one row each for the other stages, and have no ids. Of ties and repeated rows the smallest doc_id stays
(null ids last), of rows that repeat id and text one. Very long texts are read whole. An empty table gives
an empty table. Extra columns pass through under their names, which never clash with a stage's own, but for
n_tokens, ids and decoded_sha256 in the last stage, which give way to its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, exact_dedup, lang_id, similar
from tidemark.llm.common import scratch_table
from tidemark.llm.queries import _tokenizer

#: Below this score the language of a text counts as unknown.
LEAST_SCORE = 0.4
#: What the last stage adds.
RESULTS = ("n_tokens", "ids", "decoded_sha256")


def _held(docs: DataFrame) -> DataFrame:
    """The text, and all columns in one, where no operator's result can take the place of one."""
    return docs.select(F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__held"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no letter, or no language that scores LEAST_SCORE."""
    model = lang_id.train(docs.filter(lang_id.trains_on(F.col("doc_id"))))
    found = lang_id.predict(_held(docs), model, text="__text", keep=["__held"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("__held.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs, width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(_held(docs), benchmark, text="__text", keep=["__held"]).filter(F.size("leaks") == 0).select("__held.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to a text of the same ids' spelling."""
    names = [c for c in docs.columns if c not in ("text", *RESULTS)]
    coded = bpe.encode_decode(docs.select("text", F.struct("doc_id", *[F.col(f"`{c}`") for c in names if c != "doc_id"]).alias("__held")), _tokenizer(), keep=["__held"])
    return coded.select("__held.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: A fitted language model, a sketch index and a tokenizer file have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return docs
