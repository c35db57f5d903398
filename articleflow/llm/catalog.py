"""The queries of this folder by name, with SQL where SQL can state them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import (
    bagminhash,
    bpe_codec,
    cell_dedup,
    cross_polytope,
    mixing,
    packing,
    quality,
    secrets,
    substring_dedup,
    token_counts,
    url_rules,
    vector_codes,
    whitening,
)
from articleflow.llm.bpe import Tokenizer
from articleflow.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    ORACLES["op13_vector_codes"] = vector_codes.oracle()
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLES | whole


def base_tokenizer() -> Tokenizer:
    return Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read_table(spark, sf_dir, "documents"))


@query
def op2_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, base_tokenizer())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), base_tokenizer())


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op6_cell_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return cross_polytope.search(table, F.col("vec_id") % 20 == 0)


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a labelled document has its number; toxic or poor documents speak for a block."""
    pages = read_table(spark, sf_dir, "pages")
    labels = read_table(spark, sf_dir, "labels")
    blocked = ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")
    labelled = pages.select(F.col("page_id").alias("doc_id"), "url").join(
        labels.select("doc_id", blocked), "doc_id"
    )
    return url_rules.judge(pages, labelled)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer = Tokenizer.read(path, public_tokenizers.PATTERN)
    return bpe_codec.digests(bpe_codec.encode(docs, tokenizer), tokenizer)


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read_table(spark, sf_dir, "embeddings"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
