"""From raw documents to packed training sequences: five stages, each stored before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm import bagminhash, packing, quality, secrets, substring_dedup
from articleflow.llm.bpe import Tokenizer
from articleflow.llm.common import read_table, shared

# No SQL: the stages rest on a fitted model, signatures and a tokenizer. The tests use brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier predicts to be good; rows without words have the labels' share."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    others = [c for c in docs.columns if c != "text"]
    scored = quality.score(
        docs.select(F.struct(*others).alias("document"), "text"), model, columns=("document",), keep_text=True
    )
    return scored.where("predicted = 1").select(*["text" if c == "text" else f"document.{c}" for c in docs.columns])


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class; rows of a null id all stay.

    An id with unequal texts stays with all its rows if one of them speaks for its class.
    """
    classes = bagminhash.near_duplicates(docs)
    kept = classes.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    dropped = kept.where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; a text that loses nothing stays unchanged."""
    others = tuple(c for c in docs.columns if c != "text")
    cut = substring_dedup.dedup(docs, carry=others, keep_text=True)
    lost = F.col("n_removed") > 0
    columns = {c: F.col(f"row.{c}") for c in others}
    columns["text"] = F.when(lost, F.col("kept_text")).otherwise(F.col("text"))
    if "n_chars" in columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(lost, length).otherwise(columns["n_chars"])
    return cut.select(*[columns[name].alias(name) for name in docs.columns])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in training sequences."""
    return packing.pack(docs, Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_per_class),
    ("substring dedup", without_repeats),
    ("secret scans", without_secrets),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared(stage(spark, docs, sf_dir))
    return docs
