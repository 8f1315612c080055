"""A corpus from raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, line_dedup, mixing, quality_rules, similar_texts
from wayfold.llm.common import scratch, table


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; the others lose the lines that are in 5 or more texts of their source and over 5 % of them, or in over 5,000. Copies count once here: they would make their own lines frequent, and all of a text's copies would go; which of them stays is for the third stage. Null texts go; equal rows stay, each; all columns are kept."""
    return _measured(quality_rules.apply_quality_rules(docs, quality_rules.quality_rules(docs, copies=False)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the last that holds them. Null texts become empty; equal rows stay, each; the columns of documents are returned, further ones are not."""
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return _measured(out.select(F.col("id").alias("doc_id"), "text", "carried.lang", "carried.source", F.lit(0).alias("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a Jaccard similarity of five-word shingles of 0.8 or more stays, the one with the smallest id; of different texts under that id, one; other groups with the same id keep theirs. Null and empty texts are one group; equal rows count once; all columns are kept."""
    return similar_texts.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for what it takes once and one for what it takes twice. Texts without words are not taken; a null source is a source; equal rows are one; all columns are kept."""
    return _measured(mixing.mixed_documents(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the tokens of each text, and the digests of ids and of what they decode to: doc_id and these columns alone. Null texts have no ids; equal rows are encoded each."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs, path, decoded=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("tokens", tokens),
]

#: SQL can express neither the signatures nor the draws nor the merges of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of documents, each written to the shared folder and read again; what is written goes when the application ends."""
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
