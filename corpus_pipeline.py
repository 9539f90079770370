"""From raw documents to token ids: toxicity, line dedup, near-duplicate removal, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows to the shared
folder as Parquet and reads them again. Stages that compare or count keep to narrow columns; decisions come back to the texts by
a join whose small side is broadcast only after a count.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.llm.common import small, table
from tallymatch.llm.jaccard import jaccard_groups
from tallymatch.llm.lines import dedup_lines
from tallymatch.llm.mixing import mix_documents
from tallymatch.llm.pieces import encode_documents
from tallymatch.llm.toxicity import score_toxicity

MODEL = "piece_bpe_32k.model"


def free(docs: DataFrame) -> str:
    """A beginning that no column's name has, for a stage's own columns."""
    own = "stage_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    return own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability under a half; null and empty texts stay."""
    own = free(docs)
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix=own)
    return scored.where(~F.col(f"{own}toxic")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the long lines that at least five documents hold (the largest doc_id keeps them); n_chars follows."""
    own = free(docs)
    kept = dedup_lines(docs, prefix=own)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(f"{own}n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (Jaccard 0.8 or more) one row of the smallest doc_id; rows without an id or words stay.

    Rows are told apart by doc_id and text, so one doc_id may stay by one text and go by another. Rows that agree in both are
    one document: of a group's, the one with the smallest other columns stays.
    """
    groups = table(jaccard_groups(docs, n=5, threshold=(4, 5)).where("n_shingles > 0 and doc_id is not null"), "groups")
    first = table(groups.where("doc_id = component_id").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows")), "first")
    several = first.groupBy("component").agg(F.count("*").alias("texts"), F.min("text_hash").alias("stays")).where("texts > 1").select(F.col("component").alias("of"), "stays")
    more = first.join(several, (F.col("component") == F.col("of")) & (F.col("text_hash") != F.col("stays")), "left_semi")
    gone = groups.where("doc_id <> component_id").select("doc_id", "text_hash").union(more.select("doc_id", "text_hash")).distinct()
    gone = table(gone.toDF("__id", "__hash"), "gone")
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    out = docs.join(small(gone), same, "left_anti")
    twice = table(first.where("rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "twice")
    if twice.isEmpty():
        return out
    rest = F.struct(F.lit(0).alias("__0"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    lone = out.join(small(twice), same, "left_semi").groupBy("doc_id", "text").agg(F.min(rest).alias("__rest")).select("doc_id", "text", "__rest.*")
    return out.join(small(twice), same, "left_anti").union(lone.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of ids and decoded text, and the ids of each text with an end id."""
    return encode_documents(docs, public_tokenizers.path(MODEL), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: Fitted models and pseudorandom draws are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
