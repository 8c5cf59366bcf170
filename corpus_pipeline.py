"""Training-corpus pipeline: documents through toxicity filter, SimHash
near-duplicate removal, suffix-array deduplication and packing.

Every stage takes all that its predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import packing, simhash_vpt, suffix_dedup, toxicity
from scoreline.llm.common import plain, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject, with all their
    columns.  Null texts are empty and stay; repeated rows stay or go together;
    null ids stay; no rows (or no labels) give none (or reject none)."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group, that of the smallest id,
    with all its columns.  Null texts are empty, and texts without words are one
    group; of rows of one id and text one stays; rows with a null id all stay."""
    return simhash_vpt.drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds too;
    ``n_chars`` follows, all other columns stay, whatever they are called.  Null
    texts become empty; rows with a null id, and texts shorter than a passage,
    stay whole; repeated rows are cut alike."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup.cut_repeats(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *map(plain, others)).alias("others")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("cut_text"), "n_chars": F.length("cut_text").cast("bigint")}
    return cut.select(*[new.get(c, F.col("others").getField(c)).alias(c) for c in docs.columns])


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches of documents of like length: every row with its
    columns and its place.  Null texts are empty (one token); repeated rows are
    packed each; no rows give none."""
    return packing.pack(docs, packing.word_tokens(F.col("text")))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("suffix_dedup", cut_passages), ("packing", pack_batches)]

#: no stage but the last is SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to
    the shared folder and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
