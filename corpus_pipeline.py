"""A training corpus from raw documents: STAGES in order, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.decontamination import decontaminate
from docframe.llm.mixing import mixed_blocks, plan_mix
from docframe.llm.near_duplicates import drop_near_duplicates
from docframe.llm.pii import redact
from docframe.llm.storage import materialize, table
from docframe.llm.toxicity import score_toxicity


def _texts_changed(docs: DataFrame, new: DataFrame) -> DataFrame:
    """new with n_chars, where docs has it, as the length of the text; the columns of docs."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*[f"`{c}`" for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the model learns from the stage's own documents and the labels.

    Null and empty texts score the prior and stay; rows that repeat are judged
    alike; an empty table stays empty; all columns come along.
    """
    scored = score_toxicity(docs, docs, table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    Of rows that repeat doc_id and text one stays; of one doc_id with several
    texts each text is judged by itself; null doc_ids and texts without words stay.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; documents of nothing else go. Null and empty texts stay; rows that repeat are cut alike."""
    return _texts_changed(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. Null, empty and clean texts stay; no row goes."""
    return _texts_changed(docs, redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by output shard and position: blocks of text with the ids of the documents in them. Documents without words are in none; rows that repeat are in it each; an empty table gives none."""
    return mixed_blocks(plan_mix(docs))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]
#: Learnt scores and pseudorandom draws are beyond SQL. Tests compare near-duplicates, decontamination and personal data
#: with brute force, toxicity with a plain forward pass, and the mix with its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents, each result written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
