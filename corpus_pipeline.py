"""A training corpus from ``documents`` in five stages; each reads what the one before it kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.jaccard import join_components
from tidemark.llm.language import held_out, predictor, train
from tidemark.llm.packing import pack
from tidemark.llm.batches import in_own_session
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.secrets import redact, scanner
from tidemark.llm.secrets import train as train_secrets
from tidemark.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letter, or no language it is sure of."""
    docs = in_own_session(docs)
    guess = predictor(train(docs.where(~held_out())), spark)
    return docs.where(~guess("text")["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest doc_id, once.

    Rows that share a doc_id are one document to the join; the one whose text has the smallest hash stays. Rows without a
    doc_id can't be told from each other and are kept as they are.
    """
    docs = in_own_session(docs)
    first = join_components(docs).where("component_id = doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    kept = docs.join(first.where("n = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    several = first.where("n > 1")
    if several.isEmpty():
        return kept.select(docs.columns)
    rest = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    by = Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256), *rest)
    once = docs.join(several, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(by)).where("_nth = 1")
    return kept.unionByName(once.drop("_nth")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark windows go; the others stay whole. Each row is judged by its own text."""
    docs = in_own_session(docs)
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.where(~((F.col("found.n_hit") > 0) & (20 * F.col("found.n_hit") >= F.col("found.n_words")))).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret found is replaced in its text; no document goes."""
    docs = in_own_session(docs)
    clean = docs.withColumn("text", redact(F.col("text"), scanner(train_secrets(docs), spark)("text")))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 tokens."""
    return pack(in_own_session(docs), tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Models and the packing order have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps lies in the checkpoint folder until the session's owner clears it."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
