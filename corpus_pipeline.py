"""A training corpus from the documents table: language, near-duplicates, benchmark, personal data, tokens."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import base, bpe, decontaminate, language, near_dup, pii
from docketlake.llm.queries import TOKENIZER


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can tell; those without any letter go."""
    model = language.fit(docs.where(~language.held_out()), "text", "lang")
    return language.predict(docs, model).where(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class. Rows of one id stay together; rows without an id stay."""
    kept = docs.join(near_dup.near_duplicates(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def unseen_by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows of one id stay or go together; rows without an id stay."""
    found = decontaminate.contaminated(docs, base.read(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    clean = pii.find(docs, clean_col="clean").withColumn("text", F.col("clean"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "text", F.sha2("text", 256).alias("digest")), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", unseen_by_benchmark), ("personal_data", without_personal_data), ("tokens", tokens)]

#: Training a model, edit distances, transducers and BPE are beyond SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    A stage's folder goes once the next stage is written, so at most two are kept; the last one stays, as the result reads it.
    """
    folder = f"{base.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = base.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            base.remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
