"""Corpus preparation in five stages, each one of the operators in cloakwork.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, language, line_dedup, pieces, similar
from cloakwork.llm.common import fresh_name, remove, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the machines, learnt from all of these documents, recognise; the others go."""
    model = language.fit_all(docs)
    return language.keep_recognised(docs, model, least=language.least_score(docs, model))


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share; n_chars follows the text."""
    clean = line_dedup.drop_common_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates."""
    return similar.one_of_each_similar(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return pieces.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", common_lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("sentencepiece", encode),
]

#: The models of the first and last stage and the fingerprints of the third are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table. What a stage has written goes when the next one has read it."""
    folder = f"{shared_dir(spark).rstrip('/')}/{fresh_name('pipeline')}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
