"""The training-data pipeline over ``documents``: classify, de-duplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; ``run`` writes each stage's rows to the shared folder and reads them
again.  All stages but the last return the columns of ``docs``.

1. quality   documents whose score by the rule ensemble is below its threshold go
2. near_dup  of documents linked by 0.8 of their five-word shingles, the smallest id stays
3. decontaminate  documents that contain a ten-word window of a benchmark item go
4. secrets   every span that the secret scan finds is replaced by `[secret]`
5. pack      documents become pieces of at most 4096 tokens, packed into sequences

Rows of a null id pass stages 1 to 4 on their own text and are no one's duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.llm import decontaminate, near_dup, packing, rule_ensemble, secrets
from turnforge.llm.common import read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.first_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dup", near_duplicates), ("decontaminate", without_benchmark), ("secrets", without_secrets), ("pack", packed)]

#: The classifier, the secret scan and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
