"""The training-data pipeline: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  run() writes each stage's rows as Parquet into
the cluster's shared folder and hands them, read again, to the next; rows that two
stages lie behind are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.llm import decontaminate_fm, lang_rank, mixing, near_dedup, pii_bootstrap
from pellucid.llm.common import remove, shared_dir, table, unused

#: Documents less like every language's profile than this are rejected.
LEAST_SCORE = 0.05
#: Texts whose shingles of five words are alike to so many per cent are near duplicates.
NEAR_PER_CENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found; profiles are learned from the documents of the folds that op8 trains on."""
    model = lang_rank.learn(docs.where(lang_rank.fold(F.col("doc_id")) % 3 != 1).select("lang", "text"))
    lang, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "score")
    named = lang_rank.judged(docs, model, lang, score)
    return named.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    return near_dedup.kept_documents(docs, NEAR_PER_CENT).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of texts."""
    return decontaminate_fm.remove_hits(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii_bootstrap.redacted(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size and target of their source and the words taken of each (repeats counted); the others go."""
    return mixing.mix(docs, keep=docs.columns).where("taken > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Learned profiles and patterns can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, old = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if old:
                remove(spark, old)
            old = path
    return docs
