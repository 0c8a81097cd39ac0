"""A training-data pipeline over `documents`: five stages, each one of the operators, each written and read again.

Every stage keeps the columns of `documents`, but the last, which returns the mix: each document that it takes words of,
how many, and its source's size and target. Stage folders lie in the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.llm import decontaminate, jaccard, mixing, pii, quality
from isochron.llm.common import checkpoint_dir, cut, surrogate_key, table

#: Ids up to which a table of them is broadcast rather than shuffled against the texts.
MAX_BROADCAST = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score reaches the threshold; null and empty texts are scored like any other."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _bounded(ids: DataFrame) -> DataFrame:
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Documents without words and those without an id are in no group and stay. Of rows that share id and text one stays;
    rows that share an id only stay or go together.
    """
    drop = _bounded(jaccard.join(docs).filter(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    again = cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    again = _bounded(again)
    return kept.join(again, "doc_id", "left_anti").union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly benchmark go. Null texts and empty benchmarks change nothing."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars counts the new text. Null texts stay null."""
    return pii.replace(docs, surrogate_key(spark), chars="n_chars", counts=False)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, taken of the documents that it takes words of.

    Documents without words are never taken; an empty table gives an empty mix.
    """
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The first stage is a learned classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None
