"""A corpus pipeline of five stages over documents; each stage's decisions hold for the next.

Every stage takes null texts and ids, repeated rows and extra columns as they come; an empty table stays empty.
Every stage bounds the session's Arrow batches by bytes, for itself and those behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import bpe, decontam, jaccard, langid, pii
from locusframe.llm.common import bound_batches, cut, table
from locusframe.llm.queries import tokenizer_path
from locusframe.runtime import ship


def ready(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null texts too), or in a language that can't be told, go; repeated rows are judged alike."""
    ready(spark)
    return langid.keep_known(docs, langid.Model.fit(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of nearly equal documents (five-word shingles, Jaccard 0.8) the one with the smallest id stays; texts without words stay, of repeated rows one."""
    ready(spark)
    return jaccard.keep_first(docs, num=80, den=100, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    ready(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), least=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    ready(spark)
    return pii.redact(docs, pii.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids: a row for each row; a null text has none."""
    ready(spark)
    return bpe.encode_documents(docs, tokenizer_path()).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: Naive Bayes, the field's marginals and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
