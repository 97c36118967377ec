"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, fingerprint, jaccard, langid, pii, quality, sharding, toxicity, twins, urlfilter
from .common import crc_remainder, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_tokens=False)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.classify(table(spark, sf_dir, "documents"), labels.where("quality = 1").select("doc_id"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(crc_remainder(labels["doc_id"], 5) != 0))
    found = toxicity.score(docs, net)
    return found.select("doc_id", (crc_remainder(found["doc_id"], 5) == 0).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.Model.fit(docs.where(crc_remainder(docs["doc_id"], 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (crc_remainder(found["doc_id"], 4) == 2).alias("held_out"), "lang_pred", "score")


#: The rules of the report.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.search(docs, table(spark, sf_dir, "benchmark")))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_shard": op2_shard,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_fingerprint": op5_fingerprint,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES: dict[str, str] = {
    "op8_url_filter": twins.url_filter(URL_RULES, urlfilter.DEFAULT),
    "op9_jaccard_join": twins.JACCARD_JOIN,
    "op10_decontaminate": twins.DECONTAMINATE,
}
