"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, surrogates for personal data, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, minhash, pii, quality
from siltstone.llm.common import settled, shared_folder, table

#: The setting of the session that holds the key of the surrogates, and the key where it is not set.
KEY_SETTING, PII_KEY = "spark.siltstone.pii.key", "siltstone"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts go, repeated rows stay or go together. Texts are measured once
    and kept with their numbers, on which the rules fit."""
    stats = settled(quality.measured(docs.select(*COLUMNS)))
    return quality.judged(stats, quality.fitted(stats.drop("text", "doc_id"))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id; of repeated rows one. Null texts count as empty."""
    return minhash.deduplicated(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none, repeated rows stay or go together."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, and n_chars to match; null texts stay null, repeated rows stay alike."""
    key = spark.conf.get(KEY_SETTING, PII_KEY)
    return pii.replaced(docs.select(*COLUMNS), key).withColumn("n_chars", F.length("text").cast("bigint"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids; none for null and empty texts."""
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, forget=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("encoding", encoding),
]

#: The stages are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's result written to the shared folder and read again.

    A stage's result is removed once the next one is written; the last one's stays, for the rows returned are read from it.
    An empty table of documents gives no rows.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(at)
        if before:
            _removed(spark, before)
        before = at
    return docs
