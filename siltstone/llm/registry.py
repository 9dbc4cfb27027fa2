"""Queries of this subpackage over the tables of an input folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, chat, ctw, decontaminate, html, licenses, minhash, negatives, pii, pq, quality, variants, warc
from siltstone.llm.common import settled, table

#: The key of the surrogates in these queries; a deployment passes its own.
PII_KEY = "siltstone"
Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_entities")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the pages' captures with the response that it revisits."""
    return warc.digest_of(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and places of every document."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document."""
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = settled(quality.measured(docs).drop("text"))
    found = quality.judged(stats, quality.fitted(stats))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer as a preference pair."""
    return chat.digest(chat.preferences(*chat.answers_swapped(table(spark, sf_dir, "conversations"))))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents leak benchmark items."""
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its form and root, some occurrences misspelt by rule."""
    return variants.grouped(variants.vocabulary(table(spark, sf_dir, "documents"), erase_every=199))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor's positives among the embeddings."""
    return negatives.mined(*negatives.prepared(table(spark, sf_dir, "embeddings")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its links and the component of near duplicates that it is in."""
    return pq.linked(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """All queries by name."""
    made = (
        op1_html_extraction,
        op2_pii_surrogates,
        op3_minhash_near_dedup,
        op4_warc_revisits,
        op5_license_scan,
        op6_lm_scoring,
        op7_quality_rules,
        op8_byte_bpe,
        op9_preference_formatting,
        op10_benchmark_decontamination,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_embedding_near_dedup,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "op4_warc_revisits": warc.SQL,
        "op9_preference_formatting": chat.SQL,
        "op11_spelling_variants": variants.SQL,
        "op12_hard_negatives": negatives.SQL,
        "op13_embedding_near_dedup": pq.SQL,
    }
