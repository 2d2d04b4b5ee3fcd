"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, near_dedup, phrases, quality_classifier, quality_rules, secrets, sentence_pieces, sql, substring_dedup, token_store, url_filter, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = token_store.TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_token_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return token_store.encoded_documents(table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    coded = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), model_path or tokenizer_file(sentence_pieces.MODEL))
    return sentence_pieces.digests(coded)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_url_filter": op2_url_filter,
    "op3_warc": op3_warc,
    "op4_token_ids": op4_token_ids,
    "op5_near_dedup": op5_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": sql.OP2,
    "op5_near_dedup": sql.OP5,
    "op6_source_mixing": sql.OP6,
    "op9_decontamination": sql.OP9,
    "op13_phrases": sql.OP13,
}
