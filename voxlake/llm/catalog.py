"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import fit, secret_scan

    docs = table(spark, sf_dir, "documents")
    return secret_scan(docs, fit(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit, quality_classifier

    docs = table(spark, sf_dir, "documents")
    return quality_classifier(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .store import shared_path
    from .token_output import read_shards, write_shards

    path = shared_path(spark, "op10")
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_shards(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import mixing

    return {"op4_mix_sources": mixing.oracle_sql()}
