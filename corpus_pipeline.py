"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; the runner writes
it as Parquet and the next stage reads that. Counted as part of the subpackage ``llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.llm import decontaminate, mixing, ngram_jaccard, quality_rules, token_output
from voxlake.llm.catalog import table, tokenizer_path
from voxlake.llm.store import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go (they have no words); a null doc_id is judged like others; repeated rows stay or go together; all columns
    are kept, whatever their names; without labels only the base limits judge; an empty table stays empty.
    """
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id (null last; then by hashes).

    Texts without words, null ones too, are no duplicates and all stay; of repeated rows one stays; all columns are kept.
    """
    return ngram_jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark removes nothing; all columns are kept.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: each as often as its taken words make up its size, rounded; the mix leaves out those below a half.

    Null and empty texts go (the mix takes no words of them); a null source is one more source; repeated rows share their part
    evenly; all columns are kept.
    """
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens and ids_crc32 of every document in them.

    A null text has the end id only; null doc_ids come first; repeated rows are documents of their own.
    """
    path = shared_path(spark, "tokens")
    token_output.write_shards(docs, path, tokenizer_path())
    return token_output.read_shards(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: Trained trees, MinHash classes and tokenizer ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
