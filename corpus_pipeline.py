"""The corpus pipeline: four stages over documents, each an operator of kinweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet in the shared folder and reads it again for the next one. All stages but the last return the
columns of documents, extra ones and such as are named like an operator's own included, untouched.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and an empty table, of
which it makes an empty one. What each does with them:

- quality: a null or empty text has no words, fewer than the rules ask for, so its row goes; repeated rows are judged alike.
- near_dedup: null and empty texts are like nothing and stay; of rows that share a doc_id one stays, that of the least text,
  and of copies without a doc_id one, unless a copy with a doc_id is there, which stays instead.
- mix: rows without words cost no token and come once an epoch; null languages and sources are nodes named unknown; rows of
  equal doc_id are taken together; rows without a doc_id share one place in the order.
- encode: null and empty texts have no token; a row of the result for each row that is left, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import op02_repetition, op06_mixing, op07_bpe, op10_min_max, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; without words (null, empty) none is kept."""
    return op02_repetition.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, repeated ids and rows without one too: five-word shingles, similarity of 0.8 or more.

    Texts without words are like nothing and stay.
    """
    return op10_min_max.one_of_each(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; small leaves come again in later epochs. Nulls are nodes of their own, named unknown."""
    return op06_mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids' and decoded bytes' digests of each document; a null text is an empty one."""
    import public_tokenizers

    return op07_bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL expresses neither the tokenizer nor groups of near copies; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
