"""A corpus pipeline of five stages, each an operator of ``sparrel.llm``.

Every stage gets the table that the stage before it wrote, and returns a table with
the columns of ``documents``; the last returns what encoding gives. Stages that
reject documents drop their rows. ``ORACLE_SQL`` is None: learned scores, edit
distances and token ids have no SQL; ``tests/llm`` holds the brute-force version.

In all stages an empty table stays empty, other columns stay as they are whatever
their names, and rows that repeat each other stay or go together but for the third
stage, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import bpe, decontaminate, jaccard, lines, toxicity
from sparrel.llm.common import cut, table
from sparrel.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines above their host's limit.

    Copies of a text count once here: the third stage keeps one of them, which could not
    be if their lines were held to be boilerplate. NULL and empty texts fail. Documents with NULL source share one. ``n_chars`` is that of the new text.
    """
    kept = lines.apply_rules(docs, texts=True)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not hold to be toxic. NULL counts as an empty text."""
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Rows with NULL id or without words stay all."""
    return jaccard.drop_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. NULL and empty texts hold none, NULL and empty items are in none."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document. NULL counts as an empty text, which has no tokens."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
