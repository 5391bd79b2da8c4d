"""Corpus preparation from documents to token ids, as stages that are written and read again.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame that is written as Parquet and reread as the next one's
``docs``.  All but the last return the columns of ``docs``.  A stage tells rows
apart by file and row, so repeated rows and null ids are handled row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import bpe, tables
from reefline.llm.exact_dedup import exact_duplicates
from reefline.llm.mixing import mixed_documents
from reefline.llm.quality import THRESHOLD, score_documents
from reefline.llm.simhash import near_duplicates

#: SQL can express neither the classifier nor SimHash nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is below the threshold go.  Learns from the labelled ids of three of four folds."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rows = tables.numbered(docs)
    scored = score_documents(rows, labels, tables.fold("doc_id", 4) == 2, carry=tables.ROW)
    return tables.without(rows, scored.where(F.col("score") < THRESHOLD))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays, that of the least id."""
    rows = tables.numbered(docs)
    return tables.without(rows, exact_duplicates(rows, carry=tables.ROW).where(~F.col("kept")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links join stays, that of the least id: shingles of three words, two bits at most."""
    rows = tables.numbered(docs)
    return tables.without(rows, near_duplicates(rows, words=3, threshold=2, carry=tables.ROW).where(~F.col("kept")))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of its source takes it: not at all, or up to three times."""
    return mixed_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, ids_sha256, decoded_sha256)`` of each row."""
    tokenizer = bpe.tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    both = bpe.decode(bpe.encode(docs, tokenizer), tokenizer)
    return both.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), "tokens", *bpe.digests("tokens", "decoded"))


_OWN: list[str] = []


def _freeing(function: Stage) -> Stage:
    """Before a stage starts, remove the intermediate tables of the one before: its result has been written by then."""
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tables.release(spark, _OWN)
        before = set(tables.written())
        try:
            return function(spark, docs, sf_dir)
        finally:
            _OWN[:] = [p for p in tables.written() if p not in before]

    stage.__doc__ = function.__doc__
    return stage


STAGES: list[tuple[str, Stage]] = [(f.__name__, _freeing(f)) for f in (
    quality_classifier, exact_dedup, simhash_near_dedup, mix_to_weights, bpe_encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir))
    return docs
