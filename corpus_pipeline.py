"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads back as the next
stage's ``docs``. All stages but the last return the columns of documents.

Null and empty texts have no words and go in the first stage, so do very short ones; null ids,
languages and sources are values like any other, repeated rows are near-duplicates of each
other, very long texts are gone through whole, extra columns stay through all stages but the last,
whatever their names, and an empty table stays empty. Tables that a stage needs inside are
dropped when a later stage begins, as its own input has been written by then."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from demandlake.llm import decontam, markov_secrets, nbest, quality, simhash
from demandlake.llm.shared import drop_folders, read_table, recorded, stage

StageFn = Callable[[SparkSession, DataFrame, str], DataFrame]
_HELD: list[str] = []


def _tidy(function: StageFn) -> StageFn:
    """Drops the work tables of earlier stages that ``docs`` does not read, and remembers those of this one."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _HELD
        _HELD = drop_folders(spark, _HELD, docs)
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _HELD += paths
        return out

    return run_stage


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality.drop_low_quality(docs)


@_tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays (3-word shingles, 2 bits)."""
    return simhash.drop_near_duplicates(docs, words=3, max_distance=2)


@_tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item was found go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@_tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [SECRET]; n_chars follows. All documents stay."""
    return markov_secrets.redact_secrets(docs)


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text (doc_id, ids, n-best scores, restored)."""
    return nbest.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", encode),
]

#: Alignment scores, Markov likelihoods and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
