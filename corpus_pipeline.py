"""Corpus preparation: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm.best_fit_packing import pack_stage
from shelfline.llm.common import Scratch, small_batches, table
from shelfline.llm.decontamination import without_leaks
from shelfline.llm.importance_resampling import good_only
from shelfline.llm.minhash_dedup import one_of_each
from shelfline.llm.toxicity import without_toxic


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)  # not undone: the stage's rows are computed when they are written
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _lean(without_toxic)),
    ("importance_resampling", _lean(good_only)),
    ("minhash_dedup", _lean(one_of_each)),
    ("decontamination", _lean(without_leaks)),
    ("best_fit_packing", _lean(pack_stage)),
]
#: Trained models and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
