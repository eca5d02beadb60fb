"""Queries of the operators that learn from the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lm_scoring, toxicity
from .common import load


def op10_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its nearest labelled examples."""
    return toxicity.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("text_key")


def op9_gru_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every whole document under the recurrent model and the unigram base."""
    return lm_scoring.scores(load(spark, sf_dir, "documents"))


QUERIES = {"op9_gru_lm_scores": op9_gru_lm_scores, "op10_block_max_toxicity": op10_block_max_toxicity}
ORACLE_SQL: dict = {}
