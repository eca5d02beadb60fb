"""Queries of the operators that work on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, piece_transducer
from .common import load


def op2_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 ids, a row for each piece."""
    return packing.pack(load(spark, sf_dir, "documents"), with_ids=False).drop("token_ids")


def op6_transducer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and checksum of its ids, digest of the decoded text."""
    both = piece_transducer.decoded(piece_transducer.encoded(load(spark, sf_dir, "documents")))
    return both.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars_decoded"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op6_transducer_pieces": op6_transducer_pieces, "op2_bounded_space_packing": op2_bounded_space_packing}
ORACLE_SQL: dict = {}
