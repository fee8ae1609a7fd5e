"""op10: all documents in sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import packing
from tesserae.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
