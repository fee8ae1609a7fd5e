"""op3: a language-model score of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import lm
from tesserae.llm.common import split_of, table


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), split_of(F.col("doc_id"), 10) != 0)
    held_out = split_of(F.col("doc_id"), 10) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
