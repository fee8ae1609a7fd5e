"""op4: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import toxicity
from tesserae.llm.common import split_of, table


def op4_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", split_of(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").where(split_of(F.col("doc_id"), 5) != 0)
    weights, bias = toxicity.fit(docs.where(~F.col("held_out")), labels)
    scored = toxicity.score(docs, weights, bias, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
