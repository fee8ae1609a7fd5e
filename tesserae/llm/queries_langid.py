"""op6: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import langid
from tesserae.llm.common import split_of, table


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", split_of(F.col("doc_id"), 4) == 2)
    languages, prototypes = langid.learn(docs.where(~F.col("held_out")))
    return langid.predict(docs, languages, prototypes, ["doc_id", "held_out"])
