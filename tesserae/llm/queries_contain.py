"""op2: documents that contain benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import contain
from tesserae.llm.common import table


def op2_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contain.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SETS = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))"
ORACLE_SQL = {
    "op2_containment": f"""
WITH d AS (SELECT doc_id, unnest({_SETS}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0),
b AS (SELECT item_id, {_SETS} AS ss FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
x AS (SELECT item_id, len(ss) AS n, unnest(ss) AS s FROM b)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_shingles, CAST(count(DISTINCT s) AS INTEGER) AS shared,
       count(DISTINCT s) / CAST(n AS DOUBLE) AS containment
FROM d JOIN x USING (s) GROUP BY doc_id, item_id, n HAVING count(DISTINCT s) >= ceil(0.8 * n - 1e-9)"""
}
