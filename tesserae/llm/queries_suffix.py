"""op5: bytes of every document that a longer repeat covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import suffix
from tesserae.llm.common import table


def op5_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op5_interval_expansion": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(1, len(x) // 2 + 1)) AS j, x FROM d),
h AS (SELECT doc_id, j, substr(x, 2 * j - 1, 2) AS byte, CASE WHEN j <= len(x) // 2 - 99 THEN md5(substr(x, 2 * j - 1, 200)) END AS h FROM b),
r AS (SELECT doc_id, j, byte, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, j) > 1 AS again FROM h),
c AS (SELECT doc_id, j, byte, coalesce(max(CASE WHEN again THEN j END) OVER (PARTITION BY doc_id ORDER BY j) >= j - 99, false) AS gone FROM r),
s AS (SELECT doc_id, j, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM c),
k AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(byte, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
}
