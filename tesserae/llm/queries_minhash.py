"""op1: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import minhash
from tesserae.llm.common import table


def op1_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op1_min_max_hashing": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM l),
u AS (SELECT doc_id, unnest(s) AS s FROM l),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
t(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id AND t.root < e.b),
m AS (SELECT doc_id, min(root) AS root FROM t GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, root AS component_id, n.doc_id = root AS kept FROM n JOIN m USING (doc_id)"""
}
