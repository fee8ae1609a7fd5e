"""op9: words of every document that a repeated window covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import substring
from tesserae.llm.common import table


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op9_suffix_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM o),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range(0, 35) t(k)),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n_words, count(g.j) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.j IS NULL THEN x.word END, ' ' ORDER BY x.j), '')) AS kept_sha256 FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
}
