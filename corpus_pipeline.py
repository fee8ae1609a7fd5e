"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import contain, langid, minhash, packing, suffix
from tesserae.llm.common import bounded_batches, materialize, remove, scratch, split_of, table
from tesserae.llm.queries_packing import tokenizer_path

#: No SQL: language profiles and packing are not expressible; tests compare with brute force.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The lead in cosine over the declared language from which another language rejects a document.
MARGIN = 0.1
#: The cosine that rejects instead where there is nothing to learn the declared language from.
CERTAIN = 0.5
#: Keys of this many rows at most go to all tasks.
FEW_IDS = 1 << 20


def with_row(docs: DataFrame) -> DataFrame:
    """COLUMNS and row, a hash of id and text that tells null from a value: rows without an id, and other texts of one id, have their own."""
    parts = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64(*parts))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose row is not in rows; few rows, after a count, by broadcast."""
    rows = materialize(rows.distinct(), "rows")
    return docs.join(F.broadcast(rows) if rows.count() <= FEW_IDS else rows, "row", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those clearly not in their declared language."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)  # other columns could bear the names of results
    languages, prototypes = langid.learn(docs.where(split_of(F.col("doc_id"), 4) != 2))
    told = langid.predict(docs, languages, prototypes, docs.columns, declared="lang")
    wrong = (F.col("lang_pred") != F.col("lang")) & F.coalesce(F.col("margin") >= MARGIN, F.col("score") >= CERTAIN)
    keep = (F.col("lang_pred") != langid.UNDETERMINED) & ~F.coalesce(wrong, F.lit(False))
    # without a single language to learn, nothing is rejected
    return (told.where(keep) if languages else docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingle sets are linked at 0.8.

    The least id stays; rows without an id come last.
    """
    docs = with_row(docs)
    found = minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), minhash.Settings(width=5, percent=80, bands=48, permutations=3))
    found = found.where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    found = materialize(found.join(docs.select("row", "doc_id").distinct(), "row"), "found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")).select("row")
    rest = without(docs, found.select("row").join(first, "row", "left_anti"))
    if minhash.repeats(rest.select(F.col("row").alias("doc_id"))):
        told = F.col("doc_id").isNotNull() | F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        rest = rest.where(told).dropDuplicates(["row"]).unionByName(rest.where(~told))
    return rest.select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 100 bytes or more; documents with nothing left go."""
    cut = suffix.deduplicated(docs, keep=("lang", "source")).where("n_removed = 0 or trim(text) <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that contain a benchmark item."""
    docs = with_row(docs)
    found = contain.search(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("row"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as tables:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            written = tables.pop()
        if last:
            remove(spark, last)
        last = written
    return docs
