"""Small tables for the text operators."""

import random
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept int, slot int, chunk string, size double, held_out string, vslot int"


def split(text, fold=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD) if fold else text or "")


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and copies."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(60), prose(4000)
    texts = [None, "", " \t\n", "One", "one two", "ONE two", "1234 5678 !!", "  x y", shared, shared, shared + " end", prose(30) + " " + shared + " " + prose(20)]
    texts += [long, long, "a" * 500, "ab " * 300, "idiot " + prose(5), shared.upper(), "€" * 120, "€" * 120 + "x"]
    texts += [prose(rnd.randint(1, 80)) for _ in range(20)]
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id at all here", "en", None, None), (None, None, None, None, None)]
    return rows


def write(spark, path, rows):
    """documents (with columns named like results), labels and benchmark."""
    spark.createDataFrame([(*r, "x", 1, 2, "c", 0.5, "h", 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, i % 4 == 0) for i, r in enumerate(rows)], "doc_id bigint, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic").write.parquet(f"{path}/labels.parquet")
    some = [(i, t) for i, t in enumerate([None, "", "One", "no such words at all in any text"] + [" ".join(split(r[1])[3:20]) for r in rows[8:14]])]
    spark.createDataFrame(some, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)
