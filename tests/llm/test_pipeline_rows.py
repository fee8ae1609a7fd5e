import random

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))


def rows_of(spark, pairs):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in pairs], SCHEMA)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_dedup_tells_rows_by_id_and_text(spark):
    a, b, c, d = (prose(60, i) for i in range(4))
    pairs = [(7, a), (7, b), (9, b + " end"), (None, c), (None, c), (None, c + " end"), (8, a), (4, d), (4, d), (None, d), (None, " ,"), (None, " ")]
    out = kept(corpus_pipeline.near_dedup(spark, rows_of(spark, pairs), ""))
    left = [t for i, t in out if i is None and t.startswith(c)]
    assert len(left) == 1
    assert out == sorted([(7, a), (7, b), (4, d), (None, left[0]), (None, " ,"), (None, " ")], key=repr)


def test_decontamination_tells_rows_by_id_and_text(spark, tmp_path):
    a, b, item = prose(60, 1), prose(60, 2), prose(20, 3)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = [(None, f"{a} {item} {b}"), (None, a), (5, f"{b} {item}"), (5, b)]
    assert kept(corpus_pipeline.decontamination(spark, rows_of(spark, pairs), str(tmp_path))) == sorted([(None, a), (5, b)], key=repr)
