import zlib

import corpus_pipeline


def test_mislabelled_documents_are_rejected(spark, sf):
    """Short and long texts declared in another language go; the same ones in their own stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = docs.collect()
    other = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    # a word said over and over is not planted: it need not look like its language
    some = [(r["text"].split(), r["lang"]) for r in rows if len(r["text"].split()) >= 60 and len(set(r["text"].split()[:14])) >= 10]
    free = (i for i in range(10**6, 10**7) if zlib.crc32(str(i).encode()) % 4 == 2)  # not learned from
    plants = [(next(free), " ".join(words[:n]), lang if right else other[lang], n == 14, right) for words, lang in some for n in (14, None) for right in (True, False)]
    more = spark.createDataFrame([(i, text, lang, "s", len(text)) for i, text, lang, *_ in plants], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= got
    for short in (True, False):
        right = [i for i, *_, s, ok in plants if s == short and ok]
        wrong = [i for i, *_, s, ok in plants if s == short and not ok]
        assert len(wrong) > 40
        assert [i for i in right if i not in got] == []
        assert sum(i not in got for i in wrong) >= 0.95 * len(wrong)
