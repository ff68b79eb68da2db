"""Stages judge rows, not ids: several texts under one id, repeated rows, leaks without an id."""

import corpus_pipeline

A = "the lamp in the old harbour was lit by hand every evening until the keeper moved to town"
B = "a second text under the same number that nobody else has copied in any other place so far"


def rows(spark, *pairs):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates(spark, small):
    docs = rows(spark, (1, A), (2, A), (2, B), (3, B + " now"), (4, "alone"), (4, "alone"), (None, A))
    assert left(corpus_pipeline.drop_near_duplicates(spark, docs, small)) == sorted([(1, A), (2, B), (4, "alone"), (None, A)], key=str)


def test_leaks(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    docs = rows(spark, (1, item), (1, A), (None, item), (None, B))
    assert left(corpus_pipeline.drop_leaks(spark, docs, small)) == sorted([(1, A), (None, B)], key=str)
