"""The language detector within rows, against its joined form."""

from pyspark.sql import functions as F

from millrace.operators import languages


def test_texts_are_compared_without_a_shuffle(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = languages.fit(docs, "text", "lang").localCheckpoint()
    got = languages.detect(docs, "doc_id", "text", model)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    one = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(languages, "BROADCAST_ROWS", 5)
    assert one == sorted(map(tuple, languages.detect(docs, "doc_id", "text", model).collect())) and any(r[1] for r in one)


def test_equal_gains_go_to_the_last_language(spark):
    model = spark.createDataFrame([(x, g, k) for x in ("aa", "bb") for k, g in enumerate(("e", " e"))], "language string, gram string, rank int")
    got = languages.detect(spark.createDataFrame([(1, "e " * 40)], "id long, text string"), "id", "text", model).filter(F.col("language").isNotNull())
    assert [r.language for r in got.collect()] == ["bb"]
