"""Stems come in bounded batches."""

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.session import BATCH_KEY


def test_stems_bound_their_batches(spark):
    spark.conf.set(BATCH_KEY, str(64 << 20))
    got = spark.createDataFrame([("Running dogs",), (None,)], "c string").select(text.tokens(F.col("c"), []).alias("t")).collect()
    assert [r.t for r in got] == [["run", "dog"], []] and int(spark.conf.get(BATCH_KEY)) <= 1 << 20
