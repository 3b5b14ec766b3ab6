"""What a pass of the sparse SVD moves doesn't grow with the number of files or rows."""

import numpy as np

from millrace.operators import sparse
from millrace.session import Scratch


def test_a_pass_has_as_many_sums_as_cores(spark):
    rng, columns = np.random.default_rng(0), 700
    x = rng.normal(size=(96, columns)) * (rng.random((96, columns)) < 0.05)
    rows = spark.createDataFrame([(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)], sparse.LAYOUT)
    saved, w = Scratch(spark, "test-sparse").save(rows.repartition(48), "rows"), rng.normal(size=(columns, 5))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert saved.rdd.getNumPartitions() > sparse.PARTS
        spark.sparkContext.setJobGroup("pass", "pass")
        got = sparse.gram_times(saved, w)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert np.allclose(got, x.T @ (x @ w))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("pass") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= max(sparse.PARTS, spark.sparkContext.defaultParallelism)
