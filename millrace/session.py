"""Session helpers shared by every part of the engine: table access and shared scratch space."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where that is unset on one
    machine (tests) a temporary folder is made and set as the session's own; on a cluster it must be set."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_KEY} isn't set: name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, with underscores before it until no column of `df` has that name (by Spark's rules, in any case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


class _Cleanup:
    """Sessions whose jobs remove their shuffle files when they end, for as long as any write asks for it."""

    def __init__(self):
        self.lock, self.open = threading.Lock(), {}

    def enter(self, spark: SparkSession) -> None:
        with self.lock:
            n, before = self.open.get(id(spark), (0, None))
            if not n:
                before = spark.conf.get(CLEANUP_KEY, "false")
                spark.conf.set(CLEANUP_KEY, "true")
            self.open[id(spark)] = (n + 1, before)

    def leave(self, spark: SparkSession) -> None:
        with self.lock:
            n, before = self.open[id(spark)]
            if n > 1:
                self.open[id(spark)] = (n - 1, before)
            else:
                del self.open[id(spark)]
                spark.conf.set(CLEANUP_KEY, before)


_cleanup = _Cleanup()


class Scratch:
    """Tables written below the shared folder to cut lineage. They survive lost executors, are
    dropped when told to, and at the latest when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int = 4 << 20):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)
        bound_batches(spark, batch_bytes)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as a table and read it back; the shuffle files of the job go with its end."""
        _cleanup.enter(self.spark)
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            _cleanup.leave(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def bound_batches(spark: SparkSession, batch_bytes: int) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to `batch_bytes`, so that long texts don't
    pile up in a Python worker. It is read when a job starts, which may be after the caller has returned,
    and so stays; it is never raised, and no result depends on it."""
    now = spark.conf.get(BATCH_KEY, None)
    if now is None or not 0 < _bytes(now) <= batch_bytes:
        spark.conf.set(BATCH_KEY, str(batch_bytes))


def _bytes(size: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = size.strip().lower().rstrip("b")
    return int(digits[:-1]) * units[digits[-1]] if digits and digits[-1] in units else int(digits or 0)
