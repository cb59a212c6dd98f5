"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without one a local session gets a temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows and bytes of the batches that go to Python, at most: texts are long, and each task holds a batch on both sides.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Whether an execution's shuffle files go as it ends, instead of when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """Holds a setting of the session meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _bound_batches(spark: SparkSession, most_bytes: int) -> None:
    """Lowers the session's batch limits to these; lower ones stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", most_bytes)):
        key = f"spark.sql.execution.arrow.{key}"
        set_ = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not set_ or not 0 < int(set_[1]) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Writes DataFrames as Parquet under the shared folder and reads them back.

    A written table cuts lineage in one pass and survives lost executors. Tables stay until ``drop``
    is called for them, or until the application's folder is removed (``clear``) once the results
    that read them have been written.
    """

    def __init__(self, spark: SparkSession, name: str, batch_bytes: int = BATCH_BYTES) -> None:
        self.spark = spark
        _bound_batches(spark, batch_bytes)
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, group_bytes: int | None = None) -> DataFrame:
        """group_bytes: of row groups, and so of what a reader holds at once, where rows are long."""
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        groups = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
        with setting(self.spark, _CLEANUP, "true"):  # nothing reads the write's shuffle files after it
            df.write.options(**groups).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)

    def clear(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
