"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of
    our own is made and recorded there, but only if all of Spark runs on this machine:
    elsewhere executors would write to disks that no one else reads, so it is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    A table is computed once, by ``put``, and read back; ``drop`` removes tables
    that later steps no longer read. What is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete(self.spark, self.root)
            except Exception:  # the JVM may be gone at exit
                pass
