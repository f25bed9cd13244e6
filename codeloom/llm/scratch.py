"""Intermediate tables in the shared folder, dropped when they are no longer needed."""

import gc

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import scratch_path


class Scratch:
    """Tables that one operator writes on its way.

    A written table cuts the lineage, survives lost executors and is computed once.  What the result
    still reads has to stay; everything else is dropped as soon as its last reader has been written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self._release()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path, _ = self.paths.pop(id(df))
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _release(self) -> None:
        """Shuffle files of finished jobs go when the driver has forgotten their plans."""
        gc.collect()
        self.spark._jvm.System.gc()
