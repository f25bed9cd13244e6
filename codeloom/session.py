"""Session construction and lineage cutting."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "codeloom", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="codeloom-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes the rows to shared storage and goes on from there.

    Losing executors then costs nothing that came before.  Parquet instead of checkpoint(): later
    steps read only the columns they need, and the planner knows the true size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = (path, None)
    return out


def bucketed(df: DataFrame, keys: list[str], label: str = "table", dealt: bool = False) -> DataFrame:
    """Writes the rows bucketed by ``keys``, so that later joins, windows and groups on them do not shuffle this side.

    ``dealt`` says that the rows already lie in hash partitions by the keys, one per bucket.
    """
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", buckets(spark)
    if not dealt:
        df = df.repartition(n, *keys)  # one file per bucket
    path = scratch_path(spark, label)
    # a task's rows all go to one bucket, so its file can stay open: without this, Spark sorts the rows by their bucket first
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        df.write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(writers, before)
    out = spark.table(name)
    out._written = (path, name)
    return out


def grown(df: DataFrame) -> DataFrame:
    """One side of a join of two tables that grow with the input: the join is sorted, never broadcast.

    The planner sizes a table by its files, and facts and edges of similar sources pack to a small part of their rows, so it would
    send tables of many million rows through the driver to every task.
    """
    return df.hint("merge")


def drop_tables(*tables: DataFrame) -> None:
    """Removes what ``cut_lineage`` and ``bucketed`` wrote, after its last reader has run."""
    for df in tables:
        path, name = df.__dict__.pop("_written", (None, None))
        if name is not None:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path is not None:
            delete(df.sparkSession, path)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(keys: list[str], *tables: DataFrame, each: int = 1 << 19) -> list[DataFrame]:
    """Tables that are to be joined by ``keys`` in hash partitions of about ``each`` rows of the largest, so a task's memory does not grow with them."""
    n = max(buckets(tables[0].sparkSession), *(-(-t.count() // each) for t in tables))
    return [t.repartition(n, *keys) for t in tables]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows with work that is dear per row over the tasks, by hash of the key."""
    return df.repartition(buckets(df.sparkSession), F.col(key))
