"""Scans of source trees and of stored code and graphs."""

import os
import uuid
from fnmatch import fnmatchcase
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import spread

# What a task hands on at once when it lists or reads files.
NAMES_PER_BATCH = 4096
BYTES_PER_BATCH = 8 << 20
NO_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_source_tree(rows: DataFrame, folder: str, text: str, root: str, suffix: str = ".txt") -> None:
    """One folder ``folder=<value>`` below ``root`` per value, with one file of its texts, each ended by a line feed.

    Hadoop's local file system starts a chmod process for every file, so there the tasks write the files themselves: a file is written
    aside and then takes its name, so a task that runs again changes nothing.  Other file systems take Spark's own writer.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(folder).alias("folder"), F.col(text).alias("text")).repartition("folder")
    base = _local_path(spark, root)
    if base is None:
        own.write.partitionBy("folder").option("lineSep", "\n").text(root)
        return
    os.makedirs(base)

    def run(batches):
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        n = 0
        for name, group in groupby(pairs, lambda pair: pair[0]):
            at = f"{base}/folder={NO_FOLDER if name is None else name}"
            os.makedirs(at, exist_ok=True)
            aside = f"{base}/.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{t or ''}\n" for _, t in group)
            os.replace(aside, f"{at}/part-0{suffix}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    own.sortWithinPartitions("folder").mapInArrow(run, "files bigint").agg(F.sum("files")).first()


def _local_path(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` on the local file system; null on any other, and for a path with wildcards."""
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    place = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return place.getPath() if place.getScheme() == "file" and not set(root) & set("*?[{") else None


def _local_files(spark: SparkSession, base: str, pattern: str) -> DataFrame:
    """path, content of the files below ``base``: one task names what lies in it, in batches, and the tasks walk and read from there.

    As in Spark's reader, empty files are passed over, and names that begin with a dot, or with an underscore and hold no equals sign.
    """

    def seen(name):
        return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))

    def entries(_):
        names = []
        with os.scandir(base) as found:
            for entry in found:
                if seen(entry.name):
                    names.append(entry.name)
                if len(names) == NAMES_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])
                    names = []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    def below(path):
        if not os.path.isdir(path):
            if fnmatchcase(os.path.basename(path), pattern) and os.path.getsize(path):
                yield path
            return
        for name in sorted(os.listdir(path)):
            if seen(name):
                yield from below(f"{path}/{name}")

    def contents(batches):
        paths, texts, size = [], [], 0
        for path in (p for b in batches for name in b.column(0).to_pylist() for p in below(f"{base.rstrip('/')}/{name}")):
            with open(path, "rb") as f:
                texts.append(f.read())
            paths.append(f"file:{path}")
            size += len(texts[-1])
            if size >= BYTES_PER_BATCH or len(paths) == NAMES_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])
                paths, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])

    names = spark.range(1, numPartitions=1).mapInArrow(entries, "name string")
    return spread(names, "name").mapInArrow(contents, "path string, content binary")


def scan_source_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """file, code, status for every file of the pattern below ``root`` outside __pycache__.

    Files that are not UTF-8 stay in the result with status 'undecodable', so they can be counted.  On a local file system the tasks
    list the folders, as Spark's own reader keeps the status of every file in the driver; other file systems take that reader.
    """
    base = _local_path(spark, root)
    if base is not None and os.path.isdir(base) and not set(pattern) & set("[]{}\\"):
        raw = _local_files(spark, base, pattern)
    else:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    raw = raw.where(~F.contains(F.col("path"), F.lit("/__pycache__/")))
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return raw.select(
        F.col("path").alias("file"),
        F.when(ok, F.regexp_replace(text, "\r\n?", "\n")).alias("code"),
        F.when(ok, "ok").otherwise("undecodable").alias("status"),
    )


def status_counts(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Files per status; facts hold one row with id 1 for a parsed file, one row for a failed one."""
    parsed = facts.where((F.col("status") != "ok") | (F.col("id") == 1)).select("status")
    if files is not None:
        parsed = parsed.unionByName(files.where(F.col("status") != "ok").select("status"))
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (file, content) pair has no stored graph yet."""
    now = current.withColumn("content_sha", F.sha2(F.encode("code", "UTF-8"), 256))
    return now.join(stored.select("file", "content_sha").distinct(), ["file", "content_sha"], "left_anti")


def refresh_graphs(stored: DataFrame, rebuilt: DataFrame, current: DataFrame) -> DataFrame:
    """Stored graphs that are still current, plus the rebuilt ones."""
    now = current.select("file", F.sha2(F.encode("code", "UTF-8"), 256).alias("content_sha"))
    kept = stored.join(now, ["file", "content_sha"], "left_semi")
    return kept.unionByName(rebuilt, allowMissingColumns=True)


def version_rows(records: DataFrame) -> DataFrame:
    """Two rows per vulnerability record, before and after, keyed by commit, stem and version."""
    shared = [
        c for c in records.columns
        if c not in ("commit_before", "commit_after", "code_before", "code_after")
    ]
    name = F.element_at(F.split("file_path", "/"), -1)
    versions = F.array(
        *[
            F.struct(
                F.lit(v).alias("version"),
                F.col(f"commit_{v}").alias("commit"),
                F.col(f"code_{v}").alias("code"),
            )
            for v in ("before", "after")
        ]
    )
    return (
        records.select(*shared, F.inline(versions))
        .withColumn("stem", F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
        .withColumn("graph_key", F.concat_ws("_", "commit", "stem", "version"))
        .withColumn("code_file", F.concat_ws("_", "commit", name, F.concat("version", F.lit(".py"))))
    )


def attach_graphs(versions: DataFrame, graphs: DataFrame) -> DataFrame:
    """Version rows with their graph, by (commit, stem, version)."""
    return versions.join(graphs, ["commit", "stem", "version"], "inner")
