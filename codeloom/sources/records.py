"""Scans and sinks of corpus records, inference results, reports and statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import text as X
from codeloom.functions.hold import held
from codeloom.schemas import PREDICTION, SAFE_FILE, VULN_RECORD

COMMIT = T.StructType(
    [
        T.StructField("sha", T.StringType()),
        T.StructField(
            "commit",
            T.StructType(
                [
                    T.StructField("message", T.StringType()),
                    T.StructField(
                        "author",
                        T.StructType(
                            [T.StructField("name", T.StringType()), T.StructField("date", T.StringType())]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "repository",
            T.StructType(
                [T.StructField(n, T.StringType()) for n in ("html_url", "url", "full_name")]
            ),
        ),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("filename", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("additions", T.IntegerType()),
                        T.StructField("deletions", T.IntegerType()),
                        T.StructField("patch", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("parents", T.ArrayType(T.StructType([T.StructField("sha", T.StringType())]))),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_vuln_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VULN_RECORD).option("mode", "DROPMALFORMED").json(path)


def read_safe_files(spark: SparkSession, path: str) -> DataFrame:
    """Safe-file records; a missing folder reads as an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SAFE_FILE)
    return spark.read.schema(SAFE_FILE).option("mode", "DROPMALFORMED").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Inference results from files that hold one object or an array of objects."""
    return spark.read.schema(PREDICTION).option("multiLine", True).json(path)


def parse_commits(feed: DataFrame, column: str = "value") -> DataFrame:
    """Landed commit feed (one JSON object per row) to structured commits.

    Rows without sha, message, author or repository are dropped.
    """
    j = held(feed.select(column), j=F.from_json(column, COMMIT)).select("j.*")
    message = F.col("commit.message")
    whole = (
        F.col("sha").isNotNull() & message.isNotNull() & F.col("commit.author.name").isNotNull()
        & F.col("commit.author.date").isNotNull() & F.col("repository").isNotNull()
    )
    return j.where(whole).select(
        "sha", message.alias("message"), F.col("commit.author.name").alias("author"),
        F.col("commit.author.date").alias("date"),
        F.coalesce(F.nullif("repository.html_url", F.lit("")), "repository.url", F.lit("")).alias("repo_url"),
        F.coalesce("repository.full_name", F.lit("")).alias("repo_name"),
        X.cve_id(message).alias("cve_id"), X.cwe_id(message).alias("cwe_id"),
        X.vulnerability_type(message).alias("vulnerability_type"), "files",
        F.try_element_at(F.col("parents.sha"), F.lit(1)).alias("parent_sha"),
    )


def changed_python_files(commits: DataFrame) -> DataFrame:
    """One row per changed .py file that was not removed."""
    rows = commits.select(*[c for c in commits.columns if c != "files"], F.inline("files"))
    return rows.where(
        F.endswith(F.col("filename"), F.lit(".py")) & ~F.col("status").eqNullSafe("removed")
    ).withColumnRenamed("filename", "file_path")


def paired_versions(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Vulnerability records: each changed file with its text before and after the commit.

    ``contents`` holds (repo_name, sha, file_path, code); both sides have to exist and be non-empty.
    """
    full = contents.where(F.length("code") > 0)
    after = full.select("repo_name", "sha", "file_path", F.col("code").alias("code_after"))
    before = full.select(
        "repo_name", F.col("sha").alias("parent_sha"), "file_path", F.col("code").alias("code_before")
    )
    two_part = F.size(F.split("repo_name", "/")) == 2
    return (
        changes.where(two_part & F.col("parent_sha").isNotNull())
        .join(after, ["repo_name", "sha", "file_path"])
        .join(before, ["repo_name", "parent_sha", "file_path"])
        .select(
            "cve_id", "cwe_id", "repo_url", F.col("parent_sha").alias("commit_before"),
            F.col("sha").alias("commit_after"), "file_path",
            X.whole_file_range(F.col("code_before")).alias("line_range_before"),
            X.whole_file_range(F.col("code_after")).alias("line_range_after"),
            F.coalesce("vulnerability_type", F.lit("Unknown")).alias("vulnerability_type"),
            X.truncated_message(F.col("message")).alias("description"), "code_before", "code_after",
        )
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines with their file path, one folder per job."""
    rows = reports.select("job_id", "fingerprint", report_path().alias("path"), "markdown")
    rows.write.mode("overwrite").partitionBy("job_id").json(path)


def report_path(job: str = "job_id", fingerprint: str = "fingerprint"):
    return F.concat(F.lit("reports/"), F.col(job), F.lit("/"), F.col(fingerprint), F.lit(".md"))


def report_file_name(ts, file):
    return F.concat(
        F.lit("vulnerability_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"),
        X.safe_file_name(file), F.lit(".md"),
    )
