"""Weak signals: static-analyser results per file, their scores, and how they attach to graphs and labels."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.signals import risk_score, severity_score

RESULTS = "file string, test_id string, severity string"


def analysed_files(files: DataFrame, analyse: Callable[[str, str], list[tuple[str, str]]]) -> DataFrame:
    """Results (file, test_id, severity) of any analyser that takes a file's name and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, t, s) for f, c in zip(pdf["file"], pdf["code"]) for t, s in analyse(f, c)]
            yield pd.DataFrame(rows, columns=["file", "test_id", "severity"])

    return files.select("file", "code").mapInPandas(run, RESULTS)


def rule_results(nodes: DataFrame) -> DataFrame:
    """Results of the rule catalogue itself: a sink whose constraint holds is HIGH, another one LOW."""
    a = F.col("attrs")
    severity = F.when(a["sink_constraint_failed"] == "true", "LOW").otherwise("HIGH")
    return nodes.where(a["is_sink"] == "true").select("file", a["sink_id"].alias("test_id"), severity.alias("severity"))


def analyser_signals(results: DataFrame) -> DataFrame:
    """file, bandit_score, bandit_rules, HIGH, MEDIUM, LOW from rows (file, test_id, severity)."""
    sev = F.upper(F.col("severity"))
    return results.groupBy("file").agg(
        F.max(severity_score(F.col("severity"))).alias("bandit_score"),
        F.array_sort(F.collect_set(F.nullif("test_id", F.lit("")))).alias("bandit_rules"),
        *[F.count_if(sev == s).alias(s) for s in ("HIGH", "MEDIUM", "LOW")],
    )


def attached_signals(graphs: DataFrame, signals: DataFrame) -> DataFrame:
    """Graph rows (file, patched, is_post_patch, synthetic) with a weak_signals struct."""
    j = graphs.join(signals, "file", "left")
    score = F.coalesce("bandit_score", F.lit(0.0))
    risk = risk_score(score, F.col("patched"), F.col("is_post_patch"), F.col("synthetic"))
    counts = F.create_map(*[x for s in ("HIGH", "MEDIUM", "LOW") for x in (F.lit(s), F.coalesce(s, F.lit(0).cast("bigint")).cast("int"))])
    return j.withColumn(
        "weak_signals",
        F.struct(
            risk.alias("risk_score"), score.alias("bandit_score"),
            F.coalesce("bandit_rules", F.array().cast("array<string>")).alias("bandit_rules"),
            F.col("patched").alias("patched_flag"), F.col("synthetic").alias("synthetic_flag"),
            F.when(F.col("patched"), F.col("is_post_patch")).alias("is_post_patch"),
            counts.alias("severity_counts"),
        ),
    ).select(*graphs.columns, "weak_signals")


def label_entries(with_signals: DataFrame) -> DataFrame:
    """code_id, risk_score, metadata as stored in a label file."""
    return with_signals.select(
        F.col("file").alias("code_id"), F.col("weak_signals.risk_score").alias("risk_score"),
        F.col("weak_signals").dropFields("risk_score").alias("metadata"),
    )
