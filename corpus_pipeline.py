"""The corpus pipeline: documents in, a clean, deduplicated, decontaminated and mixed corpus out."""

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.decontaminate import clean_documents
from codeloom.llm.mixing import mixed_documents
from codeloom.llm.quality_rules import keep_good
from codeloom.llm.scratch import Scratch
from codeloom.llm.simhash import keep_one_of_each
from codeloom.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules or the base test reject go; the others stay whole."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 250 bytes or more (passages of over 50 words) that occur again go from the texts; texts of which nothing is left go."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target; a document comes as often as it is taken."""
    return mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup),
    ("decontamination", decontamination), ("source_mix", source_mix),
]

# Components, suffix arrays, the latent space and sampling cannot be said in SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
