"""Embeddings, scorers and baselines behind plain functions, so any model can be plugged in."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.corpus import split_by_project
from codeloom.session import grown

DIMENSIONS = 768
CHUNK = 32


def code_tokens(code: Column) -> Column:
    """Words and single symbols of a text."""
    return F.regexp_extract_all(code, F.lit(r"(\w+|[^\w\s])"), F.lit(1))


def hashed_embedding(rows: DataFrame, code: str = "code", out: str = "vec", dims: int = DIMENSIONS) -> DataFrame:
    """Default embedder: hashed token counts, a zero vector for blank code.  Runs in the JVM."""
    tokens = rows.withColumn("_tokens", code_tokens(F.coalesce(F.col(code), F.lit(""))))
    tf = HashingTF(numFeatures=dims, inputCol="_tokens", outputCol="_tf")
    return tf.transform(tokens).withColumn(out, vector_to_array("_tf", "float32")).drop("_tokens", "_tf")


def chunked_embedder(embed: Callable[[list[str]], list[list[float]]], dims: int = DIMENSIONS, chunk: int = CHUNK):
    """A pandas UDF around a model that embeds texts in chunks; blank texts get zeros."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            texts = [c if c and c.strip() else "" for c in codes]
            out = [[0.0] * dims] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for at in range(0, len(full), chunk):
                part = full[at : at + chunk]
                for i, v in zip(part, embed([texts[i] for i in part])):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return run


def embedded_codes(nodes: DataFrame, embedder=None, code: str = "code", dims: int = DIMENSIONS) -> DataFrame:
    """code_sha, vec for every distinct text: equal texts are embedded once."""
    sha = F.sha2(F.encode(F.coalesce(F.col(code), F.lit("")), "UTF-8"), 256)
    distinct = nodes.select(sha.alias("code_sha"), F.coalesce(F.col(code), F.lit("")).alias(code))
    # equal digests have equal texts, so any one of them will do
    distinct = distinct.groupBy("code_sha").agg(F.first(code).alias(code))
    if embedder is None:
        return hashed_embedding(distinct, code, dims=dims).select("code_sha", "vec")
    return distinct.select("code_sha", embedder(F.col(code)).alias("vec"))


def embedded_nodes(nodes: DataFrame, embedder=None, code: str = "code", dims: int = DIMENSIONS) -> DataFrame:
    """Nodes with the vector of their code.

    The default embedder is an expression that costs less than a shuffle, so it runs where the nodes lie; for any other, equal texts
    are embedded once.
    """
    if embedder is None:
        kept = nodes.withColumn("_text", F.coalesce(F.col(code), F.lit("")))
        return hashed_embedding(kept, "_text", dims=dims).drop("_text")
    sha = F.sha2(F.encode(F.coalesce(F.col(code), F.lit("")), "UTF-8"), 256)
    return nodes.withColumn("code_sha", sha).join(
        grown(embedded_codes(nodes, embedder, code, dims)), "code_sha"
    ).drop("code_sha")


def dot(vector: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def linear_scores(pooled: DataFrame, weights: list[float], bias: float = 0.0, vector: str = "pooled") -> DataFrame:
    """Adds p_vulnerable, is_vulnerable and confidence (the larger class probability)."""
    p = 1 / (1 + F.exp(-(dot(F.col(vector), weights) + bias)))
    return (
        pooled.withColumn("p_vulnerable", p).withColumn("is_vulnerable", F.col("p_vulnerable") > 0.5)
        .withColumn("confidence", F.greatest("p_vulnerable", 1 - F.col("p_vulnerable")))
    )


def scored_graphs(pooled: DataFrame, score: Callable[[list[list[float]]], list[float]], vector: str = "pooled") -> DataFrame:
    """Scores pooled vectors with any model that maps a batch of vectors to probabilities."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(score([list(v) for v in vectors]), dtype="float64")

    return (
        pooled.withColumn("p_vulnerable", run(F.col(vector)))
        .withColumn("is_vulnerable", F.col("p_vulnerable") > 0.5)
        .withColumn("confidence", F.greatest("p_vulnerable", 1 - F.col("p_vulnerable")))
    )


def pair_parts(vectors: DataFrame, weights: list[float], side: str) -> DataFrame:
    """(file, id, part): a node's share of a linear score on the concatenated pair vector."""
    half = len(weights) // 2
    w = weights[:half] if side == "source" else weights[half:]
    return vectors.select("file", "id", dot(F.col("vec"), w).alias("part"))


def scored_pairs(
    pairs: DataFrame, vectors: DataFrame, score: Callable[[list[list[float]], list[list[float]]], list[float]]
) -> DataFrame:
    """Adds score to a GIVEN table of pairs (file, source_id, sink_id): any model over source and sink vectors.

    ``vectors`` holds (file, id, vec); ``score`` maps a batch of source and sink vectors to probabilities.  Recorded flows or the
    best linear candidates are such tables; all pairs of a graph are never formed.
    """
    v = vectors.select(F.col("file").alias("_file"), F.col("id").alias("_id"), F.col("vec").alias("_vec"))
    at = lambda side: F.col("file").eqNullSafe(F.col("_file")) & (F.col(side) == F.col("_id"))
    both = pairs.join(v, at("source_id")).withColumn("_source", F.col("_vec")).drop("_file", "_id", "_vec")
    both = both.join(v, at("sink_id")).withColumn("_sink", F.col("_vec")).drop("_file", "_id", "_vec")

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(score([list(x) for x in a], [list(x) for x in b]), dtype="float64")

    return both.withColumn("score", run("_source", "_sink")).drop("_source", "_sink")


def held_out(samples: DataFrame, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame], project: str) -> DataFrame:
    """Scored rows of the val and test projects of a model fitted on the train projects alone."""
    rows = split_by_project(samples, project)
    return score(fit(rows.where("split = 'train'")), rows.where("split <> 'train'"))


def logistic_baseline(samples: DataFrame, vector: str = "vec", label: str = "label", iterations: int = 20):
    """Fitted logistic regression on embeddings."""
    rows = samples.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations, regParam=0.01).fit(rows)


def forest_baseline(samples: DataFrame, code: str = "code", label: str = "label", trees: int = 20, dims: int = 256):
    """Fitted random forest on hashed tokens."""
    rows = hashed_embedding(samples, code, "_v", dims)
    rows = rows.select(array_to_vector("_v").alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=6, seed=7).fit(rows)


def with_predictions(model, samples: DataFrame, vector: str) -> DataFrame:
    rows = model.transform(samples.withColumn("features", array_to_vector(vector)))
    return rows.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")
