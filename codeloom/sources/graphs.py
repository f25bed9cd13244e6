"""Graph documents on disk and their normal form: one nodes table, one edges table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import GRAPH, LABEL

CORRUPT = "_corrupt_record"


def _read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line-wise JSON; blank lines and lines that are not an object are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    with_bad = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select(
        F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j")
    )
    return parsed.where(F.col(f"j.{CORRUPT}").isNull()).select(*[f"j.{f.name}" for f in schema.fields])


def read_graphs(
    spark: SparkSession, path: str, max_nodes: int | None = None, skip_large: bool = False
) -> DataFrame:
    graphs = _read_json_lines(spark, path, GRAPH)
    if skip_large and max_nodes is not None:
        graphs = graphs.where(F.coalesce(F.size("nodes"), F.lit(0)) <= 2 * max_nodes)
    return graphs


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with the class taken from ``label`` or else ``target``."""
    rows = _read_json_lines(spark, path, LABEL)
    return rows.withColumn("label", F.coalesce("label", "target").cast("int")).drop("target")


def graphs_of(graphs: DataFrame) -> DataFrame:
    """file, frameworks: one row per graph, empty ones too."""
    file = F.coalesce("file", F.try_element_at(F.col("nodes"), F.lit(1))["file"])
    rows = graphs.select(file.alias("file"), F.col("metadata.frameworks").alias("frameworks"))
    return rows.groupBy("file").agg(F.max("frameworks").alias("frameworks"))


def nodes_of(graphs: DataFrame) -> DataFrame:
    n = graphs.select("file", F.explode("nodes").alias("n"))
    span = F.when(
        F.size("n.span") == 4,
        F.struct(*[F.col("n.span")[i].alias(k) for i, k in enumerate(("sl", "sc", "el", "ec"))]),
    )
    return n.select(
        F.coalesce("file", "n.file").alias("file"), "n.id", "n.kind", span.alias("span"), "n.code",
        "n.symbol", "n.type_hint", "n.flags",
        F.coalesce("n.attrs", F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def edges_of(graphs: DataFrame) -> DataFrame:
    e = graphs.select("file", F.explode("edges").alias("e"))
    return e.select(
        "file", F.coalesce("e.src", "e.source").alias("src"), F.coalesce("e.dst", "e.target").alias("dst"),
        F.coalesce("e.kind", F.lit("AST")).alias("kind"), "e.attrs",
    )


def normal_edge_keys(edges: DataFrame) -> DataFrame:
    """source/target renamed to src/dst; where both spellings exist src/dst wins."""
    out = edges
    for key, other in (("src", "source"), ("dst", "target")):
        if other in edges.columns:
            value = F.coalesce(key, other) if key in edges.columns else F.col(other)
            out = out.withColumn(key, value).drop(other)
    return out


def edge_keys_for_export(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "source", "dst": "target"})


def graph_documents(
    nodes: DataFrame, edges: DataFrame, meta: DataFrame | None = None, max_items: int = 100_000,
    graphs: DataFrame | None = None,
) -> DataFrame:
    """Graphs as documents: one per file, and further ones for a file with more than ``max_items`` rows.

    ``graphs`` (file) names graphs without nodes and edges, which become empty documents.
    Readers explode documents, so a graph in several documents reads back as one graph, and no task
    ever holds more than about ``max_items`` nodes or edges of a file.
    """
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("file").agg(F.count(F.lit(1)).alias("e"))
    parts = n.join(e, "file", "full").select("file", F.ceil(F.greatest("n", "e") / max_items).alias("_parts"))

    def collected(rows, key, item, name):
        part = F.pmod(F.hash(*key), F.col("_parts"))
        return rows.join(parts, "file").groupBy("file", part.alias("part")).agg(F.collect_list(item).alias(name))

    span = F.array("span.sl", "span.sc", "span.el", "span.ec")
    node = F.struct("id", "kind", span.alias("span"), "code", "symbol", "type_hint", "flags", "attrs")
    docs = collected(nodes, [F.col("id")], node, "nodes").join(
        collected(edges, [F.col("src"), F.col("dst")], F.struct("src", "dst", "kind", "attrs"), "edges"),
        ["file", "part"], "full",
    )
    if graphs is not None:
        empty = graphs.select("file").distinct().join(parts, "file", "left_anti").withColumn("part", F.lit(0))
        docs = docs.unionByName(empty, allowMissingColumns=True)
    docs = docs.withColumn("nodes", F.array_sort("nodes", lambda a, b: F.signum(a["id"] - b["id"]).cast("int")))
    for name in ("nodes", "edges"):
        docs = docs.withColumn(name, F.coalesce(name, F.array().cast(docs.schema[name].dataType)))
    return docs if meta is None else docs.join(meta, "file", "left")


def write_graphs(documents: DataFrame, path: str, fmt: str = "json") -> None:
    documents.write.mode("append").format(fmt).save(path)


def write_splits(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").partitionBy("split").parquet(path)
