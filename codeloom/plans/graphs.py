"""The main jobs end to end: source tree to graph, records to training data, scan to findings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import corpus as C
from codeloom.operators import facts as FA
from codeloom.operators import features as FT
from codeloom.operators import findings as FN
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.operators import models as MD
from codeloom.operators import quality as Q
from codeloom.operators import taint as TA
from codeloom.operators import traverse as T
from codeloom.session import bucketed, cut_lineage, grown, spread
from codeloom.sources import files as FI
from codeloom.sources import graphs as GR
from codeloom.sources.catalogue import DEFAULT, Catalogue


# What the rule baseline reads of a fact.
BASELINE_FACTS = tuple(dict.fromkeys((*M.MATCH_FACTS, *G.EDGE_FACTS)))


def facts_of(files: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Syntax facts of (file, code), with the frameworks of each file."""
    return FA.extract_facts(M.with_frameworks(files), columns)


def stored_facts(files: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Facts written once, bucketed by file: the files are dealt before they are parsed, the facts never.

    Windows and groups whose keys hold the file then need no shuffle.
    """
    return bucketed(facts_of(spread(files, "file"), columns), ["file"], "facts", dealt=True)


def build_graphs(
    files: DataFrame, records: DataFrame | None = None, catalogue: Catalogue = DEFAULT, by_field: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and the files per status.

    The facts are written once to shared storage: parsing is the dear step and four rules read them.
    """
    facts = stored_facts(files, BASELINE_FACTS)
    nodes = M.matched_nodes(facts, catalogue)
    edges = G.graph_edges(facts, by_field)
    if records is not None:
        nodes = cut_lineage(nodes)
        recorded = TA.recorded_flow_edges(TA.mapped_records(records, nodes))
        edges = edges.unionByName(recorded.select(*edges.columns))
    return nodes, edges, FI.status_counts(facts)


def followed_facts(facts: DataFrame, catalogue: Catalogue = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Nodes of stored ``facts`` that match a rule, and the facts of files that hold a source and a sink, stored alike.

    No path leaves a file, so no other file is followed; three readers then share one join.
    """
    nodes = M.matched_nodes(facts, catalogue).select("file", "id", "attrs").where(F.size("attrs") > 0)
    nodes = cut_lineage(nodes)
    files = M.source_candidates(nodes).select("file").join(grown(M.sink_candidates(nodes).select("file")), "file", "left_semi").distinct()
    # the join deals its rows as the stored facts lie
    return nodes, bucketed(facts.join(grown(cut_lineage(files)), "file", "left_semi"), ["file"], "followed", dealt=True)


def followed_paths(nodes: DataFrame, followed: DataFrame, max_depth: int | None = None, witnesses: bool = False) -> DataFrame:
    """Sinks that a source reaches over the flow and value edges of ``followed``."""
    flows = G.flow_edges(followed).unionByName(G.value_edges(followed))
    return (T.tainted_witnesses if witnesses else T.tainted_paths)(nodes, flows, max_depth)


def rule_baseline(facts: DataFrame, max_depth: int | None = None, witnesses: bool = False, catalogue: Catalogue = DEFAULT) -> DataFrame:
    """Sinks of stored ``facts`` that a source reaches, with the distance or, as ``witnesses``, with the path.

    Edges are made of files only that hold a source and a sink, as no path leaves a file.
    """
    return followed_paths(*followed_facts(facts, catalogue), max_depth, witnesses)


def build_from_path(spark: SparkSession, root: str, out: str, catalogue: Catalogue = DEFAULT) -> DataFrame:
    """Scans a source tree and writes nodes and edges as Parquet; returns files per status."""
    files = FI.scan_source_files(spark, root)
    nodes, edges, status = build_graphs(files.where("status = 'ok'"), catalogue=catalogue)
    nodes.write.mode("overwrite").parquet(f"{out}/nodes")
    edges.write.mode("overwrite").parquet(f"{out}/edges")
    bad = files.where("status <> 'ok'").groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    return status.unionByName(bad)


def training_data(
    records: DataFrame, safe_files: DataFrame, out: str | None = None, safe_ratio: float = 0.3, seed: int = 42
) -> DataFrame:
    """Vulnerability records and safe files to balanced, split samples."""
    samples = C.training_samples(FI.version_rows(records), safe_files)
    keyed = samples.withColumn(
        "sample_id", F.sha2(F.concat_ws("|", "repo_url", "commit", "file_path", "sample_type"), 256)
    )
    split = C.split_by_position(
        C.balanced(keyed, safe_ratio, seed=seed).withColumn("sample_id", F.concat_ws("#", "sample_id", "copy")), seed=seed
    )
    if out is not None:
        GR.write_splits(split, out)
    return split


def validation_report(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """One row: graph sizes and rule coverage of a corpus; ``graphs`` (file) names empty graphs too."""
    return Q.size_statistics(Q.graph_sizes(nodes, edges, graphs)).crossJoin(  # one row each
        Q.rule_coverage(nodes, graphs).drop("graphs")
    )


def scan_findings(
    nodes: DataFrame, weights: list[float], bias: float, k: int = 5, dims: int = 64, catalogue: Catalogue = DEFAULT
) -> DataFrame:
    """Scored files with their best source-sink pair and the pattern it points to, the k best files."""
    # all vectors are pooled where they are made and never written; only those of nodes that match a rule are kept
    texts = nodes.select("file", "id", "attrs", "code")
    pooled = FT.pooled_vectors(MD.embedded_nodes(texts, None, "code", dims), ["file"], dims=dims)
    vectors = cut_lineage(MD.embedded_nodes(texts.where(F.size("attrs") > 0), None, "code", dims).drop("code"))
    scored = MD.linear_scores(pooled, weights, bias).drop("pooled")
    s = MD.pair_parts(M.source_candidates(vectors), weights, "source")
    t = MD.pair_parts(M.sink_candidates(vectors), weights, "sink")
    best = FT.top_pairs(s, t, 1)
    # both ends have matched a rule, so no other node is looked up
    ends = FT.flow_end_attributes(best.withColumnRenamed("score", "pair_score"), nodes.where(F.size("attrs") > 0))
    pattern = M.inferred_pattern(
        F.col("source_rule"), F.col("sink_rule"), F.col("sink_kind"), F.col("sink_code"), catalogue
    )
    found = scored.join(grown(ends), "file", "left").withColumn("pattern_id", pattern["pattern_id"])
    found = FN.with_pattern_info(found, catalogue.pattern_table(nodes.sparkSession))
    return FN.top_findings(found.where("is_vulnerable"), k, "file")
