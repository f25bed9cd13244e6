"""Traversal and reshaping of graphs.

Node keys are (file, id); a repository-wide graph simply has one file value.
"""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.operators.matching import sink_candidates, source_candidates
from codeloom.operators.ordered import by_value, number_rows
from codeloom.operators.reach import shortest, witness_paths
from codeloom.session import bucketed, buckets, cut_lineage, drop_tables, grown

# Edge kind codes.
EDGE_CODES = {"AST": 0, "CFG": 1, "DFG": 2, "DDFG": 3}
# Links of a node that a task joins at once, on either side.
SLICE = 4096


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once, without loops."""
    ways = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )
    rows = edges.where(F.col("src") != F.col("dst")).select("file", F.inline(ways))
    return rows.select("file", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 3) -> DataFrame:
    """Undirected k-hop neighbourhood of the seeds with the distance of every node; without a limit, everything connected.

    A limit is a number of rounds: the links are stored bucketed by (file, src), so a step shuffles its frontier and never the
    links, and what a node's neighbours bring is new unless it was found in the last two rounds.
    """
    links = undirected(edges)
    if max_depth is None:
        return shortest(links, seeds)
    links = bucketed(links, ["file", "src"], "links")
    rounds = [cut_lineage(seeds.select("file", "id").distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, max_depth + 1):
        ask = rounds[-1].select("file", F.col("id").alias("src"))
        found = links.join(ask, ["file", "src"]).select("file", F.col("dst").alias("id")).distinct()
        for seen in rounds[-2:]:
            found = found.join(seen, ["file", "id"], "left_anti")
        rounds.append(cut_lineage(found.withColumn("depth", F.lit(depth))))
        if rounds[-1].isEmpty():
            break
    drop_tables(links)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def reachable(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, blocked: DataFrame | None = None
) -> DataFrame:
    """Nodes reached along edge direction; paths do not pass through ``blocked`` nodes."""
    return shortest(_unblocked(edges, blocked), seeds, max_depth)


def _unblocked(edges: DataFrame, blocked: DataFrame | None) -> DataFrame:
    links = edges.where(F.col("src") != F.col("dst")).select("file", "src", "dst")
    if blocked is None:
        return links
    return links.join(grown(blocked.select("file", F.col("id").alias("src"))), ["file", "src"], "left_anti")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept nodes and the edges with both ends kept."""
    k = kept.select("file", "id").distinct()
    n = nodes.join(k, ["file", "id"], "left_semi")
    e = edges.join(k.withColumnRenamed("id", "src"), ["file", "src"], "left_semi")
    e = e.join(k.withColumnRenamed("id", "dst"), ["file", "dst"], "left_semi")
    return n, e.select(*edges.columns)


def first_nodes(nodes: DataFrame, max_nodes: int) -> DataFrame:
    """The first ``max_nodes`` nodes of every graph, limited per task before the shuffle."""
    rn = F.row_number().over(W.partitionBy("file").orderBy("id"))
    return nodes.withColumn("_rn", rn).where(F.col("_rn") <= max_nodes).drop("_rn")


def truncated(nodes: DataFrame, edges: DataFrame, max_nodes: int = 1000) -> tuple[DataFrame, DataFrame]:
    kept = first_nodes(nodes, max_nodes)
    return kept, induced_subgraph(kept, edges, kept)[1]


def two_hop(edges: DataFrame) -> DataFrame:
    """Undirected graph of the edges and the directed two-step paths, each pair once, no loops.

    A hub of n edges in and out makes n^2 pairs, which is the result's own size; ``truncated`` bounds graphs
    first where that is wanted.  A pair with an end that has one neighbour alone is found through that neighbour only, so these
    pairs leave the join as they are; only the pairs between other nodes are shuffled to be told apart.
    """
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("mid"), F.lit(True).alias("goes")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("mid"), F.lit(False).alias("goes")),
    )
    links = edges.select("file", "src", "dst").where(F.col("src") != F.col("dst")).distinct()
    near = links.where(F.col("file").isNotNull()).select("file", F.inline(ends)).groupBy("file", "id", "mid").agg(
        F.max("goes").alias("goes"), F.max(~F.col("goes")).alias("comes")
    )
    near = cut_lineage(near, "near")
    lone = near.groupBy("file", "id").agg((F.count(F.lit(1)) == 1).alias("lone"))
    slices = near.groupBy("file", "mid").agg(F.count_if("goes").alias("ins"), F.count_if("comes").alias("outs")).where("ins > 0 AND outs > 0")
    slices = slices.select("file", "mid", *[F.ceil(F.col(c) / SLICE).cast("int").alias(c) for c in ("ins", "outs")])
    near = cut_lineage(near.join(grown(lone), ["file", "id"]).join(grown(slices), ["file", "mid"]), "ends")
    # what comes in is cut in slices and so is what goes out; each slice meets each
    own, each = (lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
    cell = ["file", "mid", "i", "o"]
    kept = lambda end: F.struct("id", "lone", (F.col("goes") & F.col("comes")).alias("both")).alias(end)
    n = buckets(edges.sparkSession)
    a = near.where("goes").select("file", "mid", own("ins").alias("i"), each("outs").alias("o"), kept("a")).repartition(n, *cell)
    b = near.where("comes").select("file", "mid", each("ins").alias("i"), own("outs").alias("o"), kept("b")).repartition(n, *cell)
    pairs = a.join(grown(b), cell).where("a.id <> b.id")
    rest = pairs.where("NOT (a.lone OR b.lone)").select("file", F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    # with links both ways at both ends, the join finds the pair in the other direction too
    ways = F.array(F.struct(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit(True).alias("found")),
                   F.struct(F.col("b.id").alias("src"), F.col("a.id").alias("dst"), (~(F.col("a.both") & F.col("b.both"))).alias("found")))
    once = pairs.where("a.lone OR b.lone").select("file", F.inline(ways)).where("found").select("file", "src", "dst")
    return undirected(links.unionByName(rest)).unionByName(once)


def two_step_path_counts(edges: DataFrame) -> DataFrame:
    """file, id, paths: directed two-step paths through every node, from its degrees alone."""
    ends = F.array(
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    e = edges.select("file", "src", "dst").distinct()
    d = e.select("file", F.inline(ends)).groupBy("file", "id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return d.select("file", "id", (F.col("i") * F.col("o")).alias("paths")).where(F.col("paths") > 0)


def complete_graph_size(nodes: DataFrame) -> DataFrame:
    """file, edges: how many ordered pairs of different nodes a graph has."""
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return n.select("file", (F.col("n") * (F.col("n") - 1)).alias("pairs"))


def mean_of_others(nodes: DataFrame, value: str) -> DataFrame:
    """Mean over all other nodes of the graph: aggregation over the complete graph, without pairs.

    (sum of the graph - own value) / (n - 1); null in a graph of one node.
    """
    total = nodes.groupBy("file").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    mean = (F.col("_s") - F.col(value)) / F.nullif(F.col("_n") - 1, F.lit(0))
    return nodes.join(total, "file").select("file", "id", mean.alias("mean_of_others"))


def edge_slice(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds))


def edge_code(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in EDGE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[kind], F.lit(0))


def node_index(nodes: DataFrame, limits: list[float] | None = None) -> DataFrame:
    """Adds idx: 0, 1, 2, ... per graph in id order.  A graph holding most nodes stays distributed."""
    b, bucket = by_value(nodes.withColumn("_x", F.col("id").cast("double")), "_x", "_bucket", limits)
    n = number_rows(b, ["id"], bucket, ["file"], "_rn")
    return n.withColumn("idx", F.col("_rn") - 1).drop("_rn", "_x", "_bucket")


def indexed_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with their ends as graph indexes and their kind as a code; dangling edges are left out."""
    at = index.select("file", "id", "idx")
    s = at.select("file", F.col("id").alias("src"), F.col("idx").alias("src_idx"))
    d = at.select("file", F.col("id").alias("dst"), F.col("idx").alias("dst_idx"))
    e = edges.join(grown(s), ["file", "src"]).join(grown(d), ["file", "dst"])
    return e.select("file", "src_idx", "dst_idx", edge_code(F.col("kind")).alias("kind_code"))


def _taint_ends(nodes: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that no sanitizer blocks, sources, and sinks that are no sanitizers, of files that hold both a source and such a sink."""
    sanitised = F.col("attrs")["sanitizer_kind"].isNotNull()
    sources = source_candidates(nodes).select("file", "id")
    sinks = sink_candidates(nodes).where(~sanitised)
    sinks = cut_lineage(sinks.select("file", "id", F.col("attrs")["sink_id"].alias("sink_id")))
    sources = cut_lineage(sources.join(grown(sinks.select("file").distinct()), "file", "left_semi"))
    files = sources.select("file").distinct()
    blocked = nodes.where(sanitised).select("file", "id")
    return _unblocked(flows.join(grown(files), "file", "left_semi"), blocked), sources, sinks.join(grown(files), "file", "left_semi")


def tainted_paths(nodes: DataFrame, flows: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Rule baseline: sinks reached from any source over value and data-flow edges, with the distance.

    Paths do not pass through sanitizers, and a sink that is a sanitizer itself does not count.  Only files that hold
    both a source and such a sink are followed.
    """
    links, sources, sinks = _taint_ends(nodes, flows)
    return sinks.join(grown(shortest(links, sources, max_depth)), ["file", "id"]).where(F.col("depth") > 0)


def tainted_witnesses(nodes: DataFrame, flows: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The sinks of ``tainted_paths`` with a shortest path from a source, as a list of node ids."""
    links, sources, sinks = _taint_ends(nodes, flows)
    paths = witness_paths(links, sources, sinks, max_depth)
    return sinks.join(grown(paths), ["file", "id"]).where(F.col("depth") > 0)


def path_label_agreement(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """How often a file with a tainted path is labelled vulnerable."""
    hit = labels.join(paths.select("file").distinct().withColumn("p", F.lit(1)), "file", "left")
    pred = F.coalesce("p", F.lit(0))
    return hit.groupBy("label", pred.alias("has_path")).agg(F.count(F.lit(1)).alias("files"))
