"""Per-graph features, pooled vectors, augmentation and scored pairs."""

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.operators.traverse import EDGE_CODES
from codeloom.session import grown


SHORT = 32  # dimensions that are aggregated one by one


def node_kind_codes(nodes: DataFrame) -> DataFrame:
    """file, id, kind_code: position of the kind among the graph's distinct kinds in name order.

    Ranked over the distinct kinds (a few dozen per graph), not over the nodes.
    """
    kinds = nodes.groupBy("file").agg(F.array_sort(F.collect_set("kind")).alias("_kinds"))
    code = F.array_position("_kinds", F.col("kind")) - 1
    return nodes.join(kinds, "file").select("file", "id", code.cast("int").alias("kind_code"))


def span_vector(span: Column) -> Column:
    """ARRAY<INT> of the four span numbers, zeros without a span."""
    zeros = F.array(*[F.lit(0)] * 4)
    return F.when(span.isNull(), zeros).otherwise(F.array(*[F.coalesce(span[k], F.lit(0)) for k in ("sl", "sc", "el", "ec")]))


def graph_line_range(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file").agg(
        F.min("span.sl").alias("start_line"), F.max("span.el").alias("end_line")
    )


def pooled_vectors(vectors: DataFrame, keys: list[str], vector: str = "vec", dims: int | None = None) -> DataFrame:
    """keys, pooled: mean values followed by max values of the group's vectors.

    The summary is combined per task before the shuffle: one buffer per group, however large it is.  Of short vectors, whose length
    ``dims`` says, each dimension is an aggregate of its own, which the planner compiles.
    """
    if dims is not None and dims <= SHORT:
        at = [F.col(vector)[i].cast("double") for i in range(dims)]
        sums = [F.sum(x).alias(f"_s{i}") for i, x in enumerate(at)]
        tops = [F.max(x).alias(f"_m{i}") for i, x in enumerate(at)]
        parts = vectors.groupBy(*keys).agg(F.count(vector).alias("_n"), *sums, *tops)
        mean = [F.col(f"_s{i}") / F.col("_n") for i in range(dims)]
        return parts.select(*keys, F.array(*mean, *[F.col(f"_m{i}") for i in range(dims)]).alias("pooled"))
    both = Summarizer.metrics("mean", "max").summary(array_to_vector(F.col(vector).cast("array<double>")))
    pooled = vectors.groupBy(*keys).agg(both.alias("s"))
    return pooled.select(*keys, F.concat(vector_to_array("s.mean"), vector_to_array("s.max")).alias("pooled"))


def softmax(weights: dict[str, float]) -> dict[str, float]:
    top = max(weights.values())
    e = {k: math.exp(v - top) for k, v in weights.items()}
    return {k: v / sum(e.values()) for k, v in e.items()}


def neighbour_mix(edges: DataFrame, vectors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """file, id, mixed: mean of the incoming neighbours per edge kind, mixed by softmax weights.

    Kinds without incoming edges count as zero vectors.
    """
    share = softmax(weights or {k: 1.0 for k in EDGE_CODES})
    table = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    src = vectors.select("file", F.col("id").alias("src"), array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    e = edges.where(F.col("kind").isin(*share)).join(src, ["file", "src"])
    mean = e.groupBy("file", F.col("dst").alias("id"), "kind").agg(Summarizer.mean(F.col("v")).alias("m"))
    mixed = mean.withColumn("w", table[F.col("kind")]).groupBy("file", "id").agg(
        Summarizer.sum(F.col("m"), F.col("w")).alias("s")
    )
    return mixed.select("file", "id", vector_to_array("s").alias("mixed"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def top_nodes(vectors: DataFrame, k: int, group: str = "file", digits: int | None = None) -> DataFrame:
    """group, id, importance, rank of the k longest vectors per group.

    The rank filter is applied per task before the shuffle, so hot groups send k rows per task.
    """
    imp = norm(F.col("vec"))
    scored = vectors.select(group, "id", (F.round(imp, digits) if digits is not None else imp).alias("importance"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("importance"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def compared_explanations(explanations: DataFrame, models: list[str]) -> DataFrame:
    """One row per edge type, one column per model with its importance, 0.0 where it has none."""
    p = explanations.groupBy("edge_type").pivot("model", models).agg(F.max("importance"))
    return p.fillna(0.0, subset=models)


def uniform(*parts: Column, seed: int | str = 42) -> Column:
    """Reproducible number in [0, 1) from the row's own key: the same on every run and retry."""
    key = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def dropped_edges(edges: DataFrame, p: float = 0.2, seed: int = 42) -> DataFrame:
    return edges.where(uniform(F.col("file"), F.col("src"), F.col("dst"), F.col("kind"), seed=seed) >= p)


def masked_vectors(vectors: DataFrame, p: float = 0.15, seed: int = 42) -> DataFrame:
    hit = uniform(F.col("file"), F.col("id"), seed=seed) < p
    zero = F.transform("vec", lambda x: x * 0)
    return vectors.withColumn("vec", F.when(hit, zero).otherwise(F.col("vec")))


def noisy_vectors(vectors: DataFrame, scale: float = 0.1, seed: int = 42) -> DataFrame:
    """Gaussian noise per value (Box-Muller on two reproducible uniforms)."""

    def noise(i):
        u = F.greatest(uniform(F.col("file"), F.col("id"), i, F.lit("a"), seed=seed), F.lit(1e-12))
        v = uniform(F.col("file"), F.col("id"), i, F.lit("b"), seed=seed)
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)

    return vectors.withColumn("vec", F.transform("vec", lambda x, i: x.cast("double") + noise(i) * scale))


def negative_pairs(positives: DataFrame, sizes: DataFrame, seed: int = 42) -> DataFrame:
    """One (u, v) index pair per positive flow from the same graph, different from it and with u <> v.

    ``positives`` holds (file, flow, src_idx, sink_idx), ``sizes`` (file, n).  The pairs with u <> v are numbered
    u * (n - 1) + v, v counted without u; one number is drawn among all but the positive's and moved past it.  A
    graph whose only pair is the positive one, or with fewer than two nodes, has no negative and gives no row.
    """
    rows = positives.join(sizes, "file").where(F.col("n") >= 2)
    n, u0, v0 = F.col("n").cast("bigint"), F.col("src_idx").cast("bigint"), F.col("sink_idx").cast("bigint")
    proper = (u0 != v0) & u0.between(0, n - 1) & v0.between(0, n - 1)
    own = F.when(proper, u0 * (n - 1) + v0 - (v0 > u0).cast("bigint"))
    choices = n * (n - 1) - F.when(proper, 1).otherwise(0)
    drawn = F.floor(uniform(F.col("file"), F.col("flow"), seed=seed) * choices)
    rows = rows.where(choices > 0).withColumn("_at", drawn + F.coalesce((drawn >= own).cast("bigint"), F.lit(0)))
    u = F.floor(F.col("_at") / (n - 1))
    v = F.col("_at") - u * (n - 1)
    v = v + (v >= u).cast("bigint")
    return rows.select("file", "flow", u.cast("int").alias("u"), v.cast("int").alias("v"))


def top_pairs(
    sources: DataFrame, sinks: DataFrame, k: int, group: str = "file", links: bool = True, bias: float = 0.0
) -> DataFrame:
    """group, source_id, sink_id, score, rank: the k best source-sink pairs per group.

    A pair's score is the sum of its two sides (through a logistic link if ``links``), as for any
    linear scorer on the concatenated vectors.  The k best pairs then lie among the k + 1 best
    sources and sinks, so at most (k + 1)^2 pairs per group are formed and none is lost.
    Inputs hold (group, id, part).
    """
    def best(df, name):
        rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("part"), "id"))
        top = df.select(group, "id", "part", rank.alias("_r")).where(F.col("_r") <= k + 1)
        return top.select(group, F.col("id").alias(f"{name}_id"), F.col("part").alias(f"{name}_part"))

    pairs = best(sources, "source").join(grown(best(sinks, "sink")), group).where("source_id <> sink_id")
    raw = F.col("source_part") + F.col("sink_part") + bias
    score = 1 / (1 + F.exp(-raw)) if links else raw
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_raw"), "source_id", "sink_id"))
    return (
        pairs.withColumn("_raw", raw).withColumn("rank", rank).where(F.col("rank") <= k)
        .select(group, "source_id", "sink_id", score.alias("score"), "rank")
    )


def candidate_pair_counts(sources: DataFrame, sinks: DataFrame, group: str = "file") -> DataFrame:
    """group, pairs: number of source-sink pairs with different ends, without forming them."""
    s = sources.select(group, "id", F.lit(1).alias("s"), F.lit(0).alias("t"))
    t = sinks.select(group, "id", F.lit(0).alias("s"), F.lit(1).alias("t"))
    node = s.unionByName(t).groupBy(group, "id").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    n = node.groupBy(group).agg(
        F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum(F.col("s") * F.col("t")).alias("both")
    )
    return n.select(group, (F.col("s") * F.col("t") - F.col("both")).alias("pairs")).where("pairs > 0")


def flow_spans(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """flow, step, node_id, span for source, path and sink of every flow, in order."""
    ids = F.concat(F.array("source_id"), F.coalesce("path_ids", F.array().cast("array<bigint>")), F.array("sink_id"))
    steps = flows.select("flow", "file", F.posexplode(ids).alias("step", "id")).where("id IS NOT NULL")
    return steps.join(nodes.select("file", "id", "span"), ["file", "id"]).select(
        "flow", "file", "step", F.col("id").alias("node_id"), "span"
    )


def flow_records(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flow rows with the ordered spans of their nodes; a group is one flow's own path."""
    spans = flow_spans(flows, nodes).groupBy("flow").agg(
        F.array_sort(F.collect_list(F.struct("step", "node_id", "span"))).alias("vulnerable_spans")
    )
    return flows.join(spans, "flow")


def flow_end_attributes(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """flow with source_id, sink_id, sink_kind rule attributes and the sink's code."""
    n = nodes.select("file", "id", "attrs", "code")
    s = n.select("file", F.col("id").alias("source_id"), F.col("attrs")["source_id"].alias("source_rule"))
    t = n.select(
        "file", F.col("id").alias("sink_id"), F.col("attrs")["sink_id"].alias("sink_rule"),
        F.col("attrs")["sink_kind"].alias("sink_kind"), F.col("code").alias("sink_code"),
    )
    return flows.join(grown(s), ["file", "source_id"], "left").join(grown(t), ["file", "sink_id"], "left")


