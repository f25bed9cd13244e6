"""Traversal, reshaping and features: N1-N20, J7, J8, J10, J11, G7, G23, G24, S4, S5, K1-K3."""

from pyspark.sql import functions as F

from codeloom.operators import best_pairs as BP
from codeloom.operators import features as FT
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.operators import models as MD
from codeloom.operators import taint as TA
from codeloom.operators import traverse as T
from codeloom.operators.ordered import by_value, latest_before, previous_row, seconds
from codeloom.plans.registry import query
from codeloom.plans.views import (
    ORDER_GRAPH_SQL, day_nodes, order_edges, order_nodes, sql, table, view,
)
from codeloom.session import cut_lineage, scratch_path
from codeloom.sources import graphs as GR

_BOTH = ", e AS (SELECT DISTINCT src, dst FROM shop_edges), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) "
_HOP = (
    ", r{n} AS (SELECT DISTINCT b AS id FROM b JOIN r{m} ON a = r{m}.id WHERE b NOT IN (SELECT id FROM s{m})), "
    "s{n} AS (SELECT id FROM s{m} UNION SELECT id FROM r{n})"
)


@query(
    "neighbourhood_depths", "N1",
    sql("shop_edges", "shop_seeds") + _BOTH
    + ", r0 AS (SELECT DISTINCT id FROM shop_seeds), s0 AS (SELECT id FROM r0)"
    + _HOP.format(n=1, m=0) + _HOP.format(n=2, m=1)
    + " SELECT id, 0 AS depth FROM r0 UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM r2",
)
def neighbourhood_depths(spark, sf):
    seen = T.neighbourhood(view(spark, sf, "shop_edges"), view(spark, sf, "shop_seeds"), 2)
    return seen.select("id", "depth")


@query(
    "directed_reach", "D6 N1",
    sql("shop_edges", "shop_seeds")
    + ", blocked AS (SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderstatus = 'P') "
    "SELECT DISTINCT id, 0 AS depth FROM shop_seeds UNION ALL SELECT DISTINCT dst, 1 FROM shop_edges e JOIN shop_seeds s ON e.src = s.id "
    "WHERE e.src NOT IN (SELECT id FROM blocked)",
)
def directed_reach(spark, sf):
    blocked = table(spark, sf, "orders").where("o_orderstatus = 'P'").selectExpr("'shop' AS file", "o_orderkey * 2 AS id")
    return T.reachable(view(spark, sf, "shop_edges"), view(spark, sf, "shop_seeds"), 4, blocked).select("id", "depth")


@query(
    "induced_edges", "N2",
    sql("shop_edges")
    + ", k AS (SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT p_partkey * 2 + 1 FROM part WHERE p_size <= 25) "
    "SELECT src, dst FROM shop_edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
)
def induced_edges(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("'shop' AS file", "o_orderkey * 2 AS id")
    p = table(spark, sf, "part").where("p_size <= 25").selectExpr("'shop' AS file", "p_partkey * 2 + 1 AS id")
    kept = o.unionByName(p)
    _, e = T.induced_subgraph(kept, view(spark, sf, "shop_edges"), kept)
    return e.select("src", "dst")


_CHAIN = (
    ", c AS (SELECT file, id AS dst, lag(id) OVER (PARTITION BY file ORDER BY id) AS src FROM day_nodes), "
    "ch AS (SELECT file, src, dst FROM c WHERE src IS NOT NULL)"
)


def _chain(spark, sf, limits=None):
    """Each node of a day from the one before it."""
    d = view(spark, sf, "day_nodes").select("file", "id", F.col("id").cast("double").alias("x"))
    b, slot = by_value(d, "x", "slot", limits)
    p = previous_row(b, ["file"], ["id"], slot, {"src": F.col("id")})
    return p.where("src IS NOT NULL").select("file", "src", F.col("id").alias("dst"))


@query("sequential_edges", "G7", sql("day_nodes") + _CHAIN + " SELECT file, src, dst FROM ch")
def sequential_edges(spark, sf):
    return _chain(spark, sf)


@query(
    "latest_definition", "G14 G15 G16",
    "SELECT event_id, def FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) "
    "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS def FROM events) WHERE event_type <> 'signup' AND def IS NOT NULL",
)
def latest_definition(spark, sf):
    """As-of lookup per user: the last signup before each other event."""
    e = table(spark, sf, "events")
    e = e.select(
        "user_id", "event_id", "ts", "event_type", seconds(e, "ts").alias("t"),
        F.when(F.col("event_type") == "signup", F.col("event_id")).alias("value"),
    )
    b, slot = by_value(e, "t", "slot")
    seen = latest_before(b, ["user_id"], ["ts", "event_id"], "value", slot, "def")
    return seen.where("event_type <> 'signup' AND def IS NOT NULL").select("event_id", "def")


@query(
    "two_hop_edges", "N3",
    sql("day_nodes") + _CHAIN
    + ", e AS (SELECT file, src, dst FROM ch UNION SELECT a.file, a.src, b.dst FROM ch a JOIN ch b ON a.file = b.file AND a.dst = b.src) "
    "SELECT file, src, dst FROM e UNION SELECT file, dst, src FROM e",
)
def two_hop_edges(spark, sf):
    return T.two_hop(_chain(spark, sf))


_HUB = (
    "WITH e AS (SELECT 'n' || CAST(s_nationkey AS STRING) AS file, s_suppkey * 2 AS src, 1 AS dst FROM supplier "
    "UNION SELECT 'n' || CAST(c_nationkey AS STRING), 1, c_custkey * 2 + 2000001 FROM customer) "
)


@query(
    "two_hop_hub", "N3",
    _HUB + ", t AS (SELECT file, src, dst FROM e UNION SELECT a.file, a.src, b.dst FROM e a JOIN e b ON a.file = b.file AND a.dst = b.src) "
    "SELECT file, src, dst FROM t UNION SELECT file, dst, src FROM t",
)
def two_hop_hub(spark, sf):
    """A star per nation: its suppliers reach its customers through one node."""
    nation = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("file")
    s = table(spark, sf, "supplier").select(nation("s_nationkey"), (F.col("s_suppkey") * 2).alias("src"), F.lit(1).cast("bigint").alias("dst"))
    c = table(spark, sf, "customer").select(nation("c_nationkey"), F.lit(1).cast("bigint").alias("src"), (F.col("c_custkey") * 2 + 2000001).alias("dst"))
    return T.two_hop(s.unionByName(c))


@query(
    "directed_line_reach", "N1 D6",
    "SELECT 'o' || CAST(l_orderkey AS STRING) AS file, CAST(l_linenumber AS BIGINT) AS id, "
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS depth "
    "FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
)
def directed_line_reach(spark, sf):
    """From the first line of each order along the chain of its lines, to the end."""
    d = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").cast("bigint").alias("id")
    ).distinct()
    b, slot = by_value(d.withColumn("x", F.col("id").cast("double")), "x", "slot", [2.0, 4.0, 6.0])
    chain = previous_row(b, ["file"], ["id"], slot, {"src": F.col("id")})
    seeds = chain.where("src IS NULL").select("file", "id")
    return T.reachable(chain.where("src IS NOT NULL").select("file", "src", F.col("id").alias("dst")), seeds)


_LINES = (
    "WITH RECURSIVE l AS (SELECT 'o' || CAST(l_orderkey AS STRING) AS file, CAST(l_linenumber AS BIGINT) AS id, max(l_quantity) AS q, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL), "
    "e AS (SELECT a.file, a.id AS src, b.id AS dst FROM l a JOIN l b ON a.file = b.file AND ((b.id = a.id + 1 AND a.q <= 45) OR (b.id = a.id + 2 AND a.q > 25)))"
)


@query(
    "witness_paths", "D6 N19",
    _LINES
    + ", r AS (SELECT file, id, 0 AS depth FROM l WHERE id = 1 UNION SELECT e.file, e.dst, r.depth + 1 FROM r JOIN e ON e.file = r.file AND e.src = r.id), "
    "d AS (SELECT file, id, min(depth) AS depth FROM r GROUP BY file, id), "
    "p AS (SELECT x.file, x.id, min(e.src) AS before FROM d x JOIN e ON e.file = x.file AND e.dst = x.id JOIN d y ON y.file = e.file AND y.id = e.src AND y.depth = x.depth - 1 GROUP BY ALL), "
    "w AS (SELECT file, id, id AS node, CAST(id AS STRING) AS path FROM d UNION ALL "
    "SELECT w.file, w.id, p.before, CAST(p.before AS STRING) || '>' || w.path FROM w JOIN p ON p.file = w.file AND p.id = w.node) "
    "SELECT w.file, w.id, d.depth, w.path FROM w JOIN d ON d.file = w.file AND d.id = w.id JOIN l ON l.file = w.file AND l.id = w.id "
    "WHERE l.flag = 'R' AND w.node = 1",
)
def witness_paths(spark, sf):
    """Within each order, from its first line to the next line or the one after, a shortest way to each returned line."""
    n = F.col("l_linenumber").cast("bigint")
    lines = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), n.alias("id"))
    lines = cut_lineage(lines.agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag")))
    steps = F.array(F.struct((F.col("q") <= 45).alias("may"), (F.col("id") + 1).alias("dst")), F.struct((F.col("q") > 25).alias("may"), (F.col("id") + 2).alias("dst")))
    links = lines.select("file", F.col("id").alias("src"), F.inline(steps)).where("may").select("file", "src", "dst")
    links = links.join(lines.select("file", F.col("id").alias("dst")), ["file", "dst"], "left_semi")
    found = T.witness_paths(links, lines.where("id = 1"), lines.where("flag = 'R'"))
    return found.select("file", "id", F.col("depth").cast("int").alias("depth"), F.array_join("path", ">").alias("path"))


@query(
    "two_step_paths", "N3",
    sql("day_nodes") + _CHAIN
    + ", d AS (SELECT file, id, sum(i) AS i, sum(o) AS o FROM (SELECT file, dst AS id, 1 AS i, 0 AS o FROM ch UNION ALL SELECT file, src, 0, 1 FROM ch) GROUP BY file, id) "
    "SELECT file, id, CAST(i * o AS BIGINT) AS paths FROM d WHERE i * o > 0",
)
def two_step_paths(spark, sf):
    return T.two_step_path_counts(_chain(spark, sf))


@query(
    "edge_slice_counts", "N4 N8",
    ORDER_GRAPH_SQL
    + "SELECT kind, CASE kind WHEN 'AST' THEN 0 WHEN 'CFG' THEN 1 WHEN 'DFG' THEN 2 WHEN 'DDFG' THEN 3 ELSE 0 END AS code, count(*) AS n FROM edges WHERE kind IN ('AST', 'CFG', 'JUMP') GROUP BY 1, 2",
)
def edge_slice_counts(spark, sf):
    e = T.edge_slice(order_edges(spark, sf), "AST", "CFG", "JUMP")
    return e.groupBy("kind", T.edge_code(F.col("kind")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


_TRUNC = ", k AS (SELECT file, id FROM (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY id) AS r FROM nodes) WHERE r <= 4) "


@query(
    "truncated_graphs", "N6",
    ORDER_GRAPH_SQL + _TRUNC
    + ", n AS (SELECT file, count(*) AS nodes FROM k GROUP BY file), m AS (SELECT e.file, count(*) AS edges FROM edges e JOIN k a ON a.file = e.file AND a.id = e.src "
    "JOIN k b ON b.file = e.file AND b.id = e.dst GROUP BY e.file) SELECT n.file, nodes, coalesce(edges, 0) AS edges FROM n LEFT JOIN m USING (file)",
)
def truncated_graphs(spark, sf):
    n, e = T.truncated(order_nodes(spark, sf), order_edges(spark, sf), 4)
    counts = e.groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    sizes = n.groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(counts, "file", "left").select("file", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(
    "node_index", "N7",
    ORDER_GRAPH_SQL + "SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY id) - 1 AS idx FROM nodes",
)
def node_index(spark, sf):
    return T.node_index(order_nodes(spark, sf)).select("file", "id", "idx")


@query(
    "indexed_edges", "N7 N8",
    ORDER_GRAPH_SQL.replace("edges AS (", "edges AS MATERIALIZED (").replace("nodes AS (", "nodes AS MATERIALIZED (")
    + ", i AS MATERIALIZED (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY id) - 1 AS idx FROM nodes) "
    "SELECT e.file, a.idx AS src_idx, b.idx AS dst_idx, CASE kind WHEN 'AST' THEN 0 WHEN 'CFG' THEN 1 WHEN 'DFG' THEN 2 ELSE 0 END AS kind_code "
    "FROM edges e JOIN i a ON a.file = e.file AND a.id = e.src JOIN i b ON b.file = e.file AND b.id = e.dst",
)
def indexed_edges(spark, sf):
    index = T.node_index(order_nodes(spark, sf))
    return T.indexed_edges(order_edges(spark, sf), index)


@query(
    "node_kind_codes", "N9",
    sql("day_nodes") + "SELECT file, id, CAST(dense_rank() OVER (PARTITION BY file ORDER BY kind) - 1 AS INTEGER) AS kind_code FROM day_nodes",
)
def node_kind_codes(spark, sf):
    return FT.node_kind_codes(view(spark, sf, "day_nodes"))


@query(
    "span_vectors", "N10",
    sql("day_nodes")
    + "SELECT id, CASE WHEN kind = 'Stmt' THEN '0,0,0,0' ELSE concat_ws(',', sl, sc, el, ec) END AS spans FROM day_nodes",
)
def span_vectors(spark, sf):
    d = day_nodes(spark, sf)
    span = F.when(F.col("kind") != "Stmt", F.col("span"))
    return d.select("id", F.array_join(FT.span_vector(span), ",").alias("spans"))


@query(
    "graph_line_ranges", "N20",
    sql("day_nodes") + "SELECT file, min(sl) AS start_line, max(el) AS end_line FROM day_nodes GROUP BY file",
)
def graph_line_ranges(spark, sf):
    return FT.graph_line_range(day_nodes(spark, sf))


@query(
    "project_keys", "N11",
    "SELECT project, count(*) AS n FROM (SELECT CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE 'unknown' END AS project FROM "
    "(SELECT CASE WHEN n_chars % 3 = 0 THEN source ELSE source || '/' || lang || '/f.py' END AS f FROM documents)) GROUP BY project",
)
def project_keys(spark, sf):
    from codeloom.functions.text import project_of

    f = table(spark, sf, "documents").select(
        F.expr("CASE WHEN n_chars % 3 = 0 THEN source ELSE source || '/' || lang || '/f.py' END").alias("f")
    )
    return f.groupBy(project_of(F.col("f")).alias("project")).agg(F.count(F.lit(1)).alias("n"))




@query(
    "pooled_vectors", "N12",
    "WITH v AS (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings), "
    "p AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m, max(CAST(x AS DOUBLE)) AS t FROM v GROUP BY label, dim), "
    "d AS (SELECT max(len(embedding)) AS n FROM embeddings) "
    "SELECT label, dim, round(m, 6) AS value FROM p UNION ALL SELECT label, dim + n, round(t, 6) FROM p, d",
)
def pooled_vectors(spark, sf):
    p = FT.pooled_vectors(table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec"), ["label"])
    return p.select("label", F.posexplode("pooled").alias("i", "x")).select(
        "label", (F.col("i") + 1).cast("bigint").alias("dim"), F.round("x", 6).alias("value")
    )


_VEC_EDGES = (
    "SELECT 'g' AS file, e.vec_id AS src, (e.vec_id * 7 + e.label) % n.n AS dst, CASE e.label % 3 WHEN 0 THEN 'AST' WHEN 1 THEN 'CFG' ELSE 'DFG' END AS kind "
    "FROM embeddings e, (SELECT max(vec_id) + 1 AS n FROM embeddings) n"
)


@query(
    "neighbour_mix", "N13",
    f"WITH e AS ({_VEC_EDGES}), x AS (SELECT e.dst AS id, e.kind, unnest(v.embedding) AS x, unnest(range(0, len(v.embedding))) AS dim FROM e JOIN embeddings v ON v.vec_id = e.src), "
    "m AS (SELECT id, kind, dim, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY ALL) SELECT id, dim, round(sum(m * 0.25), 6) AS value FROM m GROUP BY id, dim",
)
def neighbour_mix(spark, sf):
    emb = table(spark, sf, "embeddings")
    n = emb.agg((F.max("vec_id") + 1).alias("n"))
    edges = emb.crossJoin(F.broadcast(n)).select(  # one row
        F.lit("g").alias("file"), F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + F.col("label")) % F.col("n")).alias("dst"),
        F.expr("CASE label % 3 WHEN 0 THEN 'AST' WHEN 1 THEN 'CFG' ELSE 'DFG' END").alias("kind"),
    )
    vectors = emb.select(F.lit("g").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    mixed = FT.neighbour_mix(edges, vectors)
    return mixed.select("id", F.posexplode("mixed").alias("i", "x")).select(
        "id", F.col("i").cast("bigint").alias("dim"), F.round("x", 6).alias("value")
    )


@query(
    "important_nodes", "N14",
    "SELECT label, vec_id AS id, importance, CAST(rank AS INTEGER) AS rank FROM (SELECT label, vec_id, importance, row_number() OVER (PARTITION BY label ORDER BY importance DESC, vec_id) AS rank FROM "
    "(SELECT label, vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS importance FROM embeddings)) WHERE rank <= 10",
)
def important_nodes(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return FT.top_nodes(v, 10, "label", digits=5)


@query(
    "compared_explanations", "N15",
    ORDER_GRAPH_SQL
    + ", s AS (SELECT kind, 'm' || CAST(src % 3 AS STRING) AS model, round(CAST(count(*) AS DOUBLE) / 1000, 6) AS importance FROM edges WHERE NOT (kind = 'JUMP' AND src % 3 = 2) GROUP BY 1, 2) "
    "SELECT kind AS edge_type, coalesce(max(CASE WHEN model = 'm0' THEN importance END), 0.0) AS m0, coalesce(max(CASE WHEN model = 'm1' THEN importance END), 0.0) AS m1, "
    "coalesce(max(CASE WHEN model = 'm2' THEN importance END), 0.0) AS m2 FROM s GROUP BY kind",
)
def compared_explanations(spark, sf):
    e = order_edges(spark, sf).where("NOT (kind = 'JUMP' AND src % 3 = 2)")
    s = e.groupBy(F.col("kind").alias("edge_type"), F.expr("'m' || CAST(src % 3 AS STRING)").alias("model")).agg(
        F.round(F.count(F.lit(1)).cast("double") / 1000, 6).alias("importance")
    )
    return FT.compared_explanations(s, ["m0", "m1", "m2"])


def _uniform(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"(CAST(('0x' || substr(sha256('42|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"


@query(
    "dropped_edges", "N16",
    ORDER_GRAPH_SQL + f"SELECT file, src, dst, kind FROM edges WHERE {_uniform('file', 'src', 'dst', 'kind')} >= 0.2",
)
def dropped_edges(spark, sf):
    return FT.dropped_edges(order_edges(spark, sf))


@query(
    "masked_vectors", "N16",
    "SELECT vec_id AS id, round(CASE WHEN " + _uniform("'g'", "vec_id")
    + " < 0.15 THEN 0.0 ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END, 5) AS total FROM embeddings",
)
def masked_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.lit("g").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    m = FT.masked_vectors(v)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return m.select("id", F.round(total + 0.0, 5).alias("total"))


_U, _V = _uniform("'g'", "vec_id", "0", "'a'"), _uniform("'g'", "vec_id", "0", "'b'")


@query(
    "noisy_vectors", "N16",
    f"SELECT vec_id AS id, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE) + sqrt(-2 * ln(greatest({_U}, 0.000000000001))) * cos(2 * pi() * {_V}) * 0.1, 6) AS first FROM embeddings",
)
def noisy_vectors(spark, sf):
    v = table(spark, sf, "embeddings").select(F.lit("g").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return FT.noisy_vectors(v).select("id", F.size("vec").cast("bigint").alias("dims"), F.round(F.element_at("vec", 1), 6).alias("first"))


@query(
    "negative_pairs", "N17",
    sql("day_nodes")
    + ", s AS (SELECT file, count(*) AS n FROM day_nodes GROUP BY file), p AS (SELECT d.file, d.id AS flow, d.id % s.n AS src_idx, (d.id + 1) % s.n AS sink_idx, s.n FROM day_nodes d JOIN s USING (file) WHERE s.n >= 2), "
    f"d AS (SELECT *, CAST(floor({_uniform('file', 'flow')} * (n * (n - 1) - 1)) AS BIGINT) AS draw FROM p WHERE n > 1), "
    "m AS (SELECT *, draw + CASE WHEN draw >= src_idx * (n - 1) + sink_idx - CASE WHEN sink_idx > src_idx THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS place FROM d) "
    "SELECT file, flow, CAST(place // (n - 1) AS INTEGER) AS u, "
    "CAST(place % (n - 1) + CASE WHEN place % (n - 1) >= place // (n - 1) THEN 1 ELSE 0 END AS INTEGER) AS v FROM m",
)
def negative_pairs(spark, sf):
    d = view(spark, sf, "day_nodes").select("file", "id")
    sizes = d.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    flows = d.join(sizes, "file").select(
        "file", F.col("id").alias("flow"), (F.col("id") % F.col("n")).alias("src_idx"), ((F.col("id") + 1) % F.col("n")).alias("sink_idx")
    )
    return FT.negative_pairs(flows, sizes)


_PARTS = (
    ", s AS (SELECT file, id, round(CAST(sc AS DOUBLE) / 8, 4) AS part FROM day_nodes WHERE kind IN ('Call', 'Name')), "
    "t AS (SELECT file, id, round(CAST(el AS DOUBLE) / 16, 4) AS part FROM day_nodes WHERE kind IN ('Stmt', 'Name')) "
)


def _parts(spark, sf):
    d = view(spark, sf, "day_nodes")
    s = d.where("kind IN ('Call', 'Name')").select("file", "id", F.expr("round(CAST(sc AS DOUBLE) / 8, 4)").alias("part"))
    t = d.where("kind IN ('Stmt', 'Name')").select("file", "id", F.expr("round(CAST(el AS DOUBLE) / 16, 4)").alias("part"))
    return s, t


@query(
    "top_scored_pairs", "N18 K3 J7",
    sql("day_nodes") + _PARTS
    + ", p AS (SELECT s.file, s.id AS source_id, t.id AS sink_id, s.part + t.part AS score FROM s JOIN t ON s.file = t.file AND s.id <> t.id) "
    "SELECT file, source_id, sink_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, source_id, sink_id) AS r FROM p) WHERE r <= 3",
)
def top_scored_pairs(spark, sf):
    s, t = _parts(spark, sf)
    return FT.top_pairs(s, t, 3, links=False)


@query(
    "best_monotone_pairs", "N18 K3 J7",
    sql("day_nodes")
    + ", n AS (SELECT split_part(file, '/', 1) AS project, * FROM day_nodes), "
    "p AS (SELECT s.project, s.id AS source_id, t.id AS sink_id, CAST(least(s.sl + 2 * t.sc, 40 * s.sc) + s.sc * t.el / 64.0 AS DOUBLE) AS score "
    "FROM n s JOIN n t ON s.project = t.project AND s.id <> t.id WHERE s.kind IN ('Call', 'Name') AND t.kind IN ('Stmt', 'Name')) "
    "SELECT project, source_id, sink_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, source_id, sink_id) AS r FROM p) WHERE r <= 5",
)
def best_monotone_pairs(spark, sf):
    """A scorer that is neither linear nor a sum of sides, over whole projects."""
    d = view(spark, sf, "day_nodes").withColumn("project", F.split_part("file", F.lit("/"), F.lit(1)))
    score = lambda s, t: F.least(s["sl"] + 2 * t["sc"], 40 * s["sc"]) + s["sc"] * t["el"] / 64
    return BP.best_pairs(
        d.where("kind IN ('Call', 'Name')"), d.where("kind IN ('Stmt', 'Name')"), 5, score, ["sl", "sc"], ["sc", "el"], "project"
    )


@query(
    "candidate_pair_counts", "J7",
    sql("day_nodes") + _PARTS + " SELECT s.file, count(*) AS pairs FROM s JOIN t ON s.file = t.file AND s.id <> t.id GROUP BY s.file",
)
def candidate_pair_counts(spark, sf):
    return FT.candidate_pair_counts(*_parts(spark, sf))


@query(
    "complete_graph_sizes", "J8",
    sql("day_nodes") + "SELECT file, count(*) * (count(*) - 1) AS pairs FROM day_nodes GROUP BY file",
)
def complete_graph_sizes(spark, sf):
    return T.complete_graph_size(view(spark, sf, "day_nodes"))


@query(
    "mean_of_other_nodes", "J8",
    sql("day_nodes")
    + "SELECT a.id, round(avg(b.ec), 6) AS mean_of_others FROM day_nodes a LEFT JOIN day_nodes b ON a.file = b.file AND a.id <> b.id GROUP BY a.id",
)
def mean_of_other_nodes(spark, sf):
    m = T.mean_of_others(view(spark, sf, "day_nodes"), "ec")
    return m.select("id", F.round("mean_of_others", 6).alias("mean_of_others"))


def _flows(spark, sf):
    """One flow per purchase: from the event two places before it, through the one before, to itself."""
    c = _chain(spark, sf)
    one = c.select("file", F.col("src").alias("mid"), F.col("dst").alias("sink_id"))
    two = c.select("file", F.col("src").alias("source_id"), F.col("dst").alias("mid"))
    sinks = view(spark, sf, "day_nodes").where("kind = 'Stmt'").select("file", F.col("id").alias("sink_id"))
    return one.join(sinks, ["file", "sink_id"]).join(two, ["file", "mid"]).select(
        F.col("sink_id").alias("flow"), "file", "source_id", F.array("mid").alias("path_ids"), "sink_id"
    )


_FLOWS = (
    _CHAIN + ", w AS (SELECT b.dst AS flow, b.file, a.src AS source_id, a.dst AS mid, b.dst AS sink_id FROM ch b JOIN day_nodes d ON d.file = b.file AND d.id = b.dst AND d.kind = 'Stmt' "
    "JOIN ch a ON a.file = b.file AND a.dst = b.src) "
)


@query(
    "flow_spans", "J10 N19",
    sql("day_nodes") + _FLOWS
    + ", l AS (SELECT flow, file, 0 AS step, source_id AS node_id FROM w UNION ALL SELECT flow, file, 1, mid FROM w UNION ALL SELECT flow, file, 2, sink_id FROM w) "
    "SELECT l.flow, l.step, l.node_id, d.sl AS start_line, d.el AS end_line FROM l JOIN day_nodes d ON d.file = l.file AND d.id = l.node_id",
)
def flow_spans(spark, sf):
    s = FT.flow_spans(_flows(spark, sf), day_nodes(spark, sf))
    return s.select("flow", "step", "node_id", F.col("span.sl").alias("start_line"), F.col("span.el").alias("end_line"))


@query(
    "flow_records", "N19",
    sql("day_nodes") + _FLOWS
    + "SELECT w.flow, a.sl || '-' || b.sl || '-' || c.sl AS start_lines FROM w JOIN day_nodes a ON a.id = w.source_id JOIN day_nodes b ON b.id = w.mid JOIN day_nodes c ON c.id = w.sink_id",
)
def flow_records(spark, sf):
    r = FT.flow_records(_flows(spark, sf), day_nodes(spark, sf))
    starts = F.transform("vulnerable_spans", lambda v: v["span"]["sl"].cast("string"))
    return r.select("flow", F.array_join(starts, "-").alias("start_lines"))


@query(
    "flow_end_attributes", "J11",
    sql("day_nodes") + _FLOWS
    + "SELECT w.flow, a.source_id AS source_rule, c.sink_id AS sink_rule, c.sink_kind, c.code AS sink_code FROM w JOIN day_nodes a ON a.id = w.source_id JOIN day_nodes c ON c.id = w.sink_id",
)
def flow_end_attributes(spark, sf):
    r = FT.flow_end_attributes(_flows(spark, sf), day_nodes(spark, sf))
    return r.select("flow", "source_rule", "sink_rule", "sink_kind", "sink_code")


@query(
    "recorded_or_predicted_flows", "T7",
    sql("day_nodes") + _FLOWS
    + ", pr AS (SELECT DISTINCT file FROM day_nodes WHERE kind = 'Call') SELECT file, 'recorded' AS origin, count(*) AS n FROM w GROUP BY file "
    "UNION ALL SELECT file, 'predicted', 1 FROM pr WHERE file NOT IN (SELECT file FROM w)",
)
def recorded_or_predicted_flows(spark, sf):
    predicted = view(spark, sf, "day_nodes").where("kind = 'Call'").select("file").distinct()
    both = TA.flows_or_predicted(_flows(spark, sf), predicted)
    return both.groupBy("file", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "repository_id_shifts", "G23",
    sql("day_nodes")
    + ", f AS (SELECT file, max(id) + 1 AS w, sha256(file) AS h FROM day_nodes GROUP BY file), s AS (SELECT file, sum(w) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - w AS shift FROM f) "
    "SELECT d.file, CAST(min(d.id + shift) AS BIGINT) AS first_id, CAST(max(d.id + shift) AS BIGINT) AS last_id FROM day_nodes d JOIN s USING (file) GROUP BY d.file",
)
def repository_id_shifts(spark, sf):
    d = view(spark, sf, "day_nodes").select("file", "id")
    n, _ = G.merged_ids(d, _chain(spark, sf))
    return n.groupBy("file").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    "edge_key_spellings", "G24 S5",
    ORDER_GRAPH_SQL + "SELECT count(*) AS n, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM edges",
)
def edge_key_spellings(spark, sf):
    e = order_edges(spark, sf)
    other = GR.edge_keys_for_export(e.where("kind = 'AST'"))
    both = e.where("kind <> 'AST'").unionByName(other, allowMissingColumns=True)
    return GR.normal_edge_keys(both).agg(
        F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst")
    )


@query(
    "graph_documents", "S3 S5",
    ORDER_GRAPH_SQL
    + ", n AS (SELECT file, count(*) AS nodes FROM nodes GROUP BY file), e AS (SELECT file, count(*) AS edges, CAST(sum(dst) AS BIGINT) AS dst FROM edges GROUP BY file) SELECT file, nodes, edges, dst FROM n JOIN e USING (file)",
)
def graph_documents(spark, sf):
    """Tables to documents and back."""
    n = order_nodes(spark, sf).select(
        "file", "id", "kind", F.struct(*[F.lit(0).alias(k) for k in ("sl", "sc", "el", "ec")]).alias("span"),
        *[F.lit(None).cast("string").alias(c) for c in ("code", "symbol", "type_hint")],
        F.array().cast("array<string>").alias("flags"), F.lit(None).cast("map<string,string>").alias("attrs"),
    )
    e = order_edges(spark, sf).withColumn("attrs", F.lit(None).cast("map<string,string>"))
    docs = GR.graph_documents(n, e, max_items=6)
    back = F.aggregate("edges", F.lit(0).cast("bigint"), lambda a, x: a + x["dst"])
    return docs.groupBy("file").agg(
        F.sum(F.size("nodes")).alias("nodes"), F.sum(F.size("edges")).alias("edges"), F.sum(back).alias("dst")
    )


@query(
    "rule_candidates", "P13",
    sql("day_nodes")
    + "SELECT id, 'source' AS role FROM day_nodes WHERE source_id IS NOT NULL UNION ALL SELECT id, 'sink' FROM day_nodes WHERE sink_id IS NOT NULL AND sink_failed IS NULL",
)
def rule_candidates(spark, sf):
    d = day_nodes(spark, sf)
    s = M.source_candidates(d).select("id", F.lit("source").alias("role"))
    return s.unionByName(M.sink_candidates(d).select("id", F.lit("sink").alias("role")))


@query(
    "distinct_code_embeddings", "K1",
    "SELECT count(*) AS texts, CAST(sum(CASE WHEN text = '' THEN 0 ELSE 1 END) AS BIGINT) AS embedded FROM (SELECT DISTINCT text FROM documents)",
)
def distinct_code_embeddings(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("text").alias("code"))
    v = MD.embedded_codes(docs)
    return v.agg(F.count(F.lit(1)).alias("texts"), F.count_if(FT.norm(F.col("vec")) > 0).alias("embedded"))


@query(
    "chunked_embeddings", "K1",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first FROM documents",
)
def chunked_embeddings(spark, sf):
    """A plugged-in model: its vector starts with the length of the text."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("code"))
    model = MD.chunked_embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], dims=2)
    return MD.embedded_nodes(docs, model).select("doc_id", F.element_at("vec", 1).cast("double").alias("first"))


@query(
    "linear_graph_scores", "K2",
    "WITH p AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.5)) + 0.1 AS z FROM embeddings) "
    "SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS p_vulnerable, 1 / (1 + exp(-z)) > 0.5 AS is_vulnerable FROM p",
)
def linear_graph_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    s = MD.linear_scores(e, [0.5] * 64, 0.1, "embedding")
    return s.select("vec_id", F.round("p_vulnerable", 6).alias("p_vulnerable"), "is_vulnerable")


@query(
    "plugged_graph_scores", "K2",
    "SELECT vec_id, embedding[1] > 0 AS is_vulnerable, CASE WHEN embedding[1] > 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM embeddings",
)
def plugged_graph_scores(spark, sf):
    s = MD.scored_graphs(table(spark, sf, "embeddings"), lambda vs: [0.9 if v[0] > 0 else 0.2 for v in vs], "embedding")
    return s.select("vec_id", "is_vulnerable", F.round("confidence", 6).alias("confidence"))


@query(
    "pair_scores", "K3",
    "WITH s AS (SELECT label, vec_id AS id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.3)) AS a, "
    "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * -0.2)) AS b FROM embeddings), "
    "m AS (SELECT label, max(a) AS a FROM s GROUP BY label), n AS (SELECT label, max(b) AS b FROM s GROUP BY label) "
    "SELECT m.label, round(a, 6) AS best_source, round(b, 6) AS best_sink FROM m JOIN n USING (label)",
)
def pair_scores(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    w = [0.3] * 64 + [-0.2] * 64
    a = MD.pair_parts(e, w, "source").groupBy("file").agg(F.max("part").alias("a"))
    b = MD.pair_parts(e, w, "sink").groupBy("file").agg(F.max("part").alias("b"))
    return a.join(b, "file").select(
        F.col("file").alias("label"), F.round("a", 6).alias("best_source"), F.round("b", 6).alias("best_sink")
    )


@query(
    "judged_pairs", "K3",
    "WITH s AS (SELECT label, vec_id, embedding, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings) "
    "SELECT s.vec_id AS source_id, other AS sink_id, round(CASE WHEN s.embedding[1] * t.embedding[2] > 0 THEN 0.9 ELSE 0.1 END, 2)::DOUBLE AS score "
    "FROM s JOIN embeddings t ON t.vec_id = s.other",
)
def judged_pairs(spark, sf):
    """A scorer that is not linear over a given table of pairs: each vector with the next of its class."""
    v = table(spark, sf, "embeddings").select(F.col("label").alias("file"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    b, slot = by_value(v.select("file", "id", F.col("id").cast("double").alias("x")), "x", "slot")
    pairs = previous_row(b, ["file"], ["id"], slot, {"source_id": F.col("id")}).where("source_id IS NOT NULL")
    scored = MD.scored_pairs(
        pairs.select("file", "source_id", F.col("id").alias("sink_id")), v, lambda s, t: [0.9 if a[0] * b[1] > 0 else 0.1 for a, b in zip(s, t)]
    )
    return scored.select("source_id", "sink_id", "score")


_HELD_SQL = """
    WITH h AS (SELECT sha256('42|' || p) AS h, p, n FROM (SELECT {project} AS p, count(*) AS n FROM {rows} GROUP BY 1)),
    r AS (SELECT p, (sum(n) OVER (ORDER BY h, p) - n) / sum(n) OVER () AS start FROM h)
    SELECT CASE WHEN start < 0.8 THEN 'val' ELSE 'test' END AS split, CAST({label} AS INTEGER) AS label, count(*) AS n
    FROM {rows} JOIN r ON r.p = {project} WHERE start >= 0.6 GROUP BY 1, 2
"""


def _held_counts(scored, label):
    """What SQL can say of a held-out evaluation: rows and classes per split, each row with a probability."""
    return scored.where("score BETWEEN 0 AND 1").groupBy("split", F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "embedding_logistic_baseline", "D11",
    _HELD_SQL.format(project="CAST(vec_id % 40 AS VARCHAR)", rows="embeddings", label="label % 2"),
)
def embedding_logistic_baseline(spark, sf):
    """Fitted on the train projects, scored on the others."""
    e = table(spark, sf, "embeddings").withColumns({"y": (F.col("label") % 2).cast("int"), "project": (F.col("vec_id") % 40).cast("string")})
    scored = MD.held_out(e, lambda d: MD.logistic_baseline(d, "embedding", "y", 5), lambda m, d: MD.with_predictions(m, d, "embedding"), "project")
    return _held_counts(scored, "y")


@query(
    "token_forest_baseline", "D11",
    _HELD_SQL.format(project="source", rows="(SELECT * FROM documents JOIN labels USING (doc_id)) d", label="quality"),
)
def token_forest_baseline(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "source", F.col("text").alias("code"), F.col("quality").alias("label")
    )
    scored = MD.held_out(
        d, lambda x: MD.forest_baseline(x, trees=5, dims=64),
        lambda m, x: MD.with_predictions(m, MD.hashed_embedding(x, "code", "vec", 64), "vec"), "source",
    )
    return _held_counts(scored, "label")


@query(
    "graph_file_round_trip", "S3 S4 S5",
    sql("day_nodes") + _CHAIN
    + ", n AS (SELECT file, count(*) AS nodes, count(source_id) AS sources FROM day_nodes GROUP BY file), e AS (SELECT file, count(*) AS edges FROM ch GROUP BY file) "
    "SELECT file, nodes, sources, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (file) "
    "UNION ALL SELECT 'empty/c' || CAST(c_custkey AS STRING), 0, 0, 0 FROM customer",
)
def graph_file_round_trip(spark, sf):
    """Graphs to JSON lines and back to tables, with a graph without nodes per customer."""
    n = day_nodes(spark, sf).select(
        "*", F.lit(None).cast("string").alias("type_hint"), F.array().cast("array<string>").alias("flags")
    )
    e = _chain(spark, sf).select("*", F.lit("CFG").alias("kind"), F.lit(None).cast("map<string,string>").alias("attrs"))
    path = scratch_path(spark, "graphs")
    empty = table(spark, sf, "customer").select(F.concat(F.lit("empty/c"), F.col("c_custkey").cast("string")).alias("file"))
    GR.write_graphs(GR.graph_documents(n, e, graphs=empty), path)
    g = GR.read_graphs(spark, path)
    nodes = GR.nodes_of(g).groupBy("file").agg(
        F.count(F.lit(1)).alias("nodes"), F.count(F.col("attrs")["source_id"]).alias("sources")
    )
    edges = GR.edges_of(g).groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    every = GR.graphs_of(g).select("file").join(nodes, "file", "left").join(edges, "file", "left")
    return every.fillna(0, ["nodes", "sources", "edges"]).select("file", "nodes", "sources", "edges")
