"""Runtime taint: T1-T6, J2-J5, N5, U3, S6, S7."""

from pyspark.sql import functions as F

from codeloom.operators import taint as TA
from codeloom.plans.registry import query
from codeloom.plans.views import day_nodes, sql, table, view
from codeloom.session import cut_lineage
from codeloom.sources import taint_log as L


def _pos(j: str, *spellings: tuple[str, str, str]) -> str:
    """file:line:col of a JSON position in SQL, null if no spelling fits."""
    arms = " ".join(
        f"WHEN json_exists({j}, '$.{f}') AND json_exists({j}, '$.{l}') THEN ({j}->>'$.{f}') || ':' || ({j}->>'$.{l}') || ':' || coalesce({j}->>'$.{c}', '')"
        for f, l, c in spellings
    )
    return f"CASE {arms} END"


_ALL = [("file", "line", "col"), ("filename", "lineno", "column"), ("path", "line", "column")]
_NORMAL = (
    sql("taint_lines")
    + ", j AS (SELECT event_id, CAST(value AS JSON) AS j FROM taint_lines WHERE json_valid(value)), "
    f"n AS (SELECT event_id, CASE WHEN json_exists(j, '$.sink') THEN {_pos('(j->' + chr(39) + '$.source' + chr(39) + ')', _ALL[0])} "
    f"WHEN json_exists(j, '$.taint_sink') THEN {_pos('(j->' + chr(39) + '$.taint_source' + chr(39) + ')', *_ALL)} ELSE {_pos('(j->' + chr(39) + '$.from' + chr(39) + ')', *_ALL)} END AS source, "
    f"CASE WHEN json_exists(j, '$.sink') THEN {_pos('(j->' + chr(39) + '$.sink' + chr(39) + ')', _ALL[0])} "
    f"WHEN json_exists(j, '$.taint_sink') THEN {_pos('(j->' + chr(39) + '$.taint_sink' + chr(39) + ')', *_ALL)} ELSE {_pos('(j->' + chr(39) + '$.to' + chr(39) + ')', *_ALL)} END AS sink, "
    "CASE WHEN json_exists(j, '$.sink') THEN 'taint_kind=http' WHEN json_exists(j, '$.taint_sink') THEN 'sink_type=sql,taint_kind=cli' ELSE 'tool=' || (j->>'$.tool') END AS meta, "
    "CASE WHEN json_exists(j, '$.sink') OR json_exists(j, '$.taint_sink') THEN 1 ELSE 0 END AS steps FROM j) "
)


def _flat(p):
    return F.concat_ws(":", p["file"], p["line"].cast("string"), F.coalesce(p["col"].cast("string"), F.lit("")))


@query("normalised_taint_records", "T1 T2 T3 T4 S6", _NORMAL + "SELECT event_id, source, sink, meta, steps FROM n WHERE source IS NOT NULL AND sink IS NOT NULL")
def normalised_taint_records(spark, sf):
    r = L.taint_records(view(spark, sf, "taint_lines"))
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return r.select(
        "event_id", _flat(F.col("source")).alias("source"), _flat(F.col("sink")).alias("sink"), meta.alias("meta"),
        F.size("path").alias("steps"),
    )


@query(
    "taint_conversion_counts", "S7",
    _NORMAL + "SELECT count(*) FILTER (WHERE source IS NOT NULL AND sink IS NOT NULL) AS converted, (SELECT count(*) FROM taint_lines) - count(*) FILTER (WHERE source IS NOT NULL AND sink IS NOT NULL) AS skipped FROM n",
)
def taint_conversion_counts(spark, sf):
    return L.conversion_counts(view(spark, sf, "taint_lines"))


# Positions: every event asks for the node at its own minute, in the file of its user and day.
_POSITIONS = (
    sql("day_nodes")
    + ", p AS (SELECT DISTINCT file, CAST(sl + 1 AS INTEGER) AS line, CASE WHEN id % 3 = 0 THEN NULL ELSE sc END AS col, CASE kind WHEN 'Call' THEN 'source' WHEN 'Stmt' THEN 'sink' ELSE 'path' END AS role FROM day_nodes), "
    "c AS (SELECT p.*, d.id, d.kind, d.el - d.sl AS dl, d.ec - d.sc AS dc FROM p JOIN day_nodes d ON p.file = d.file AND p.line BETWEEN d.sl AND d.el AND "
    "(p.col IS NULL OR ((p.line <> d.sl OR p.col >= d.sc) AND (p.line <> d.el OR p.col <= d.ec)))), "
    "r AS (SELECT *, CASE role WHEN 'sink' THEN CASE WHEN kind IN ('Call', 'Attribute') THEN 0 WHEN kind IN ('Name', 'Literal') THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END "
    "WHEN 'source' THEN CASE WHEN kind IN ('Name', 'Attribute') THEN 0 WHEN kind IN ('Call', 'Literal') THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END "
    "ELSE CASE WHEN kind IN ('Call', 'Attribute', 'Name') THEN 0 WHEN kind = 'Literal' THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END END AS pr FROM c), "
    "b AS (SELECT file, line, col, role, id FROM (SELECT *, row_number() OVER (PARTITION BY file, line, col, role ORDER BY pr, dl, dc, id) AS k FROM r) WHERE k = 1) "
)


def _positions(spark, sf):
    role = F.expr("CASE kind WHEN 'Call' THEN 'source' WHEN 'Stmt' THEN 'sink' ELSE 'path' END")
    return view(spark, sf, "day_nodes").select(
        "file", (F.col("sl") + 1).alias("line"), F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE sc END").alias("col"), role.alias("role")
    )


@query("nodes_at_positions", "J2 J3", _POSITIONS + "SELECT file, line, col, role, id FROM b")
def nodes_at_positions(spark, sf):
    return TA.node_at_position(_positions(spark, sf), day_nodes(spark, sf))


def _records(spark, sf):
    """One record per event: from its own start, through the minute after, to its end."""
    d = view(spark, sf, "day_nodes")

    def pos(line, col):
        return F.struct(F.col("file").alias("file"), line.cast("int").alias("line"), col.cast("int").alias("col"))

    none = F.lit(None)
    return d.select(
        F.col("id").alias("record"), pos(F.col("sl"), F.col("sc")).alias("source"), pos(F.col("el"), none).alias("sink"),
        F.array(pos(F.col("sl") + 1, none)).alias("path"),
        F.expr("CASE WHEN id % 4 = 0 THEN map() ELSE map('tool', symbol) END").cast("map<string,string>").alias("meta"),
    )


_MAPPED = (
    sql("day_nodes")
    + ", p AS (SELECT id AS record, file, 0 AS step, 'source' AS role, sl AS line, sc AS col FROM day_nodes UNION ALL SELECT id, file, 1, 'path', sl + 1, NULL FROM day_nodes "
    "UNION ALL SELECT id, file, 2, 'sink', el, NULL FROM day_nodes), "
    "c AS (SELECT p.*, d.id, d.kind, d.el - d.sl AS dl, d.ec - d.sc AS dc FROM p JOIN day_nodes d ON p.file = d.file AND p.line BETWEEN d.sl AND d.el AND "
    "(p.col IS NULL OR ((p.line <> d.sl OR p.col >= d.sc) AND (p.line <> d.el OR p.col <= d.ec)))), "
    "r AS (SELECT *, CASE role WHEN 'sink' THEN CASE WHEN kind IN ('Call', 'Attribute') THEN 0 WHEN kind IN ('Name', 'Literal') THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END "
    "WHEN 'source' THEN CASE WHEN kind IN ('Name', 'Attribute') THEN 0 WHEN kind IN ('Call', 'Literal') THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END "
    "ELSE CASE WHEN kind IN ('Call', 'Attribute', 'Name') THEN 0 WHEN kind = 'Literal' THEN 1 WHEN kind = 'Stmt' THEN 3 ELSE 2 END END AS pr FROM c), "
    "b AS (SELECT record, step, id FROM (SELECT *, row_number() OVER (PARTITION BY record, step ORDER BY pr, dl, dc, id) AS k FROM r) WHERE k = 1), "
    "m AS (SELECT d.id AS record, d.file, s.id AS source_id, w.id AS mid, t.id AS sink_id, CASE WHEN d.id % 4 <> 0 THEN d.symbol END AS tool FROM day_nodes d "
    "LEFT JOIN b s ON s.record = d.id AND s.step = 0 LEFT JOIN b w ON w.record = d.id AND w.step = 1 LEFT JOIN b t ON t.record = d.id AND t.step = 2) "
)


@query("mapped_taint_records", "J4", _MAPPED + "SELECT record, source_id, sink_id, coalesce(CAST(mid AS STRING), '') AS path_ids FROM m")
def mapped_taint_records(spark, sf):
    m = TA.mapped_records(_records(spark, sf), day_nodes(spark, sf))
    return m.select("record", "source_id", "sink_id", F.array_join(F.col("path_ids").cast("array<string>"), ",").alias("path_ids"))


@query(
    "recorded_flow_edges", "N5 U3 T4 T5",
    _MAPPED
    + ", e AS (SELECT file, source_id AS src, coalesce(mid, sink_id) AS dst, record, tool FROM m WHERE source_id IS NOT NULL AND sink_id IS NOT NULL "
    "UNION ALL SELECT file, mid, sink_id, record, tool FROM m WHERE source_id IS NOT NULL AND sink_id IS NOT NULL AND mid IS NOT NULL) "
    "SELECT file, src, dst, tool FROM (SELECT *, row_number() OVER (PARTITION BY file, src, dst ORDER BY record) AS k FROM e WHERE src <> dst) WHERE k = 1",
)
def recorded_flow_edges(spark, sf):
    mapped = cut_lineage(TA.mapped_records(_records(spark, sf), day_nodes(spark, sf)))
    loops = mapped.select("file", F.col("source_id").alias("src"), F.col("source_id").alias("dst"))
    every = loops.unionByName(mapped.select("file", F.col("sink_id").alias("src"), F.col("sink_id").alias("dst")))
    # edges from a node to itself are taken as known already
    known = every.withColumn("kind", F.lit("DDFG"))
    e = TA.recorded_flow_edges(mapped, known)
    return e.select("file", "src", "dst", F.col("attrs")["tool"].alias("tool"))


@query(
    "recorded_edge_counts", "T5",
    _MAPPED
    + ", e AS (SELECT file, source_id AS src, coalesce(mid, sink_id) AS dst FROM m WHERE source_id IS NOT NULL AND sink_id IS NOT NULL "
    "UNION SELECT file, mid, sink_id FROM m WHERE source_id IS NOT NULL AND sink_id IS NOT NULL AND mid IS NOT NULL) SELECT file, count(*) AS ddfg_edges FROM e GROUP BY file",
)
def recorded_edge_counts(spark, sf):
    return TA.recorded_edge_counts(TA.recorded_flow_edges(TA.mapped_records(_records(spark, sf), day_nodes(spark, sf))))


@query(
    "files_with_records", "J5",
    sql("day_nodes", "taint_lines")
    + ", r AS (SELECT (CAST(value AS JSON)->>'$.source.file') AS f, min(event_id) AS record FROM taint_lines WHERE json_valid(value) AND json_exists(CAST(value AS JSON), '$.sink') GROUP BY 1) "
    "SELECT DISTINCT 'u' || CAST(user_id AS STRING) || '.py' AS file, r.record FROM events JOIN r ON r.f = 'u' || CAST(user_id AS STRING) || '.py'",
)
def files_with_records(spark, sf):
    r = L.taint_records(view(spark, sf, "taint_lines")).withColumnRenamed("event_id", "record").where("source.col IS NOT NULL")
    canonical = r.where(F.col("meta")["taint_kind"] == "http")
    graphs = table(spark, sf, "events").select(F.expr("'u' || CAST(user_id AS STRING) || '.py'").alias("file")).distinct()
    return TA.graphs_with_records(graphs, canonical).join(TA.first_record_per_file(canonical), "file")


_CALLS = (
    "WITH m AS (SELECT user_id % 97 AS object_id, ts, event_id AS source FROM events WHERE event_type = 'signup'), "
    "a AS (SELECT user_id % 97 AS object_id, ts, event_id - event_id % 3 AS call_id, CAST(event_id % 3 AS INTEGER) AS arg_pos, event_type AS sink_type FROM events WHERE event_type IN ('click', 'purchase')), "
    "j AS (SELECT a.*, (SELECT max_by(m.source, m.ts) FROM m WHERE m.object_id = a.object_id AND m.ts <= a.ts) AS source FROM a) "
)


@query(
    "tainted_sink_calls", "T6",
    _CALLS + "SELECT call_id, source, sink_type FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY arg_pos) AS k FROM j WHERE source IS NOT NULL) WHERE k = 1",
)
def tainted_sink_calls(spark, sf):
    e = table(spark, sf, "events").withColumn("object_id", F.col("user_id") % 97)
    marks = e.where("event_type = 'signup'").select("object_id", "ts", F.col("event_id").alias("source"))
    args = e.where("event_type IN ('click', 'purchase')").select(
        "object_id", "ts", (F.col("event_id") - F.col("event_id") % 3).alias("call_id"),
        (F.col("event_id") % 3).cast("int").alias("arg_pos"), F.col("event_id").alias("sink"), F.col("event_type").alias("sink_type"),
    )
    calls = TA.tainted_calls(marks, args, ["object_id"])
    return calls.select("call_id", "source", F.col("meta")["sink_type"].alias("sink_type"))
