"""Graph construction and rule matching on one generated source file per event: F1, G*, P*, S1-S2, W7, J12, U5, D5, D10."""

from pyspark.sql import functions as F

from codeloom.operators import facts as FA
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.plans import graphs as PG
from codeloom.plans.registry import query
from codeloom.plans.views import VIEWS, sql, table, view
from codeloom.session import bucketed, cut_lineage, grown, spread
from codeloom.sources import files as FI
from codeloom.sources.catalogue import AUTH_DECORATORS, DEFAULT, ENDPOINT_DECORATORS

# What the five generated file shapes hold; tests count the same again by brute force.
NODE_COUNTS = [
    ("signup", "Arg", 2), ("signup", "Assign", 1), ("signup", "Attribute", 5), ("signup", "Call", 3),
    ("signup", "Function", 1), ("signup", "Literal", 4), ("signup", "Module", 1), ("signup", "Name", 9),
    ("signup", "Return", 1), ("signup", "Stmt", 8), ("click", "Arg", 1), ("click", "Assign", 3), ("click",
    "Attribute", 2), ("click", "Call", 2), ("click", "Function", 1), ("click", "Literal", 1), ("click",
    "Module", 1), ("click", "Name", 11), ("click", "Return", 1), ("click", "Stmt", 5), ("error", "Arg", 1),
    ("error", "Assign", 1), ("error", "Attribute", 2), ("error", "Call", 2), ("error", "Except", 1),
    ("error", "Function", 1), ("error", "Literal", 2), ("error", "Module", 1), ("error", "Name", 6),
    ("error", "Stmt", 5), ("error", "Try", 1), ("view", "Arg", 1), ("view", "Assign", 3), ("view",
    "AsyncFor", 1), ("view", "Attribute", 2), ("view", "Call", 1), ("view", "Function", 1), ("view",
    "ListComp", 1), ("view", "Module", 1), ("view", "Name", 19), ("view", "Return", 1), ("view", "Stmt", 4),
    ("view", "With", 1), ("purchase", "Arg", 3), ("purchase", "Assign", 3), ("purchase", "Attribute", 3),
    ("purchase", "AugAssign", 1), ("purchase", "Call", 5), ("purchase", "DictComp", 1), ("purchase",
    "Function", 1), ("purchase", "Generator", 1), ("purchase", "ListComp", 1), ("purchase", "Literal", 2),
    ("purchase", "Module", 1), ("purchase", "Name", 26), ("purchase", "Return", 1), ("purchase", "Stmt", 11),
]
EDGE_COUNTS = [
    ("signup", "AST", 34), ("signup", "CFG", 5), ("signup", "DFG", 7), ("click", "AST", 27), ("click",
    "CFG", 7), ("click", "DFG", 7), ("error", "AST", 22), ("error", "CFG", 5), ("error", "DFG", 4), ("view",
    "AST", 35), ("view", "CFG", 10), ("view", "DFG", 11), ("purchase", "AST", 59), ("purchase", "CFG", 11),
    ("purchase", "DFG", 19),
]
FLOW_LINES = [
    ("signup", 3, 5, 3), ("signup", 4, 5, 1), ("signup", 4, 6, 2), ("signup", 4, 7, 1), ("click", 2, 4, 1),
    ("click", 2, 5, 1), ("click", 2, 8, 1), ("click", 3, 5, 1), ("click", 5, 6, 2), ("click", 8, 9, 1),
    ("error", 2, 4, 2), ("error", 2, 6, 2), ("view", 2, 3, 2), ("view", 2, 4, 1), ("view", 3, 3, 1),
    ("view", 4, 5, 1), ("view", 5, 6, 1), ("view", 7, 7, 2), ("view", 7, 8, 2), ("view", 8, 9, 1),
    ("purchase", 3, 4, 3), ("purchase", 5, 6, 1), ("purchase", 5, 8, 1), ("purchase", 6, 7, 2), ("purchase",
    6, 10, 2), ("purchase", 6, 11, 3), ("purchase", 7, 9, 2), ("purchase", 7, 11, 3), ("purchase", 8, 8, 1),
    ("purchase", 8, 10, 1),
]
CONTROL_LINES = [
    ("signup", 1, 2, 1), ("signup", 2, 3, 1), ("signup", 4, 5, 1), ("signup", 5, 6, 1), ("signup", 6, 7, 1),
    ("click", 1, 2, 1), ("click", 3, 4, 1), ("click", 4, 5, 1), ("click", 4, 8, 1), ("click", 4, 9, 1),
    ("click", 5, 6, 1), ("click", 6, 8, 1), ("error", 1, 2, 1), ("error", 3, 4, 1), ("error", 3, 5, 1),
    ("error", 3, 8, 1), ("error", 4, 8, 1), ("view", 1, 2, 1), ("view", 3, 3, 1), ("view", 3, 4, 1),
    ("view", 4, 5, 1), ("view", 4, 6, 1), ("view", 5, 4, 1), ("view", 6, 7, 1), ("view", 6, 8, 1), ("view",
    7, 6, 1), ("view", 8, 9, 1), ("purchase", 1, 2, 1), ("purchase", 2, 3, 1), ("purchase", 3, 5, 1),
    ("purchase", 6, 7, 1), ("purchase", 7, 7, 1), ("purchase", 7, 8, 1), ("purchase", 8, 9, 1), ("purchase",
    9, 10, 1), ("purchase", 10, 11, 1), ("purchase", 11, 11, 2),
]
UNIT_NODES = [
    ("signup", 29), ("click", 24), ("error", 19), ("view", 32), ("purchase", 48),
]
NORMAL_NAMES = [
    ("signup", "cur", "v1"), ("signup", "List", "v2"), ("signup", "int", "v3"), ("signup", "limit", "v4"),
    ("signup", "q", "v5"), ("signup", "request", "v6"), ("signup", "db", "v7"), ("click", "x", "v1"),
    ("click", "y", "v2"), ("click", "os", "v3"), ("click", "z", "v4"), ("error", "cmd", "v1"), ("error",
    "subprocess", "v2"), ("error", "OSError", "v3"), ("view", "items", "v1"), ("view", "Sequence", "v2"),
    ("view", "str", "v3"), ("view", "out", "v4"), ("view", "i", "v5"), ("view", "n", "v6"), ("view", "open",
    "v7"), ("view", "f", "v8"), ("purchase", "a", "v1"), ("purchase", "b", "v2"), ("purchase", "u", "v3"),
    ("purchase", "k", "v4"), ("purchase", "v", "v5"), ("purchase", "f", "v6"), ("purchase", "z", "v7"),
    ("purchase", "requests", "v8"), ("purchase", "hashlib", "v9"), ("purchase", "g", "v10"), ("purchase",
    "h", "v11"), ("purchase", "app", "v12"),
]
MATCHES = [
    ("signup", 4, "Call", "SRC_FLASK_REQUEST", None, None, None), ("signup", 4, "Attribute",
    "SRC_FLASK_REQUEST", None, None, None), ("signup", 6, "Call", None, "SINK_DBAPI_EXECUTE", None,
    "SAN_SQL_PARAM"), ("click", 3, "Call", "SRC_ENV", None, None, None), ("click", 6, "Call", None,
    "SINK_OS_SYSTEM", None, None), ("error", 4, "Call", None, "SINK_SUBPROCESS", None, None), ("error", 6,
    "Call", None, "SINK_SUBPROCESS", "true", None), ("purchase", 9, "Call", None, "SINK_REQUESTS", None,
    None), ("purchase", 10, "Call", None, "SINK_HASHLIB_WEAK", None, None),
]


_CODE_COLUMNS = VIEWS["code_files"][1]


def _values(rows: list[tuple]) -> str:
    def text(v):
        return "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v).lower()

    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def _per_file(rows: list[tuple], columns: str, select: str) -> str:
    """Each file with the rows of its shape."""
    return (
        f"SELECT 'src/' || event_type || '/f' || CAST(event_id AS STRING) || '.py' AS file, {select} FROM events "
        f"JOIN (VALUES {_values(rows)}) s(shape, {columns}) ON s.shape = event_type"
    )


def _files(spark, sf):
    return table(spark, sf, "events").selectExpr(*_CODE_COLUMNS)


def _facts(spark, sf, columns=None):
    return PG.facts_of(spread(_files(spark, sf), "file"), columns)


def _stored(spark, sf, columns=None):
    return PG.stored_facts(_files(spark, sf), columns)


@query("graph_node_kinds", "F1 G1 G3 G4", _per_file(NODE_COUNTS, "kind, n", "kind, CAST(n AS BIGINT) AS n"))
def graph_node_kinds(spark, sf):
    n = G.graph_nodes(_facts(spark, sf, G.NODE_FACTS))
    return n.groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "graph_edge_counts", "G6 G7 G8 G9 G10 G11 G12 G13 G14 G15 G16 G17 G18 G19",
    _per_file(EDGE_COUNTS, "kind, n", "kind, CAST(n AS BIGINT) AS n"),
)
def graph_edge_counts(spark, sf):
    facts = _stored(spark, sf, G.EDGE_FACTS)
    return G.graph_edges(facts).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))


def _by_line(edges, facts):
    at = G.parsed(facts).select("file", "id", "sl")
    s = at.select("file", F.col("id").alias("src"), F.col("sl").alias("src_line"))
    d = at.select("file", F.col("id").alias("dst"), F.col("sl").alias("dst_line"))
    return edges.join(grown(s), ["file", "src"]).join(grown(d), ["file", "dst"]).groupBy("file", "src_line", "dst_line").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "control_edges_by_line", "G7 G8 G9 G10 G11 G12",
    _per_file(CONTROL_LINES, "src_line, dst_line, n", "src_line, dst_line, CAST(n AS BIGINT) AS n"),
)
def control_edges_by_line(spark, sf):
    facts = _stored(spark, sf, (*G.EDGE_FACTS, "sl"))
    return _by_line(G.sequence_edges(facts).unionByName(G.branch_edges(facts)), facts)


@query(
    "flow_edges_by_line", "G13 G14 G15 G16 G17 G18 G19",
    _per_file(FLOW_LINES, "src_line, dst_line, n", "src_line, dst_line, CAST(n AS BIGINT) AS n"),
)
def flow_edges_by_line(spark, sf):
    facts = _stored(spark, sf, (*G.EDGE_FACTS, "sl"))
    return _by_line(G.flow_edges(facts), facts)


@query(
    "matched_rules", "P2 P3 P4 P5 P6 P7 P8 P9 P10 P11 P12 G20 G21 G22 S16",
    _per_file(
        MATCHES, "line, kind, source_id, sink_id, sink_failed, sanitizer_id",
        "line, kind, source_id, sink_id, sink_failed, sanitizer_id",
    ),
)
def matched_rules(spark, sf):
    n = M.matched_nodes(_stored(spark, sf, M.MATCH_FACTS))
    a = F.col("attrs")
    hit = a["is_source"].isNotNull() | a["is_sink"].isNotNull() | a["sanitizer_id"].isNotNull()
    return n.where(hit).select(
        "file", F.col("span.sl").alias("line"), "kind", a["source_id"].alias("source_id"), a["sink_id"].alias("sink_id"),
        a["sink_constraint_failed"].alias("sink_failed"), a["sanitizer_id"].alias("sanitizer_id"),
    )


@query("tainted_paths", "D6 N1", _per_file([("click", "SINK_OS_SYSTEM", 7)], "sink_id, depth", "sink_id, depth"))
def tainted_paths(spark, sf):
    """Sinks that a source reaches; run on the flow and value edges of the generated files."""
    found = PG.rule_baseline(_stored(spark, sf, PG.BASELINE_FACTS))
    return found.groupBy("file", "sink_id").agg(F.min("depth").alias("depth"))


@query(
    "tainted_witness_lines", "D6 N19",
    _per_file([("click", "SINK_OS_SYSTEM", "3>3>3>5>5>5>5>6")], "sink_id, lines", "sink_id, lines"),
)
def tainted_witness_lines(spark, sf):
    """The lines that a shortest path from a source to a sink goes through, node by node."""
    facts = _stored(spark, sf, PG.BASELINE_FACTS)
    nodes, followed = PG.followed_facts(facts)
    found = cut_lineage(PG.followed_paths(nodes, followed, witnesses=True))
    steps = found.select("file", "sink_id", F.col("id").alias("sink"), F.posexplode("path").alias("step", "id"))
    lines = steps.join(grown(followed.select("file", "id", F.col("sl").alias("line"))), ["file", "id"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "line"))), lambda s: s["line"].cast("string")), ">")
    return lines.groupBy("file", "sink_id", "sink").agg(text.alias("lines")).select("file", "sink_id", "lines")


STEPS = 12  # assignments between the source and the sink of a generated file


@query(
    "tainted_chains", "D6 G15 N1",
    f"SELECT 'chain/c' || CAST(c_custkey AS STRING) || '.py' AS file, 'SINK_OS_SYSTEM' AS sink_id, {3 * STEPS} AS depth FROM customer",
)
def tainted_chains(spark, sf):
    """A value that is handed on by a dozen assignments before it reaches the sink."""
    lines = ["import os", 'v0 = os.getenv("A")', *[f"v{i} = v{i - 1}" for i in range(1, STEPS)], f"os.system(v{STEPS - 1})"]
    code = "\n".join(lines) + "\n"
    files = table(spark, sf, "customer").select(F.concat(F.lit("chain/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file"), F.lit(code).alias("code"))
    found = PG.rule_baseline(PG.stored_facts(files, PG.BASELINE_FACTS))
    return found.groupBy("file", "sink_id").agg(F.min("depth").alias("depth"))


_FRAMEWORKS = {"signup": "flask", "view": "fastapi", "purchase": "flask"}


@query(
    "framework_detection", "P1 G22",
    "SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FRAMEWORKS.items()) + " ELSE '' END AS frameworks FROM events",
)
def framework_detection(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_CODE_COLUMNS[1]))
    return e.select("event_id", F.array_join(M.frameworks_of(F.col("code")), ",").alias("frameworks"))


@query(
    "file_status", "S2",
    "SELECT status, count(*) AS files FROM (SELECT CASE WHEN contains(text, chr(10)) OR contains(text, ' ') OR contains(text, '.') OR text NOT SIMILAR TO '[A-Za-z]+' THEN 'unparsable' ELSE 'ok' END AS status "
    "FROM documents UNION ALL SELECT 'ok' FROM events) GROUP BY status",
)
def file_status(spark, sf):
    """Prose does not parse as Python, the generated files do."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("code"))
    files = spread(docs.unionByName(_files(spark, sf)), "file")
    return FI.status_counts(FA.extract_facts(files, ("file", "status", "id")))


_INVENTORY = [
    ("signup", "flask", "local"), ("signup", "sqlite3", "local"), ("click", "os", "standard"),
    ("error", "subprocess", "standard"), ("view", "fastapi", "local"), ("purchase", "flask", "local"),
    ("purchase", "requests", "local"), ("purchase", "hashlib", "standard"),
]


@query(
    "import_inventory", "G25 G20",
    f"SELECT module, origin, count(*) AS files FROM events JOIN (VALUES {_values(_INVENTORY)}) s(shape, module, origin) ON s.shape = event_type GROUP BY module, origin",
)
def import_inventory(spark, sf):
    i = G.import_inventory(_facts(spark, sf))
    return i.groupBy("module", "origin").agg(F.count(F.lit(1)).alias("files"))


_ALIASES = [
    ("signup", "request", "flask.request"), ("signup", "db", "sqlite3"), ("click", "os", "os"),
    ("error", "subprocess", "subprocess"), ("view", "Request", "fastapi.Request"), ("purchase", "Flask", "flask.Flask"),
    ("purchase", "requests", "requests"), ("purchase", "hashlib", "hashlib"),
]


@query("import_aliases", "G20", _per_file(_ALIASES, "alias, path", "alias, path"))
def import_aliases(spark, sf):
    return M.last_aliases(_facts(spark, sf)).select("file", "alias", "path")


@query(
    "unguarded_endpoints", "D10",
    "SELECT 'src/purchase/f' || CAST(event_id AS STRING) || '.py' AS file, 'pay' || CAST(event_id AS STRING) AS symbol, 5 AS line FROM events WHERE event_type = 'purchase'",
)
def unguarded_endpoints(spark, sf):
    u = G.unguarded_endpoints(_facts(spark, sf), ENDPOINT_DECORATORS, AUTH_DECORATORS)
    return u.select("file", "symbol", "line")


@query("function_units", "D5", _per_file(UNIT_NODES, "n", "CAST(n AS BIGINT) AS n"))
def function_units(spark, sf):
    """Nodes inside a function, per file."""
    f = G.function_units(_facts(spark, sf, G.UNIT_FACTS)).where("function_id <> 0")
    return f.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("normalised_names", "D5", _per_file(NORMAL_NAMES, "name, normal_name", "name, normal_name"))
def normalised_names(spark, sf):
    n = G.normalised_names(_facts(spark, sf, G.UNIT_FACTS)).where("function_id <> 0")
    return n.select("file", "name", "normal_name").distinct()


def _pattern_sql() -> str:
    """Pattern inference as a scored join with the catalogue."""
    rows = []
    for i, p in enumerate(DEFAULT.patterns):
        bonus = next((words for part, words in M.KEYWORD_BONUS.items() if part in p["id"].lower()), [])
        rows.append(
            f"({i}, '{p['id']}', {p['sources']!r}, {[s['id'] for s in p['sinks']]!r}, {[s['kind'] for s in p['sinks']]!r}, {bonus!r}::VARCHAR[])"
        )
    return ", ".join(rows)


_ASKED = (
    "SELECT event_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SRC_ENV' WHEN 2 THEN 'SRC_OTHER' ELSE 'SRC_ARGPARSE' END AS s, "
    "CASE event_type WHEN 'signup' THEN 'SINK_DBAPI_EXECUTE' WHEN 'click' THEN 'SINK_OS_SYSTEM' WHEN 'view' THEN 'SINK_UNKNOWN' END AS t, "
    "CASE WHEN event_type IN ('view', 'purchase') THEN CASE event_id % 3 WHEN 0 THEN 'http_client' WHEN 1 THEN 'html_sink' ELSE 'none' END END AS k, "
    "CASE event_id % 5 WHEN 0 THEN 'HTTPX.get(u)' WHEN 1 THEN 'os.popen(x)' WHEN 2 THEN 'Markup(x)' WHEN 3 THEN 'cursor.execute(q)' END AS c FROM events"
)


@query(
    "inferred_patterns", "W7",
    f"WITH a AS ({_ASKED}), p AS (SELECT * FROM (VALUES {_pattern_sql()}) v(ord, pattern_id, sources, sinks, kinds, words)), "
    "x AS (SELECT event_id, ord, pattern_id, CASE WHEN coalesce(s, '') = '' THEN 0 WHEN list_contains(sources, s) THEN 10 WHEN len(list_filter(sources, lambda y: starts_with(y, split_part(s, '_', 1)))) > 0 THEN 5 ELSE 0 END "
    "+ CASE WHEN list_contains(sinks, t) THEN 10 ELSE 0 END + CASE WHEN coalesce(k, '') <> '' AND list_contains(kinds, k) THEN 8 ELSE 0 END "
    "+ CASE WHEN len(list_filter(words, lambda y: contains(lower(c), y))) > 0 THEN 5 ELSE 0 END AS score FROM a, p WHERE t IS NOT NULL OR k IS NOT NULL) "
    "SELECT a.event_id, b.pattern_id, b.score FROM a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, ord) AS r FROM x WHERE score > 0) WHERE r = 1) b USING (event_id)",
)
def inferred_patterns(spark, sf):
    a = table(spark, sf, "events").select("event_id", *[F.expr(e).alias(n) for e, n in _asked_columns()])
    p = M.inferred_pattern(F.col("s"), F.col("t"), F.col("k"), F.col("c"))
    return a.select("event_id", p["pattern_id"].alias("pattern_id"), p["score"].alias("score"))


def _asked_columns():
    body = _ASKED[len("SELECT event_id, "): -len(" FROM events")]
    return [(part.rsplit(" AS ", 1)[0], part.rsplit(" AS ", 1)[1]) for part in body.replace(" AS s, ", " AS s@").replace(" AS t, ", " AS t@").replace(" AS k, ", " AS k@").split("@")]


@query(
    "pattern_enrichment", "J12 U5",
    sql("findings")
    + f", p AS (SELECT * FROM (VALUES {', '.join('(' + str(i) + ', ' + repr(p['id']) + ', ' + repr(p['owasp']) + ', ' + repr(p['cwe'][0]) + ')' for i, p in enumerate(DEFAULT.patterns))}) v(ord, pattern_id, owasp, cwe_id)), "
    "f AS (SELECT finding_id, CAST(substr(rule_id, 2) AS INTEGER) AS o FROM findings) SELECT f.finding_id, p.pattern_id, p.owasp, p.cwe_id FROM f LEFT JOIN p ON p.ord = f.o",
)
def pattern_enrichment(spark, sf):
    from codeloom.operators.findings import with_pattern_info

    p = DEFAULT.pattern_table(spark)
    f = view(spark, sf, "findings").select("finding_id", F.expr("CAST(substr(rule_id, 2) AS INT)").alias("ord"))
    named = f.join(F.broadcast(p.select("ord", "pattern_id")), "ord", "left")
    return with_pattern_info(named, p).select("finding_id", "pattern_id", "owasp", "cwe_id")


@query(
    "findings_by_owasp_and_cwe", "U5 J12",
    sql("findings")
    + f", p AS (SELECT * FROM (VALUES {', '.join('(' + str(i) + ', ' + repr(p['owasp']) + ', ' + repr(p['cwe']) + '::VARCHAR[])' for i, p in enumerate(DEFAULT.patterns))}) v(ord, owasp, cwe)) "
    "SELECT p.owasp, list_contains(p.cwe, 'CWE-918') AS request_forgery, count(*) AS n FROM findings JOIN p ON p.ord = CAST(substr(rule_id, 2) AS INTEGER) "
    "WHERE p.owasp = 'A03: Injection' OR list_contains(p.cwe, 'CWE-918') GROUP BY 1, 2",
)
def findings_by_owasp_and_cwe(spark, sf):
    from codeloom.operators.findings import patterns_by_cwe, patterns_by_owasp

    p = DEFAULT.pattern_table(spark)
    wanted = patterns_by_owasp(p, "A03: Injection").unionByName(patterns_by_cwe(p, "CWE-918"))
    f = view(spark, sf, "findings").select(F.expr("CAST(substr(rule_id, 2) AS INT)").alias("ord"))
    kept = f.join(F.broadcast(wanted), "ord").join(F.broadcast(p.select("pattern_id", "owasp", "cwe")), "pattern_id")
    return kept.groupBy("owasp", F.array_contains("cwe", "CWE-918").alias("request_forgery")).agg(F.count(F.lit(1)).alias("n"))


_SCANNED = [("signup", "SQLI_RAW_STRING_FORMAT", "A03: Injection", "CWE-89"), ("click", "CMDI_OS_SYSTEM_TAINTED", "A03: Injection", "CWE-78"),
            ("error", None, None, None), ("view", None, None, None), ("purchase", None, None, None)]


@query(
    "scan_findings", "K2 K3 N12 N18 J11 J12 W7 L1",
    _per_file(_SCANNED, "pattern_id, owasp, cwe_id", "pattern_id, owasp, cwe_id") + " ORDER BY file LIMIT 100",
)
def scan_findings(spark, sf):
    """From source files to the 100 best findings, with a scorer that calls every file vulnerable."""
    facts = _stored(spark, sf, M.MATCH_FACTS)
    nodes = bucketed(M.matched_nodes(facts), ["file"], "nodes")
    return PG.scan_findings(nodes, [0.0] * 32, 1.0, 100, 16).select("file", "pattern_id", "owasp", "cwe_id")


@query(
    "graphs_with_recorded_flows", "N5 J4 T5 F1",
    "SELECT kind, count(*) AS n FROM (SELECT 'DDFG' AS kind FROM events WHERE event_type = 'click' UNION ALL "
    f"SELECT s.kind FROM events JOIN (VALUES {_values(EDGE_COUNTS)}) s(shape, kind, n) ON s.shape = event_type, range(s.n)) GROUP BY kind",
)
def graphs_with_recorded_flows(spark, sf):
    """Static graphs merged with one runtime record per click file: from the getenv call to os.system."""
    files = _files(spark, sf)
    p = "struct<file:string,line:int,col:int>"
    records = table(spark, sf, "events").where("event_type = 'click'").select(
        F.col("event_id").alias("record"), F.expr(_CODE_COLUMNS[0]),
    ).select(
        "record", F.expr(f"CAST(named_struct('file', file, 'line', 3, 'col', 8) AS {p})").alias("source"),
        F.expr(f"CAST(named_struct('file', file, 'line', 6, 'col', 8) AS {p})").alias("sink"),
        F.expr(f"CAST(array() AS array<{p}>)").alias("path"), F.expr("map('tool', 'trace')").alias("meta"),
    )
    _, edges, _ = PG.build_graphs(files, records)
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
