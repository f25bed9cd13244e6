"""Views that let the driver tables play the library's inputs.

A view is written once, in expressions that Spark and ANSI SQL read alike, over whole tables.
``view`` gives it as a DataFrame and ``sql`` as common table expressions for the checking query.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = " || chr(10) || "


def _s(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _lines(*lines: str) -> str:
    """SQL text expression of several lines; {id} stands for the event id."""
    return NL.join("'" + line.replace("{id}", "' || " + _s("event_id") + " || '") + "'" for line in lines) + " || chr(10)"


# One Python file per event, one shape per event type.
CODE_SHAPES = {
    "signup": [
        "from flask import request",
        "import sqlite3 as db",
        "def load{id}(cur: List[int], limit=10):",
        '    q = request.args.get("q")',
        '    cur.execute("select * from t where a = " + q)',
        '    db.Cursor.execute("select %s", q)',
        "    return q",
    ],
    "click": [
        "import os",
        "def run{id}(x):",
        '    y = os.getenv("A")',
        "    if x:",
        "        z = y + x",
        "        os.system(z)",
        "    else:",
        "        y = x",
        "    return y",
    ],
    "error": [
        "import subprocess",
        "def call{id}(cmd):",
        "    try:",
        "        subprocess.run(cmd, shell=True)",
        "    except OSError:",
        "        subprocess.run(cmd)",
        "    finally:",
        "        cmd = None",
    ],
    "view": [
        "from fastapi import Request",
        "async def show{id}(items: Sequence[str]) -> str:",
        "    out = [i.name for i in items if i]",
        "    async for n in items:",
        "        out = n",
        "    while out:",
        "        out = out.next",
        "    with open(out) as f:",
        "        return f",
    ],
    "purchase": [
        "from flask import Flask",
        "import requests, hashlib",
        "app = Flask(__name__)",
        '@app.route("/p{id}")',
        "def pay{id}(a, b=1):",
        "    a += b",
        "    u = {k: v for k, v in a}",
        "    f = lambda z: z + b",
        "    requests.get(u)",
        "    hashlib.md5(f(a))",
        "    return [g for g in (h + a for h in u)]",
    ],
}
_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {_lines(*v)}" for k, v in CODE_SHAPES.items()) + " END"

_DAY_FILE = (
    "'p' || CAST(user_id % 10 AS STRING) || '/u' || CAST(user_id AS STRING) || '/d' || "
    "CAST(extract(day FROM ts) AS STRING) || '.py'"
)
_START = "CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT)"

# Fixed phrases for generated commit messages, one per vulnerability type and some without any.
PHRASES = [
    "SQL injection", "reflected XSS", "command injection", "path traversal", "XXE parsing",
    "SSRF guard", "CSRF token", "unsafe pickle", "auth bypass", "privilege escalation", "data leak",
    "weak hash", "integer overflow", "race condition", "hardcoded password", "eval() use",
    "ReDoS pattern", "misconfiguration", "dependency bump", "typo", "docs", "tests", "naming",
]
_PHRASE = "CASE o_orderkey % 23 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"
_MESSAGE = (
    f"'Fix ' || {_PHRASE} || ' in order ' || {_s('o_orderkey')}"
    f" || CASE WHEN o_orderkey % 3 = 0 THEN ' (cve-2023-' || {_s('10000 + o_orderkey % 90000')} || ')' ELSE '' END"
    f" || CASE WHEN o_orderkey % 5 = 0 THEN ' CWE' || {_s('20 + o_orderkey % 900')} ELSE '' END"
)
_SEVERITY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
    "WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"
)
_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fixed' ELSE 'ignored' END"
_POS = "'{{\"{f}\": \"u' || CAST(user_id AS STRING) || '.py\", \"{l}\": ' || CAST({line} AS STRING) || ', \"{c}\": ' || CAST(user_id % 7 AS STRING) || '}}'"


def _pos(f: str, l: str, c: str, line: str) -> str:
    return _POS.format(f=f, l=l, c=c, line=line)


_TAINT = (
    "CASE event_type"
    f" WHEN 'signup' THEN '{{\"source\": ' || {_pos('file', 'line', 'col', 'event_id % 50')} || ', \"sink\": ' || "
    f"{_pos('file', 'line', 'col', '50 + event_id % 50')} || ', \"path\": [' || {_pos('file', 'line', 'col', '25')} || "
    "'], \"meta\": {\"taint_kind\": \"http\"}}'"
    f" WHEN 'click' THEN '{{\"taint_source\": ' || {_pos('filename', 'lineno', 'column', 'event_id % 50')} || "
    f"', \"taint_sink\": ' || {_pos('path', 'line', 'column', '60')} || ', \"trace\": [' || "
    f"{_pos('file', 'line', 'col', '30')} || ', {{\"x\": 1}}], \"taint_type\": \"cli\", \"sink_type\": \"sql\"}}'"
    f" WHEN 'view' THEN '{{\"from\": ' || {_pos('file', 'line', 'col', 'event_id % 50')} || ', \"to\": ' || "
    f"{_pos('file', 'line', 'col', '70')} || ', \"via\": [], \"tool\": \"x' || CAST(user_id % 3 AS STRING) || '\"}}'"
    " WHEN 'error' THEN '{broken ' || props"
    " ELSE '{\"source\": {\"file\": \"a.py\"}, \"value\": ' || CAST(event_id AS STRING) || '}' END"
)

# name -> (table or join, expressions, condition)
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    # a graph per user and day; events are its nodes
    "day_nodes": (
        "events",
        [
            f"{_DAY_FILE} AS file", "event_id AS id",
            "CASE event_type WHEN 'signup' THEN 'Call' WHEN 'click' THEN 'Name' WHEN 'view' THEN 'Attribute' "
            "WHEN 'error' THEN 'Literal' ELSE 'Stmt' END AS kind",
            f"{_START} AS sl", "CAST(event_id % 40 AS INT) AS sc",
            f"{_START} + CAST(floor(value / 10) AS INT) AS el", "CAST(event_id % 40 + 20 AS INT) AS ec",
            "CASE WHEN event_type = 'signup' THEN CASE WHEN value < 40 THEN 'os.Popen' ELSE 'f.g' END || '(' || props || ')' "
            "WHEN event_type = 'click' AND value < 40 THEN 'Request.x' ELSE event_type || '(' || props || ')' END AS code",
            "'v' || CAST(event_id % 9 AS STRING) AS symbol",
            "CASE WHEN event_type = 'signup' THEN CASE WHEN value < 20 THEN 'SRC_ENV' ELSE 'SRC_FLASK_REQUEST' END END AS source_id",
            "CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN 'SINK_OS_SYSTEM' ELSE 'SINK_DBAPI_EXECUTE' END END AS sink_id",
            "CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN 'cmd_exec' ELSE 'sql_exec' END END AS sink_kind",
            "CASE WHEN event_type = 'purchase' AND value > 60 THEN 'true' END AS sink_failed",
            "CASE WHEN event_type = 'view' AND value < 40 THEN 'html_escape' END AS sanitizer_kind",
        ],
        None,
    ),
    # a small graph per order; parts and suppliers are its nodes
    "order_edges": (
        "lineitem",
        [
            "'o' || CAST(l_orderkey AS STRING) AS file", "l_partkey * 2 AS src", "l_suppkey * 2 + 1 AS dst",
            "CASE WHEN l_linestatus = 'O' THEN 'DFG' WHEN l_returnflag = 'A' THEN 'AST' WHEN l_returnflag = 'N' THEN 'CFG' "
            "ELSE 'JUMP' END AS kind",
        ],
        None,
    ),
    # one graph over everything: orders (even) to parts (odd)
    "shop_edges": (
        "lineitem", ["'shop' AS file", "l_orderkey * 2 AS src", "l_partkey * 2 + 1 AS dst"], None,
    ),
    "shop_seeds": (
        "orders", ["'shop' AS file", "o_orderkey * 2 AS id"],
        "o_orderpriority = '1-URGENT' AND o_totalprice > 480000",
    ),
    "code_files": ("events", [f"'src/' || event_type || '/f' || {_s('event_id')} || '.py' AS file", f"{_CODE} AS code"], None),
    "commits": (
        "orders",
        [
            f"md5('c' || {_s('o_orderkey')}) AS sha", f"md5('c' || {_s('o_orderkey - 1')}) AS parent_sha",
            f"{_MESSAGE} AS message", f"'org' || {_s('o_custkey % 50')} || '/repo' || {_s('o_custkey')} AS repo_name",
            "o_orderkey AS seq",
        ],
        None,
    ),
    "commit_feed": (
        "orders",
        [
            f"'{{\"sha\": \"' || md5('c' || {_s('o_orderkey')}) || '\", \"commit\": {{\"message\": \"' || {_MESSAGE} || "
            f"'\"' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ', \"author\": {{\"name\": \"a' || {_s('o_custkey')} || "
            f"'\", \"date\": \"2024-01-01\"}}' END || '}}, \"repository\": {{\"html_url\": \"' || "
            f"CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'https://github.com/org/r' || {_s('o_custkey')} END || "
            f"'\", \"url\": \"https://api.test/r' || {_s('o_custkey')} || '\", \"full_name\": \"org/r' || {_s('o_custkey')} || "
            f"'\"}}, \"parents\": [{{\"sha\": \"' || md5('c' || {_s('o_orderkey - 1')}) || '\"}}], \"files\": ["
            f"{{\"filename\": \"src/m' || {_s('o_custkey % 7')} || '.py\", \"status\": \"' || "
            f"CASE WHEN o_orderkey % 6 = 0 THEN 'removed' ELSE 'modified' END || '\", \"additions\": 3}}, "
            f"{{\"filename\": \"README.md\", \"status\": \"modified\"}}]}}' AS value",
        ],
        None,
    ),
    "vuln_records": (
        "documents",
        [
            "doc_id AS record_id",
            f"CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'CVE-2023-' || {_s('1000 + n_chars % 60')} END AS cve_id",
            f"CASE WHEN doc_id % 3 = 0 THEN 'CWE-' || {_s('n_chars % 20')} END AS cwe_id",
            "'https://github.com/acme/' || source AS repo_url", f"md5('b' || {_s('doc_id')}) AS commit_before",
            f"md5('a' || {_s('doc_id')}) AS commit_after", f"'pkg/mod' || {_s('n_chars % 80')} || '.v2.py' AS file_path",
            "CASE lang WHEN 'en' THEN 'XSS' WHEN 'de' THEN 'SQL Injection' WHEN 'fr' THEN 'SSRF' END AS vulnerability_type",
            "source || ' report: ' || CASE WHEN n_chars % 5 = 0 THEN 'fixes sql injection' WHEN n_chars % 5 = 1 THEN 'weak hash' "
            "ELSE 'cleanup' END AS description",
            "text AS code_before",
            "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text || chr(10) || 'pass' END AS code_after",
            "doc_id % 5 = 0 AS synthetic",
        ],
        None,
    ),
    "safe_files": (
        "pages",
        [
            "url AS repo_url", f"CASE WHEN page_id % 5 = 0 THEN 'tests/' ELSE 'src/' END || 'p' || {_s('page_id')} || '.py' AS file_path",
            "CASE WHEN page_id % 6 = 0 THEN NULL ELSE 'HEAD' END AS commit", "html AS code",
        ],
        None,
    ),
    "samples": (
        "documents",
        [
            "doc_id AS sample_id", "source AS project",
            "CASE WHEN doc_id % 10 < 3 THEN 1 ELSE 0 END AS label",
            "CASE WHEN doc_id % 10 < 3 THEN 'vulnerable' WHEN doc_id % 10 < 6 THEN 'fixed' ELSE 'originally_safe' END AS sample_type",
            "lang AS framework", "CASE lang WHEN 'en' THEN 'real' WHEN 'de' THEN 'synthetic' ELSE 'augmented' END AS origin",
        ],
        None,
    ),
    "label_rows": (
        "labels JOIN documents USING (doc_id)",
        [
            "doc_id", "quality AS label",
            "CASE WHEN n_chars % 3 = 0 THEN 'P_' || source WHEN n_chars % 3 = 1 THEN '' END AS pattern_id",
            "CASE WHEN n_chars % 2 = 0 THEN lang END AS vulnerability_type",
            "CASE WHEN doc_id % 6 = 0 THEN 'Synthetic_pair' ELSE 'vulnerable' END AS sample_type",
            "CASE WHEN doc_id % 11 = 0 THEN 'made by synthetic run' ELSE '' END AS meta_text",
            "CASE WHEN doc_id % 2 = 0 THEN 'https://github.com/a/b' END AS repo_url",
            "CASE WHEN doc_id % 5 = 0 THEN 'CVE-2020-1111' ELSE '' END AS cve_id", "CAST(NULL AS STRING) AS commit",
            "CASE WHEN doc_id % 4 = 0 THEN 'app_Django/' ELSE 'app_flask/' END || 'f' || CAST(doc_id AS STRING) AS file",
            "CASE WHEN doc_id % 3 = 0 THEN lang END AS framework",
        ],
        None,
    ),
    "predictions": (
        "labels JOIN documents USING (doc_id)",
        [
            "doc_id", "source AS framework", "quality AS y_true", "1 - toxic AS y_pred",
            "round(CAST(n_chars % 997 AS DOUBLE) / 997, 6) AS score",
            "CAST(CASE WHEN quality = 1 THEN 0.8 ELSE 0.2 END AS DOUBLE) AS target",
        ],
        None,
    ),
    "signals": (
        "documents",
        [
            "doc_id AS sample_id", "CAST(n_chars % 4 AS DOUBLE) * 0.25 AS bandit_score", "doc_id % 3 = 0 AS patched",
            "doc_id % 6 = 0 AS post_patch", "doc_id % 5 = 0 AS synthetic",
            "CAST(CASE WHEN n_chars % 9 = 0 THEN 0.35 END AS DOUBLE) AS explicit",
            "CAST(CASE WHEN n_chars % 7 = 0 THEN 0.45 END AS DOUBLE) AS label_bandit",
        ],
        None,
    ),
    "findings": (
        "orders",
        [
            "o_orderkey AS finding_id", f"'p' || {_s('o_custkey')} AS project_id", f"'t' || {_s('o_custkey % 10')} AS tenant_id",
            f"'s' || {_s('o_orderkey % 2000')} AS scan_id", f"'j' || {_s('o_orderkey % 500')} AS job_id",
            f"{_SEVERITY} AS severity", f"{_STATUS} AS status",
            "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE round(o_totalprice / 600000, 6) END AS confidence",
            f"'R' || {_s('o_orderkey % 12')} AS rule_id", f"'A' || {_s('10 + o_orderkey % 10')} AS owasp_category",
            f"'CWE-' || {_s('o_orderkey % 30')} AS cwe", f"'src/f' || {_s('o_custkey % 300')} || '.py' AS file",
            "CAST(1 + o_orderkey % 200 AS INT) AS line", f"'fn' || {_s('o_orderkey % 40')} AS function_name",
            f"'org/r' || {_s('o_custkey % 20')} AS repo", "o_orderdate AS created_at",
            "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS fixed_at",
        ],
        None,
    ),
    "scans": (
        "events",
        [
            "event_id AS scan_id", f"'p' || {_s('user_id')} AS project_id", f"'t' || {_s('user_id % 10')} AS tenant_id",
            "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' ELSE 'completed' END AS status",
            "ts AS created_at", "CAST(floor(value) AS INT) AS findings_count",
        ],
        None,
    ),
    "projects": (
        "customer",
        [
            f"'p' || {_s('c_custkey')} AS project_id", f"'t' || {_s('c_custkey % 10')} AS tenant_id",
            f"'org' || {_s('c_custkey % 50')} AS github_org", f"'r' || {_s('c_custkey')} AS github_repo", "c_acctbal > 0 AS active",
            "c_mktsegment AS segment",
        ],
        None,
    ),
    "audit": (
        "events",
        [
            "event_id AS id", f"'t' || {_s('user_id % 10')} AS tenant_id", f"'actor' || {_s('user_id')} AS actor",
            "event_type AS action", "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result", "ts",
        ],
        None,
    ),
    "taint_lines": ("events", ["event_id", f"{_TAINT} AS value"], None),
    "results": (
        "conversations",
        [
            f"'c' || {_s('conv_id')} || '/t' || {_s('turn')} || '.py' AS file_path", "role <> 'system' AS is_vulnerable",
            "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE round(CAST(length(text) % 100 AS DOUBLE) / 100, 2) END AS confidence",
            "conv_id", "turn", "text",
        ],
        None,
    ),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, columns, condition = VIEWS[name]
    if " JOIN " in source:
        left, rest = source.split(" JOIN ")
        right, key = rest.split(" USING ")
        rows = table(spark, sf, left).join(table(spark, sf, right), key.strip("()"))
    else:
        rows = table(spark, sf, source)
    return (rows.where(condition) if condition else rows).selectExpr(*columns)


def sql(*names: str) -> str:
    """WITH clause of the views; the checking query goes on with ', x AS (...)' or 'SELECT'."""
    parts = []
    for n in names:
        source, columns, condition = VIEWS[n]
        parts.append(f"{n} AS (SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {condition})" if condition else ")"))
    return "WITH " + ", ".join(parts) + " "


def day_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The events as nodes with span and attribute map."""
    d = view(spark, sf, "day_nodes")
    entries = {
        "is_source": F.when(F.col("source_id").isNotNull(), "true"), "source_id": F.col("source_id"),
        "is_sink": F.when(F.col("sink_id").isNotNull(), "true"), "sink_id": F.col("sink_id"),
        "sink_kind": F.col("sink_kind"), "sink_constraint_failed": F.col("sink_failed"),
        "sanitizer_kind": F.col("sanitizer_kind"),
    }
    attrs = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    return d.select(
        "file", "id", "kind", F.struct("sl", "sc", "el", "ec").alias("span"), "code", "symbol",
        F.map_filter(attrs, lambda _, v: v.isNotNull()).alias("attrs"),
    )


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "order_edges").distinct()


def order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit("Name").alias("kind")),
        F.struct(F.col("dst").alias("id"), F.lit("Call").alias("kind")),
    )
    return view(spark, sf, "order_edges").select("file", F.inline(ends)).distinct()


ORDER_GRAPH_SQL = (
    sql("order_edges")
    + ", edges AS (SELECT DISTINCT * FROM order_edges), nodes AS (SELECT file, src AS id, 'Name' AS kind FROM order_edges "
    "UNION SELECT file, dst, 'Call' FROM order_edges) "
)
