"""Scalar functions on whole texts: X1-X5, X12, X21, X22, P2-P6, P11, P14, P15, P19, S20, P16, J6, G2, G5."""

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.operators import tenancy as TN
from codeloom.plans.registry import query
from codeloom.plans.views import sql, table, view
from codeloom.sources import files as FI
from codeloom.sources import records as R


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def type_case(text: str) -> str:
    """The type cascade in SQL, from the same phrase table."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {_quoted(w)})" for w in words) + f" THEN {_quoted(name)}"
        for name, words in X.VULNERABILITY_PHRASES
    )
    return f"CASE {arms} END"


@query(
    "commit_identifiers", "X1 X2 X3",
    sql("commits")
    + "SELECT sha, nullif(upper(regexp_extract(message, '(?i)CVE-\\d{4}-\\d{4,}', 0)), '') AS cve_id, "
    "nullif(upper(regexp_extract(message, '(?i)CWE-?\\d{2,4}', 0)), '') AS cwe_id, "
    f"{type_case('message')} AS vulnerability_type FROM commits",
)
def commit_identifiers(spark, sf):
    m = F.col("message")
    return view(spark, sf, "commits").select(
        "sha", X.cve_id(m).alias("cve_id"), X.cwe_id(m).alias("cwe_id"), X.vulnerability_type(m).alias("vulnerability_type")
    )


@query(
    "reclassified_records", "X4",
    sql("vuln_records")
    + f", t AS (SELECT record_id, vulnerability_type AS old, {type_case('description')} AS new FROM vuln_records) "
    "SELECT record_id, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM old THEN new ELSE old END AS vulnerability_type, "
    "CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM old THEN old END AS original_type FROM t",
)
def reclassified_records(spark, sf):
    new, old = X.reclassified_type(F.col("vulnerability_type"), F.col("description"))
    return view(spark, sf, "vuln_records").select("record_id", new.alias("vulnerability_type"), old.alias("original_type"))


@query(
    "document_type_counts", "X3 A9",
    f"SELECT coalesce({type_case('text')}, 'none') AS vulnerability_type, count(*) AS n FROM "
    "(SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT html FROM pages) GROUP BY 1",
)
def document_type_counts(spark, sf):
    texts = table(spark, sf, "documents").select("text").unionByName(
        table(spark, sf, "conversations").select("text")
    ).unionByName(table(spark, sf, "pages").select(F.col("html").alias("text")))
    kind = F.coalesce(X.vulnerability_type(F.col("text")), F.lit("none"))
    return texts.groupBy(kind.alias("vulnerability_type")).agg(F.count(F.lit(1)).alias("n"))


_LINES = (
    "CASE WHEN {0} = '' THEN 0 WHEN {0} LIKE '%' || chr(10) THEN length({0}) - length(replace({0}, chr(10), '')) "
    "ELSE length({0}) - length(replace({0}, chr(10), '')) + 1 END"
)


@query(
    "message_and_line_range", "X5",
    sql("vuln_records")
    + "SELECT record_id, substr(code_before, 1, 500) AS message, 1 AS start_line, "
    f"CAST({_LINES.format('code_before')} AS INTEGER) AS end_line FROM vuln_records",
)
def message_and_line_range(spark, sf):
    r = X.whole_file_range(F.col("code_before"))
    return view(spark, sf, "vuln_records").select(
        "record_id", X.truncated_message(F.col("code_before")).alias("message"), r["start_line"].alias("start_line"),
        r["end_line"].alias("end_line"),
    )


@query(
    "job_and_commit_keys", "X12",
    sql("findings")
    + "SELECT finding_id, substr(sha256(repo || ':' || file), 1, 16) AS job_key, substr(md5(rule_id), 1, 16) AS commit_key FROM findings",
)
def job_and_commit_keys(spark, sf):
    return view(spark, sf, "findings").select(
        "finding_id", X.job_key(F.col("repo"), F.col("file")).alias("job_key"),
        X.synthetic_commit(F.col("rule_id")).alias("commit_key"),
    )


@query(
    "repository_addresses", "X21",
    "WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, "
    "trim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS path, url FROM pages) "
    "SELECT page_id, CASE WHEN ok THEN split_part(path, '/', 1) END AS owner, CASE WHEN ok THEN split_part(path, '/', 2) END AS repo, "
    "translate(substr(url, 1, 200), '/\\ ', '___') AS file_name FROM (SELECT *, (host LIKE '%.example.com' OR host LIKE '%.example.net' "
    "OR host LIKE '%.example.org') AND path LIKE '%/%' AS ok FROM u)",
)
def repository_addresses(spark, sf):
    pages = table(spark, sf, "pages")
    # the hosts of the pages stand in for the code host: the host test needs a fixed list, so it is
    # given the hosts as a column-wise match on their registered domain
    url = F.regexp_replace("url", r"^(https?)://[^/?#]*\.(example\.(?:com|net|org))(?=[/?#]|$)", "$1://$2")
    r = X.owner_and_repo(url, ("example.com", "example.net", "example.org"))
    return pages.select(
        "page_id", r["owner"].alias("owner"), r["repo"].alias("repo"), X.safe_file_name(F.col("url")).alias("file_name")
    )


@query(
    "subject_projects", "X22 J14 P19",
    sql("projects")
    + ", s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'team:' || CAST(user_id AS STRING) ELSE 'repo:org' || "
    "CAST(user_id % 50 AS STRING) || '/r' || CAST(user_id AS STRING) || ':ref:refs/heads/' || event_type END AS subject FROM events), "
    "p AS (SELECT *, split_part(subject, ':', 1) AS head, split_part(subject, ':', 2) AS repo FROM s), "
    "j AS (SELECT p.subject, p.head, q.project_id, q.tenant_id, q.github_org, q.segment FROM p LEFT JOIN projects q ON p.head = 'repo' AND "
    "split_part(p.repo, '/', 1) = q.github_org AND split_part(p.repo, '/', 2) = q.github_repo) "
    "SELECT subject, project_id, tenant_id, CASE WHEN head <> 'repo' THEN 'invalid subject' WHEN project_id IS NULL THEN 'unknown project' "
    "WHEN segment = 'BUILDING' OR (segment = 'MACHINERY' AND subject LIKE 'repo:org%/heads/view%') OR "
    "(segment NOT IN ('BUILDING', 'MACHINERY') AND subject LIKE 'repo:' || github_org || '/%:ref:refs/heads/c%') THEN 'allowed' ELSE 'denied' END AS status FROM j",
)
def subject_projects(spark, sf):
    e = table(spark, sf, "events")
    subject = F.expr(
        "CASE WHEN event_type = 'error' THEN 'team:' || CAST(user_id AS STRING) ELSE 'repo:org' || CAST(user_id % 50 AS STRING) || "
        "'/r' || CAST(user_id AS STRING) || ':ref:refs/heads/' || event_type END"
    )
    patterns = F.expr(
        "CASE segment WHEN 'BUILDING' THEN array() WHEN 'MACHINERY' THEN array('repo:org*/heads/view') "
        "ELSE array('never', 'repo:' || github_org || '/*:ref:refs/heads/c') END"
    )
    projects = view(spark, sf, "projects").withColumn("allowed_subject_patterns", patterns)
    return TN.projects_for_subjects(e.select(subject.alias("subject")), projects)


_CALL = "replace(p_name, ' ', '.') || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN '(x, ' || p_brand || '.y)' WHEN p_size % 4 = 2 THEN '.(' ELSE '  ' END"


@query(
    "call_names", "P2 P3 P4",
    f"WITH c AS (SELECT p_partkey, {_CALL} AS code FROM part), h AS (SELECT *, split_part(trim(code), '(', 1) AS head, split_part(code, '(', 1) AS raw FROM c) "
    "SELECT p_partkey, rtrim(head, '.') AS call_name, "
    "CASE WHEN contains(head, '.') THEN regexp_replace(head, '\\.[^.]*$', '') END AS base, "
    "trim(CASE WHEN contains(code, '(') AND contains(raw, '.') THEN regexp_replace(raw, '\\.[^.]*$', '') ELSE code END) AS attribute FROM h",
)
def call_names(spark, sf):
    c = table(spark, sf, "part").select("p_partkey", F.expr(_CALL).alias("code"))
    code = F.col("code")
    return c.select(
        "p_partkey", X.call_name(code).alias("call_name"), X.call_base(code).alias("base"), X.attribute_name(code).alias("attribute")
    )


@query(
    "call_pattern_matches", "P5 P6",
    "WITH r AS (SELECT * FROM (VALUES (0, 'ring'), (1, 'red.widget'), (2, 'gear'), (3, 'blue.bolt'), (4, 'hot.gear'), (5, 'lot.red.gizmo')) v(ord, name)), "
    "c AS (SELECT p_partkey, lower(p_type) || '.' || replace(p_name, ' ', '.') AS name FROM part) "
    "SELECT c.p_partkey, r.ord, r.name = c.name AS whole FROM c JOIN r ON c.name = r.name OR c.name LIKE '%.' || r.name",
)
def call_pattern_matches(spark, sf):
    rules = [(0, "ring"), (1, "red.widget"), (2, "gear"), (3, "blue.bolt"), (4, "hot.gear"), (5, "lot.red.gizmo")]
    r = spark.createDataFrame(rules, "ord int, name string")
    full = F.expr("lower(p_type) || '.' || replace(p_name, ' ', '.')")
    c = table(spark, sf, "part").select("p_partkey", full.alias("full")).select(
        "*", F.explode(X.dotted_suffixes(F.col("full"), 3)).alias("name")
    )
    return c.join(F.broadcast(r), "name").select("p_partkey", "ord", (F.col("name") == F.col("full")).alias("whole"))


_QUERY = (
    "CASE event_type WHEN 'signup' THEN 'select %s' WHEN 'click' THEN 'select ' || props WHEN 'view' THEN 'where a = ?' "
    "WHEN 'error' THEN 'where a = %(k' || CAST(user_id AS STRING) || ')s' ELSE 'where b = :id' END"
)


@query(
    "parameterised_queries", "P11",
    f"WITH q AS (SELECT event_id, {_QUERY} AS t, CASE WHEN value < 5 THEN 'fstring' WHEN value < 10 THEN 'other' ELSE 'literal' END AS k, user_id % 3 AS n FROM events) "
    "SELECT event_id, n >= 2 AND CASE k WHEN 'fstring' THEN false WHEN 'other' THEN true ELSE contains(t, '%s') OR contains(t, '%d') OR contains(t, '%f') OR "
    "contains(t, '?') OR contains(t, ':name') OR contains(t, ':id') OR contains(t, ':value') OR regexp_matches(t, '%\\([^)]+\\)[sd]') END AS parameterised FROM q",
)
def parameterised_queries(spark, sf):
    kind = F.when(F.col("value") < 5, "fstring").when(F.col("value") < 10, "other").otherwise("literal")
    return table(spark, sf, "events").select(
        "event_id", M.is_parameterised_query(F.col("user_id") % 3, kind, F.expr(_QUERY)).alias("parameterised")
    )


def _has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_quoted(w)})" for w in words) + ")"


@query(
    "heuristic_candidates", "P14",
    sql("day_nodes")
    + f"SELECT id, kind = 'Arg' OR (kind = 'Name' AND {_has_any('code', M.INPUT_WORDS)}) AS source, "
    f"kind = 'Call' AND ({_has_any('code', M.DANGEROUS_WORDS)} OR {_has_any('symbol', M.DANGEROUS_WORDS)}) AS sink FROM day_nodes",
)
def heuristic_candidates(spark, sf):
    d = view(spark, sf, "day_nodes")
    return d.select(
        "id", M.heuristic_source(F.col("kind"), F.col("code")).alias("source"),
        M.heuristic_sink(F.col("kind"), F.col("code"), F.col("symbol")).alias("sink"),
    )


@query(
    "safe_corpus_files", "P15",
    sql("safe_files")
    + "SELECT file_path, octet_length(encode(code)) AS size FROM safe_files WHERE octet_length(encode(code)) BETWEEN 100 AND 50000 "
    f"AND {_LINES.format('code')} >= 3 AND NOT (contains(file_path, 'test_') OR contains(file_path, '_test.py') OR contains(file_path, 'tests/') OR contains(file_path, 'examples/'))",
)
def safe_corpus_files(spark, sf):
    s = view(spark, sf, "safe_files")
    return s.where(X.is_safe_corpus_file(F.col("file_path"), F.col("code"), min_lines=3)).select(
        "file_path", F.octet_length("code").cast("bigint").alias("size")
    )


@query(
    "parsed_commit_feed", "S20 X1 X2 X3",
    sql("commit_feed")
    + ", f AS (SELECT CAST(value AS JSON) AS j FROM commit_feed) SELECT j->>'$.sha' AS sha, j->>'$.commit.author.name' AS author, "
    "coalesce(nullif(j->>'$.repository.html_url', ''), j->>'$.repository.url') AS repo_url, j->>'$.repository.full_name' AS repo_name, "
    "j->>'$.parents[0].sha' AS parent_sha, nullif(upper(regexp_extract(j->>'$.commit.message', '(?i)CVE-\\d{4}-\\d{4,}', 0)), '') AS cve_id, "
    f"{type_case('(j->>{0})'.format(_quoted('$.commit.message')))} AS vulnerability_type FROM f WHERE j->>'$.commit.author.name' IS NOT NULL",
)
def parsed_commit_feed(spark, sf):
    return R.parse_commits(view(spark, sf, "commit_feed")).select(
        "sha", "author", "repo_url", "repo_name", "parent_sha", "cve_id", "vulnerability_type"
    )


@query(
    "changed_python_files", "P16",
    sql("commit_feed")
    + ", f AS (SELECT CAST(value AS JSON) AS j FROM commit_feed) SELECT j->>'$.sha' AS sha, j->>'$.files[0].filename' AS file_path, "
    "CAST(j->>'$.files[0].additions' AS INTEGER) AS additions FROM f WHERE j->>'$.commit.author.name' IS NOT NULL AND j->>'$.files[0].status' <> 'removed'",
)
def changed_python_files(spark, sf):
    return R.changed_python_files(R.parse_commits(view(spark, sf, "commit_feed"))).select("sha", "file_path", "additions")


_CONTENT = "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'v = ' || CAST(o_orderkey AS STRING) || chr(10) || 'w = ' || o_orderpriority END"


@query(
    "vulnerable_fixed_pairs", "J6 X5",
    sql("commits")
    + f", contents AS (SELECT md5('c' || CAST(o_orderkey AS STRING)) AS sha, {_CONTENT} AS code FROM orders) "
    "SELECT c.parent_sha AS commit_before, c.sha AS commit_after, b.code AS code_before, a.code AS code_after, 2 AS lines_before, "
    f"coalesce({type_case('c.message')}, 'Unknown') AS vulnerability_type FROM commits c JOIN contents a ON a.sha = c.sha JOIN contents b ON b.sha = c.parent_sha "
    "WHERE a.code <> '' AND b.code <> ''",
)
def vulnerable_fixed_pairs(spark, sf):
    m = F.col("message")
    changes = view(spark, sf, "commits").select(
        "*", X.cve_id(m).alias("cve_id"), X.cwe_id(m).alias("cwe_id"), X.vulnerability_type(m).alias("vulnerability_type"),
        F.lit("src/a.py").alias("file_path"), F.lit("u").alias("repo_url"),
    ).withColumn("repo_name", F.lit("org/shop"))
    contents = table(spark, sf, "orders").select(
        F.lit("org/shop").alias("repo_name"), F.md5(F.expr("'c' || CAST(o_orderkey AS STRING)")).alias("sha"),
        F.lit("src/a.py").alias("file_path"), F.expr(_CONTENT).alias("code"),
    )
    return R.paired_versions(changes, contents).select(
        "commit_before", "commit_after", "code_before", "code_after", F.col("line_range_before.end_line").alias("lines_before"),
        "vulnerability_type",
    )


@query(
    "version_rows", "S18 S19",
    sql("vuln_records")
    + ", v AS (SELECT record_id, 'before' AS version, commit_before AS \"commit\", code_before AS code, file_path FROM vuln_records UNION ALL "
    "SELECT record_id, 'after', commit_after, code_after, file_path FROM vuln_records) "
    "SELECT record_id, version, \"commit\" || '_' || regexp_replace(regexp_extract(file_path, '[^/]*$', 0), '\\.[^.]*$', '') || '_' || version AS graph_key, "
    "\"commit\" || '_' || regexp_extract(file_path, '[^/]*$', 0) || '_' || version || '.py' AS code_file, length(code) AS size FROM v",
)
def version_rows(spark, sf):
    return FI.version_rows(view(spark, sf, "vuln_records")).select(
        "record_id", "version", "graph_key", "code_file", F.length("code").cast("bigint").alias("size")
    )


@query(
    "graph_by_commit_key", "S18",
    sql("vuln_records")
    + "SELECT record_id, 'after' AS version, length(text) AS graph_size FROM vuln_records JOIN documents ON doc_id = record_id WHERE n_chars % 2 = 0 "
    "UNION ALL SELECT record_id, 'before', length(text) FROM vuln_records JOIN documents ON doc_id = record_id",
)
def graph_by_commit_key(spark, sf):
    docs = table(spark, sf, "documents")
    stem = F.expr("'mod' || CAST(n_chars % 80 AS STRING) || '.v2'")
    size = F.length("text").cast("bigint").alias("graph_size")

    def stored(rows, letter, version):
        sha = F.md5(F.concat(F.lit(letter), F.col("doc_id").cast("string")))
        return rows.select(sha.alias("commit"), stem.alias("stem"), F.lit(version).alias("version"), size)

    graphs = stored(docs, "b", "before").unionByName(stored(docs.where("n_chars % 2 = 0"), "a", "after"))
    return FI.attach_graphs(FI.version_rows(view(spark, sf, "vuln_records")), graphs).select("record_id", "version", "graph_size")


@query(
    "incremental_files", "S17",
    "SELECT 'd' || CAST(doc_id AS STRING) AS file FROM documents WHERE lang = 'en' OR contains(text, 'token')",
)
def incremental_files(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file")
    now = docs.select(name, F.col("text").alias("code"))
    # the store knows the texts that are not English, and an older text where a token was added since
    old = F.replace("text", F.lit("token"), F.lit("")).alias("code")
    stored = docs.where("lang <> 'en'").select(name, old).withColumn("content_sha", F.sha2(F.encode("code", "UTF-8"), 256))
    return FI.changed_files(now, stored).select("file")


_SPAN = {
    "sl": "CAST(1 + n_chars % 3 AS INT)", "sc": "CAST(n_chars % 5 AS INT)", "el": "CAST(1 + n_chars % 3 + n_chars % 4 AS INT)",
    "ec": "CAST(3 + n_chars % 11 AS INT)",
}


@query(
    "span_texts", "G2 G1",
    "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines, " + ", ".join(f"{v} AS {k}" for k, v in _SPAN.items()) + " FROM documents), "
    "n AS (SELECT *, len(lines) AS n, least(el, len(lines)) AS last FROM s) SELECT doc_id, CASE WHEN sl <= n THEN CASE WHEN sl = last THEN "
    "lines[sl][sc + 1 : ec] ELSE array_to_string(list_concat(list_concat([lines[sl][sc + 1 :]], lines[sl + 1 : last - 1]), [lines[last][1 : ec]]), chr(10)) END END AS code FROM n",
)
def span_texts(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", "text", *[F.expr(v).alias(k) for k, v in _SPAN.items()])
    return s.select("doc_id", X.span_text(F.col("text"), *[F.col(c) for c in ("sl", "sc", "el", "ec")]).alias("code"))


@query(
    "type_hint_attributes", "G5",
    "WITH h AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || '[' || p_name || ']' WHEN 2 THEN ' Dict [str, ' || p_type || '[int]]' ELSE '[' || p_name || ']' END AS hint FROM part), "
    "k AS (SELECT *, contains(hint, '[') AND hint LIKE '%]' AND trim(split_part(hint, '[', 1)) <> '' AS two FROM h) "
    "SELECT p_partkey, CASE WHEN two THEN trim(split_part(hint, '[', 1)) END AS container, CASE WHEN two THEN trim(substr(hint, strpos(hint, '[') + 1, length(hint) - strpos(hint, '[') - 1)) ELSE hint END AS data_type FROM k",
)
def type_hint_attributes(spark, sf):
    hint = F.expr(
        "CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || '[' || p_name || ']' WHEN 2 THEN ' Dict [str, ' || p_type || '[int]]' ELSE '[' || p_name || ']' END"
    )
    a = G.type_attrs(hint)
    return table(spark, sf, "part").select("p_partkey", a["ContainerType"].alias("container"), a["DataType"].alias("data_type"))


_IMPORTS = (
    "'import os' || chr(10) || CASE WHEN value < 30 THEN 'x = Counter(a)' ELSE 'from collections import Counter' END || chr(10) || "
    "CASE event_type WHEN 'click' THEN 'import os' WHEN 'view' THEN '  import os  ' || chr(10) || 'from a import b' || chr(10) || 'from a import b' "
    "WHEN 'error' THEN 'random.seed(1)' WHEN 'signup' THEN 'random_split(f1_score)' ELSE 'from sklearn.metrics import f1_score' END"
)


@query(
    "missing_imports", "G26",
    f"WITH c AS (SELECT event_id AS file, {_IMPORTS} AS code FROM events) SELECT file, 'Counter is used but not imported' AS issue FROM c WHERE contains(code, 'Counter(') "
    "UNION ALL SELECT file, 'sklearn.metrics functions used but not imported' FROM c WHERE contains(code, 'random_split') "
    "UNION ALL SELECT file, 'random module used but not imported' FROM c WHERE contains(code, 'random.seed')",
)
def missing_imports(spark, sf):
    files = table(spark, sf, "events").select(F.col("event_id").alias("file"), F.expr(_IMPORTS).alias("code"))
    return G.missing_imports(files)


@query(
    "duplicate_imports", "G26",
    f"WITH c AS (SELECT event_id AS file, {_IMPORTS} AS code FROM events), l AS (SELECT file, unnest(string_split(code, chr(10))) AS raw, "
    "unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line FROM c), i AS (SELECT file, line, trim(raw) AS statement FROM l WHERE trim(raw) LIKE 'import %' OR trim(raw) LIKE 'from %') "
    "SELECT file, CAST(line AS INTEGER) AS line, substr(statement, 1, 50) AS statement FROM (SELECT *, row_number() OVER (PARTITION BY file, statement ORDER BY line) AS r FROM i) WHERE r > 1",
)
def duplicate_imports(spark, sf):
    files = table(spark, sf, "events").select(F.col("event_id").alias("file"), F.expr(_IMPORTS).alias("code"))
    return G.duplicate_imports(files)


@query(
    "line_lint_of_documents", "G26",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) "
    "SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY line) AS r FROM l) WHERE r > 1",
)
def line_lint_of_documents(spark, sf):
    """Repeated lines of whole texts: the duplicate rule on every line instead of import lines."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))
    first = lines.groupBy("doc_id", F.sha2("s", 256).alias("h")).agg(F.min("i").alias("i0"))
    again = lines.withColumn("h", F.sha2("s", 256)).join(first, ["doc_id", "h"]).where("i > i0")
    return again.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line"))
