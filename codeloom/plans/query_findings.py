"""Findings, payloads, reports and issues: P17, A20, L1, L2, J13, X16-X20, X24, S11, S12, S15."""

from pyspark.sql import functions as F

from codeloom.functions import report_text as R
from codeloom.operators import findings as FN
from codeloom.plans.query_masking import mask_sql
from codeloom.plans.registry import query
from codeloom.plans.views import sql, table, view
from codeloom.schemas import PREDICTION
from codeloom.session import scratch_path
from codeloom.sources import records as RC

_GATE = (
    ", g AS (SELECT *, coalesce(confidence, 1.0) AS conf, CASE WHEN NOT is_vulnerable THEN 'not vulnerable' WHEN coalesce(confidence, 1.0) < 0.4 THEN 'low confidence' END AS skip_reason FROM results) "
)


@query("report_gate", "P17", sql("results") + _GATE + "SELECT file_path, conf AS confidence, skip_reason FROM g")
def report_gate(spark, sf):
    return FN.report_gate(view(spark, sf, "results"), 0.4).select("file_path", "confidence", "skip_reason")


@query(
    "run_summary", "A20",
    sql("results") + _GATE
    + "SELECT count(*) AS total, count(*) FILTER (WHERE is_vulnerable) AS vulnerable, count(*) FILTER (WHERE NOT is_vulnerable) AS safe, count(*) FILTER (WHERE skip_reason IS NULL AND turn % 4 <> 1) AS created, "
    "count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped, count(*) FILTER (WHERE skip_reason IS NULL AND turn % 4 = 1) AS errors FROM g",
)
def run_summary(spark, sf):
    r = view(spark, sf, "results").withColumn("fix", F.expr("CASE WHEN turn % 4 <> 1 THEN 'x' END"))
    return FN.run_summary(FN.report_gate(r, 0.4))


@query("top_findings", "L1", sql("findings") + "SELECT finding_id, confidence FROM findings ORDER BY coalesce(confidence, 0) DESC, finding_id LIMIT 25")
def top_findings(spark, sf):
    return FN.top_findings(view(spark, sf, "findings"), 25).select("finding_id", "confidence")


@query(
    "top_findings_per_repository", "L1",
    sql("findings")
    + "SELECT repo, finding_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY coalesce(confidence, 0) DESC, finding_id) AS r FROM findings) WHERE r <= 5",
)
def top_findings_per_repository(spark, sf):
    return FN.top_findings_per(view(spark, sf, "findings"), "repo", 5).select("repo", "finding_id", "rank")


@query(
    "issues_per_job", "L2",
    sql("findings")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(confidence, 0) DESC, finding_id) AS r FROM findings), n AS (SELECT job_id, count(*) AS n FROM findings GROUP BY job_id) "
    "SELECT job_id, 'finding' AS kind, finding_id, NULL AS title, NULL AS rest FROM r WHERE r <= 2 UNION ALL SELECT job_id, 'summary', NULL, '[CODELOOM] ' || CAST(n - 2 AS VARCHAR) || ' Additional Findings', n - 2 FROM n WHERE n > 2",
)
def issues_per_job(spark, sf):
    return FN.issues_per_job(view(spark, sf, "findings"), k=2)


def _finding_files(spark, sf):
    """The pages stand in for source files: file k is page k."""
    return table(spark, sf, "pages").select(
        F.expr("'src/f' || CAST(page_id AS STRING) || '.py'").alias("file"), F.regexp_replace("html", "><", ">\n<").alias("code")
    )


_PAYLOAD = (
    sql("findings")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(confidence, 0) DESC, finding_id) AS r FROM findings), t AS (SELECT * FROM r WHERE r <= 3), "
    "f AS (SELECT 'src/f' || CAST(page_id AS VARCHAR) || '.py' AS file, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS lines FROM pages), "
    "s AS (SELECT t.*, lines[greatest(line - 3, 0) + 1 : least(line + 2, len(lines))] AS w FROM t LEFT JOIN f USING (file)), "
    "x AS (SELECT job_id, r, severity, rule_id, cwe, file, line, repo, sha256(repo || ':' || rule_id || ':' || file || ':' || function_name || ':' || CAST(line AS VARCHAR)) AS fingerprint, "
    f"coalesce(array_to_string(list_transform(w, lambda y: {mask_sql('y')}), chr(10)), '') AS snippet FROM s) "
)


def _payload(spark, sf):
    found = FN.with_fingerprint(view(spark, sf, "findings"))
    return FN.payload_findings(found, _finding_files(spark, sf), 3, 2)


@query("payload_findings", "X17 X10", _PAYLOAD + "SELECT job_id, fingerprint, CAST(r AS INTEGER) AS rank, severity, snippet AS code_snippet_masked FROM x")
def payload_findings(spark, sf):
    return _payload(spark, sf).select("job_id", "fingerprint", "rank", "severity", "code_snippet_masked")


@query(
    "payload_documents", "X17",
    _PAYLOAD + "SELECT job_id, repo, count(*) AS findings, string_agg(severity, ',' ORDER BY r) AS severities, CAST(sum(line) AS BIGINT) AS lines FROM x GROUP BY job_id, repo",
)
def payload_documents(spark, sf):
    """Documents read back: JSON text is compared by what it says."""
    p = FN.payload_documents(_payload(spark, sf).withColumn("tenant_id", F.lit("t")).withColumn("project_id", F.lit("p")), 3)
    j = F.from_json("payload", "struct<repo:string,findings:array<struct<severity:string,location:struct<line:int>>>,limits:struct<max_issues:int>>")
    d = p.select("job_id", j.alias("j")).where("j.limits.max_issues = 3")
    return d.select(
        "job_id", "j.repo", F.size("j.findings").cast("bigint").alias("findings"), F.array_join("j.findings.severity", ",").alias("severities"),
        F.aggregate("j.findings.location.line", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("lines"),
    )


@query(
    "owasp_results", "X16",
    sql("findings")
    + "SELECT finding_id, CASE WHEN finding_id % 5 = 0 THEN 'Unknown' ELSE owasp_category END AS owasp, CASE WHEN finding_id % 5 <> 0 THEN cwe END AS cwe_id, "
    "CASE WHEN finding_id % 3 = 0 THEN CAST(line AS VARCHAR) WHEN finding_id % 3 = 1 THEN CAST(line AS VARCHAR) || ',' || CAST(line + 1 AS VARCHAR) || ',' || CAST(line + 2 AS VARCHAR) END AS lines, "
    "finding_id % 5 <> 0 AS has_cwe FROM findings",
)
def owasp_results(spark, sf):
    f = view(spark, sf, "findings").select(
        "finding_id", F.col("rule_id").alias("pattern_id"), F.expr("CASE WHEN finding_id % 5 <> 0 THEN owasp_category END").alias("owasp"),
        F.expr("CASE WHEN finding_id % 5 <> 0 THEN cwe END").alias("cwe_id"), "confidence", "file", F.lit("").alias("description"),
        F.expr("CASE WHEN finding_id % 3 = 0 THEN array(line) ELSE CAST(array() AS array<int>) END").alias("lines"),
        F.expr("CASE WHEN finding_id % 3 = 1 THEN named_struct('start_line', line, 'end_line', line + 2) END").alias("line_range"),
    )
    j = F.from_json("result", "struct<owasp:string,cwe_id:string,location:struct<lines:array<string>>>")
    r = FN.owasp_result(f).select("finding_id", j.alias("j"), F.contains("result", F.lit('"cwe_id"')).alias("has_cwe"))
    return r.select(
        "finding_id", "j.owasp", "j.cwe_id", F.array_join("j.location.lines", ",").alias("lines"), "has_cwe"
    )


@query(
    "report_titles", "X18 S15",
    sql("findings")
    + "SELECT finding_id, '[CODELOOM][' || severity || '][' || cwe || '] ' || rule_id || ' in ' || file AS title, 'security,codeloom,severity:' || lower(severity) || ',cwe:' || lower(cwe) AS labels, "
    "'reports/' || job_id || '/' || CAST(finding_id AS VARCHAR) || '.md' AS path, 'vulnerability_' || strftime(created_at, '%Y%m%d_%H%M%S') || '_' || substr(replace(file, '/', '_'), 1, 200) || '.md' AS file_name FROM findings",
)
def report_titles(spark, sf):
    f = view(spark, sf, "findings").withColumn("fingerprint", F.col("finding_id").cast("string"))
    r = FN.reports(f.withColumn("snippet", F.lit("x")), F.struct("finding_id", RC.report_file_name(F.col("created_at"), F.col("file")).alias("n")))
    return r.select("markdown.finding_id", "title", F.array_join("labels", ",").alias("labels"), "path", F.col("markdown.n").alias("file_name"))


@query(
    "fallback_reports", "X19",
    sql("findings")
    + "SELECT finding_id, '# Vulnerability Detection Report' || chr(10) || chr(10) || '## Summary' || chr(10) || '- **Severity**: ' || severity || chr(10) || '- **Rule ID**: ' || rule_id || chr(10) || '- **CWE**: ' || cwe || chr(10) || "
    "'- **Location**: ' || file || ':' || CAST(line AS VARCHAR) || chr(10) || chr(10) || '## Code Snippet' || chr(10) || '```python' || chr(10) || function_name || chr(10) || '```' || chr(10) || chr(10) || '## Note' || chr(10) || "
    "'No detailed diagnosis is available. Please review by hand.' || chr(10) AS report FROM findings",
)
def fallback_reports(spark, sf):
    report = R.fallback_report(*[F.col(c) for c in ("severity", "rule_id", "cwe", "file", "line", "function_name")])
    return view(spark, sf, "findings").select("finding_id", report.alias("report"))


@query(
    "issue_bodies", "X19",
    sql("results") + _GATE
    + "SELECT file_path, contains(body, '**Detection Confidence**') AS has_confidence, contains(body, '## Vulnerable Code') AS has_code, length(body) > length(text) AS holds_text FROM "
    "(SELECT file_path, text, CASE WHEN confidence IS NULL THEN '' ELSE '**Detection Confidence**' END || CASE WHEN text = '' THEN '' ELSE '## Vulnerable Code' || text END || ' ' AS body FROM g)",
)
def issue_bodies(spark, sf):
    r = view(spark, sf, "results")
    body = R.issue_body(F.col("file_path"), F.lit(None).cast("string"), F.col("confidence"), F.lit("why"), F.col("text"), F.lit("fix"))
    return r.select("file_path", "text", body.alias("body")).select(
        "file_path", F.contains("body", F.lit("**Detection Confidence**")).alias("has_confidence"),
        F.contains("body", F.lit("## Vulnerable Code")).alias("has_code"), (F.length("body") > F.length("text")).alias("holds_text"),
    )


@query(
    "markdown_reports", "X19 S15",
    sql("findings")
    + "SELECT finding_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS generated, CASE WHEN confidence IS NULL THEN '' ELSE printf('%.1f%%', confidence * 100) END AS confidence FROM findings",
)
def markdown_reports(spark, sf):
    """The dated heading and the confidence line, read back from whole reports."""
    none = F.lit(None).cast("string")
    body = R.markdown_report(
        F.col("created_at"), F.col("file"), F.col("repo"), none, F.col("confidence"), F.lit("why"), none, F.lit("fix")
    )
    b = view(spark, sf, "findings").select("finding_id", body.alias("b"))
    return b.select(
        "finding_id", F.regexp_extract("b", r"\*\*Generated\*\*: (.*)", 1).alias("generated"),
        F.regexp_extract("b", r"\*\*Detection Confidence\*\*: (.*)", 1).alias("confidence"),
    )


@query(
    "written_prompts", "X19",
    sql("findings") + "SELECT finding_id, cwe, function_name AS code FROM findings",
)
def written_prompts(spark, sf):
    f = view(spark, sf, "findings")
    report = R.report_prompt(
        *[F.col(c) for c in ("severity", "rule_id", "cwe", "file", "line", "function_name")], F.lit(None).cast("string")
    )
    fix = R.fix_prompt(F.col("function_name"), F.col("file"), F.col("cwe"), F.lit(None).cast("string"))
    return f.select("finding_id", report.alias("r"), fix.alias("x")).select(
        "finding_id", F.regexp_extract("r", r"\*\*CWE\*\*: (.*)", 1).alias("cwe"), F.regexp_extract("x", r"```python\n(.*)\n```", 1).alias("code")
    )


_ANSWER = (
    "CASE turn % 5 WHEN 0 THEN 'Sure: {\"fixed_code\": \"a\", \"explanation\": \"b' || CAST(conv_id AS STRING) || '\", \"confidence\": 0.5} done' "
    "WHEN 1 THEN 'x ```python' || chr(10) || 'y = ' || CAST(conv_id AS STRING) || chr(10) || '``` z' WHEN 2 THEN '{not json} at all' "
    "WHEN 3 THEN '{\"vulnerability_type\": \"XSS\"}' ELSE 'nothing' END"
)


@query(
    "parsed_answers", "X20",
    f"WITH a AS (SELECT conv_id, turn, turn % 5 AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'y = ' || CAST(conv_id AS VARCHAR) WHEN 3 THEN '' END AS fixed_code, "
    "CASE k WHEN 0 THEN 'b' || CAST(conv_id AS VARCHAR) WHEN 1 THEN 'x  z' WHEN 3 THEN '' END AS explanation, CASE k WHEN 0 THEN 'T' WHEN 1 THEN 'T' WHEN 3 THEN 'XSS' END AS vulnerability_type, "
    "CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 END AS DOUBLE) AS confidence FROM a",
)
def parsed_answers(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("answer"))
    return a.select("conv_id", "turn", R.parse_fix(F.col("answer"), F.lit("T")).alias("f")).select("conv_id", "turn", "f.*")


@query(
    "issue_actions", "J13 X24",
    sql("findings")
    + ", r AS (SELECT sha256(rule_id || file) AS fingerprint, min(finding_id) AS id, min(repo) AS repo FROM findings GROUP BY rule_id, file), "
    "i AS (SELECT sha256('R' || CAST(p_size % 12 AS VARCHAR) || 'src/f' || CAST(p_partkey % 300 AS VARCHAR) || '.py') AS fingerprint, min(p_partkey) AS issue_id FROM part GROUP BY 1) "
    "SELECT r.fingerprint, CASE WHEN i.issue_id IS NULL THEN 'create' ELSE 'update' END AS action, i.issue_id, CASE WHEN i.issue_id IS NULL THEN 'm' || CAST(id AS VARCHAR) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- fp:' || r.fingerprint || ' -->' "
    "ELSE '## New Evidence (Commit: abcdef12)' || chr(10) || chr(10) || 'm' || CAST(id AS VARCHAR) END AS text FROM r LEFT JOIN i USING (fingerprint)",
)
def issue_actions(spark, sf):
    f = view(spark, sf, "findings")
    reports = f.groupBy(F.sha2(F.concat("rule_id", "file"), 256).alias("fingerprint")).agg(
        F.concat(F.lit("m"), F.min("finding_id").cast("string")).alias("markdown")
    )
    fp = F.sha2(F.expr("'R' || CAST(p_size % 12 AS STRING) || 'src/f' || CAST(p_partkey % 300 AS STRING) || '.py'"), 256)
    issues = table(spark, sf, "part").select(
        F.col("p_partkey").alias("issue_id"), F.concat(F.lit("old\n<!-- fp:"), fp, F.lit(" -->")).alias("body")
    )
    return FN.issue_actions(reports, issues, F.lit("abcdef1234567"))


@query(
    "result_file_round_trip", "S11 S12 S14",
    sql("results") + "SELECT file_path, is_vulnerable, confidence FROM results",
)
def result_file_round_trip(spark, sf):
    """Predictions to JSON and back."""
    path = scratch_path(spark, "results")
    RC.write_json(view(spark, sf, "results").select("file_path", "is_vulnerable", "confidence"), path)
    # the sink writes one object per line, so the files are read line by line
    return spark.read.schema(PREDICTION).json(path).select("file_path", "is_vulnerable", "confidence")


@query(
    "written_reports", "S15",
    sql("findings")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY coalesce(confidence, 0) DESC, finding_id) AS r FROM findings) SELECT repo AS job_id, CAST(finding_id AS VARCHAR) AS fingerprint, '# ' || rule_id AS value FROM r WHERE r <= 3",
)
def written_reports(spark, sf):
    """The three best findings of each repository as report files, read back."""
    top = FN.top_findings_per(view(spark, sf, "findings"), "repo", 3)
    path = scratch_path(spark, "reports")
    RC.write_reports(
        top.select(
            F.replace("repo", F.lit("/"), F.lit("~")).alias("job_id"), F.col("finding_id").cast("string").alias("fingerprint"),
            F.concat(F.lit("# "), "rule_id").alias("markdown"),
        ),
        path,
    )
    back = spark.read.schema("fingerprint string, path string, markdown string, job_id string").json(path)
    return back.select(F.replace("job_id", F.lit("~"), F.lit("/")).alias("job_id"), "fingerprint", F.col("markdown").alias("value"))
