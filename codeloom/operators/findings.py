"""From predictions to findings, minimised payloads, reports and issues."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.functions import masking as K
from codeloom.functions import report_text as R
from codeloom.functions import text as X
from codeloom.operators.traverse import induced_subgraph, neighbourhood


def report_gate(results: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Adds confidence (missing = 1.0) and skip_reason; a null reason means report it."""
    conf = F.coalesce("confidence", F.lit(1.0))
    reason = F.when(~F.coalesce("is_vulnerable", F.lit(False)), "not vulnerable").when(
        conf < min_confidence, "low confidence"
    )
    return results.withColumn("confidence", conf).withColumn("skip_reason", reason)


def run_summary(gated: DataFrame) -> DataFrame:
    """One row: results, vulnerable, safe, created, skipped, errors; an error is a report without fix."""
    vulnerable = F.coalesce("is_vulnerable", F.lit(False))
    passed = F.col("skip_reason").isNull()
    fixed = F.col("fix").isNotNull() if "fix" in gated.columns else F.lit(True)
    return gated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(vulnerable).alias("vulnerable"),
        F.count_if(~vulnerable).alias("safe"), F.count_if(passed & fixed).alias("created"),
        F.count_if(~passed).alias("skipped"), F.count_if(passed & ~fixed).alias("errors"),
    )


def top_findings(findings: DataFrame, k: int = 5, tie: str = "finding_id") -> DataFrame:
    """The k most confident findings; a missing confidence counts as 0."""
    return findings.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), tie).limit(k)


def top_findings_per(findings: DataFrame, group: str, k: int = 5, tie: str = "finding_id") -> DataFrame:
    """The k most confident findings of each group; ranks are cut per task before the shuffle."""
    order = [F.desc(F.coalesce("confidence", F.lit(0.0))), F.col(tie)]
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return findings.withColumn("rank", rank).where(F.col("rank") <= k)


def issues_per_job(findings: DataFrame, job: str = "job_id", k: int = 5, tag: str = R.TAG) -> DataFrame:
    """The first k findings of each job plus one summary row for the rest: job, kind, finding_id, title, rest."""
    top = top_findings_per(findings, job, k)
    n = findings.groupBy(job).agg(F.count(F.lit(1)).alias("n"))
    title = F.concat(F.lit(f"[{tag.upper()}] "), (F.col("n") - k).cast("string"), F.lit(" Additional Findings"))
    more = n.where(F.col("n") > k).select(
        job, F.lit("summary").alias("kind"), F.lit(None).cast("bigint").alias("finding_id"), title.alias("title"),
        (F.col("n") - k).alias("rest"),
    )
    one = top.select(
        job, F.lit("finding").alias("kind"), F.col("finding_id").cast("bigint").alias("finding_id"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("rest"),
    )
    return one.unionByName(more)


def masked_nodes(nodes: DataFrame, salt: str) -> DataFrame:
    """Nodes with hashed names and redacted code."""
    out = nodes.withColumn("code", K.mask_text(F.col("code")))
    for name in ("symbol", "name", "label"):
        if name in out.columns:
            out = out.withColumn(name, K.mask_identifier(F.col(name), salt))
    if "value" in out.columns:
        out = out.withColumn("value", K.mask_text(F.col("value")))
    return out


def payload_findings(
    findings: DataFrame, files: DataFrame, max_issues: int = 5, context: int = 5
) -> DataFrame:
    """The k best findings of each job with a masked snippet around their line."""
    top = top_findings_per(findings, "job_id", max_issues)
    rows = top.join(files.select("file", F.col("code").alias("_text")), "file", "left")
    lines = X.line_window(F.col("_text"), F.col("line"), F.col("line"), context)
    return rows.select(
        "tenant_id", "project_id", "repo", "job_id", "fingerprint", "rank",
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("rule_id", F.lit("UNKNOWN")).alias("rule_id"), F.coalesce("cwe", F.lit("")).alias("cwe"),
        "file", "line", F.coalesce(K.masked_lines(lines), F.lit("")).alias("code_snippet_masked"),
    )


def payload_documents(rows: DataFrame, max_issues: int = 5) -> DataFrame:
    """job_id, payload: one JSON document per job, of at most ``max_issues`` findings.

    Subgraphs travel as their own tables (``payload_subgraph``) keyed by fingerprint.
    """
    finding = F.struct(
        "rank", "fingerprint", "severity", "rule_id", "cwe", F.struct("file", "line").alias("location"),
        "code_snippet_masked",
    )
    head = ["tenant_id", "project_id", "repo", "job_id"]
    jobs = rows.groupBy(*head).agg(F.array_sort(F.collect_list(finding)).alias("f"))
    body = F.struct(
        *head, F.transform("f", lambda x: x.dropFields("rank")).alias("findings"),
        F.struct(F.lit(max_issues).alias("max_issues")).alias("limits"),
    )
    return jobs.select("job_id", F.to_json(body).alias("payload"))


def payload_subgraph(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, salt: str, max_depth: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Masked nodes and edges around the seed nodes."""
    near = neighbourhood(edges, seeds, max_depth)
    n, e = induced_subgraph(nodes, edges, near)
    return masked_nodes(n, salt), e


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint",
        K.fingerprint(F.col("repo"), F.col("rule_id"), F.col("file"), F.col("function_name"), F.col("line")),
    )


def with_pattern_info(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """owasp, cwe_id (the first), cwe and description of a finding's pattern.

    The pattern table is the rule catalogue, so its broadcast has a fixed size.
    """
    p = patterns.select(
        "pattern_id", "owasp", F.try_element_at("cwe", F.lit(1)).alias("cwe_id"), "cwe", "description"
    )
    return findings.join(F.broadcast(p), "pattern_id", "left")


def patterns_by_owasp(patterns: DataFrame, owasp: str) -> DataFrame:
    return patterns.where(F.col("owasp") == owasp).select("ord", "pattern_id")


def patterns_by_cwe(patterns: DataFrame, cwe: str) -> DataFrame:
    return patterns.where(F.array_contains("cwe", cwe)).select("ord", "pattern_id")


def owasp_result(enriched: DataFrame) -> DataFrame:
    """Adds result: the finding as JSON, optional fields left out, a line range spelled out."""
    spelled = F.when(
        F.col("line_range").isNotNull(), F.sequence("line_range.start_line", "line_range.end_line")
    )
    lines = F.coalesce(F.when(F.size("lines") > 0, F.col("lines")), spelled)
    body = F.struct(
        "pattern_id", F.coalesce("owasp", F.lit("Unknown")).alias("owasp"), "confidence",
        F.struct("file", lines.alias("lines")).alias("location"), "cwe_id",
        F.nullif("description", F.lit("")).alias("description"),
    )
    return enriched.withColumn("result", F.to_json(body))


def reports(findings: DataFrame, markdown: Column, tag: str = R.TAG) -> DataFrame:
    """fingerprint, title, labels, markdown and path of each finding's report."""
    return findings.select(
        "job_id", "fingerprint",
        R.finding_title(F.col("severity"), F.col("cwe"), F.col("rule_id"), F.col("file"), tag).alias("title"),
        R.finding_labels(F.col("severity"), F.col("cwe"), tag).alias("labels"), markdown.alias("markdown"),
        F.concat(F.lit("reports/"), F.col("job_id"), F.lit("/"), F.col("fingerprint"), F.lit(".md")).alias("path"),
    )


def issue_actions(reports_: DataFrame, issues: DataFrame, commit: Column) -> DataFrame:
    """fingerprint, action, issue_id, text: comment on the issue that carries the fingerprint or open one.

    Fingerprints are read from the footer of an issue's body, so the match is an equality.
    """
    known = issues.select(
        F.regexp_extract("body", r"fp:([0-9a-f]+)", 1).alias("fingerprint"), "issue_id"
    ).where("fingerprint <> ''")
    first = known.groupBy("fingerprint").agg(F.min("issue_id").alias("issue_id"))
    r = reports_.where(F.coalesce("fingerprint", F.lit("")) != "").join(first, "fingerprint", "left")
    update = F.col("issue_id").isNotNull()
    body = F.when(update, R.issue_comment(F.col("markdown"), commit)).otherwise(
        R.issue_with_fingerprint(F.col("markdown"), F.col("fingerprint"))
    )
    return r.select(
        "fingerprint", F.when(update, "update").otherwise("create").alias("action"), "issue_id", body.alias("text")
    )
