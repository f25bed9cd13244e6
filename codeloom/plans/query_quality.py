"""Corpus statistics and reports: A1-A15, A26, A27, J1, S10, S14."""

from pyspark.sql import functions as F

from codeloom.functions import signals as SG
from codeloom.operators import quality as Q
from codeloom.operators import rollups as RU
from codeloom.plans import graphs as PG
from codeloom.plans.registry import query
from codeloom.plans.views import ORDER_GRAPH_SQL, day_nodes, order_edges, order_nodes, sql, table, view


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(
    "label_distribution", "A1",
    sql("label_rows") + "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM label_rows WHERE label IS NOT NULL GROUP BY label",
)
def label_distribution(spark, sf):
    return _rounded(Q.label_distribution(view(spark, sf, "label_rows")), "percentage")


_BALANCE = "b AS (SELECT sum(n) AS total, count(*) AS classes, CASE WHEN count(*) > 1 THEN max(n) / min(n) ELSE 'inf'::DOUBLE END AS r FROM (SELECT count(*) AS n FROM label_rows WHERE label IS NOT NULL GROUP BY label))"


@query(
    "label_balance", "A1",
    sql("label_rows") + f", {_BALANCE} SELECT CAST(total AS BIGINT) AS total, classes, round(r, 6) AS imbalance_ratio, r < 3 AS is_balanced FROM b",
)
def label_balance(spark, sf):
    return _rounded(Q.label_balance(view(spark, sf, "label_rows")), "imbalance_ratio")


@query(
    "pattern_distribution", "A2",
    sql("label_rows")
    + "SELECT pattern, count(*) AS n, count(*) FILTER (WHERE label = 1) AS vulnerable, count(*) FILTER (WHERE label <> 1) AS safe FROM "
    "(SELECT coalesce(nullif(pattern_id, ''), nullif(vulnerability_type, ''), 'unknown') AS pattern, label FROM label_rows) WHERE pattern <> 'unknown' GROUP BY pattern",
)
def pattern_distribution(spark, sf):
    return Q.pattern_distribution(view(spark, sf, "label_rows"))


@query(
    "framework_distribution", "A3",
    sql("label_rows")
    + "SELECT framework, count(*) AS n, count(*) FILTER (WHERE label = 1) AS vulnerable, count(*) FILTER (WHERE label <> 1) AS safe FROM "
    "(SELECT coalesce(framework, CASE WHEN contains(lower(file), 'flask') THEN 'flask' WHEN contains(lower(file), 'django') THEN 'django' ELSE 'unknown' END) AS framework, label FROM label_rows) GROUP BY framework",
)
def framework_distribution(spark, sf):
    rows = view(spark, sf, "label_rows").withColumn(
        "frameworks", F.when(F.col("framework").isNotNull(), F.array("framework")).otherwise(F.array().cast("array<string>"))
    )
    return Q.framework_distribution(rows.drop("framework"))


@query(
    "rule_hits", "A4",
    sql("day_nodes")
    + ", h AS (SELECT 'source' AS what, source_id AS value FROM day_nodes WHERE source_id IS NOT NULL UNION ALL SELECT 'sink', sink_id FROM day_nodes WHERE sink_id IS NOT NULL "
    "UNION ALL SELECT 'sink_kind', sink_kind FROM day_nodes WHERE sink_id IS NOT NULL) SELECT what, value, count(*) AS n FROM h GROUP BY GROUPING SETS ((what, value), (what))",
)
def rule_hits(spark, sf):
    return Q.rule_hits(day_nodes(spark, sf))


@query(
    "data_origin", "A5",
    sql("label_rows")
    + ", c AS (SELECT CASE WHEN contains(lower(sample_type || ' ' || meta_text), 'synthetic') THEN 's' WHEN coalesce(repo_url, '') <> '' OR coalesce(cve_id, '') <> '' THEN 'r' ELSE 'u' END AS k FROM label_rows), "
    "t AS (SELECT count(*) FILTER (WHERE k = 's') AS synthetic, count(*) FILTER (WHERE k = 'r') AS real, count(*) FILTER (WHERE k = 'u') AS unknown, count(*) AS total FROM c) "
    "SELECT *, round(100 * (synthetic / total), 6) AS synthetic_percentage, round(100 * (real / total), 6) AS real_percentage, synthetic / total BETWEEN 0.2 AND 0.8 AS is_balanced FROM t",
)
def data_origin(spark, sf):
    return _rounded(Q.data_origin(view(spark, sf, "label_rows")), "synthetic_percentage", "real_percentage")


_SIZES = (
    "n AS (SELECT file, count(*) AS nodes FROM nodes GROUP BY file), e AS (SELECT file, count(*) AS edges FROM edges GROUP BY file), s AS (SELECT file, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges "
    "FROM (SELECT 'o' || CAST(o_orderkey AS STRING) AS file FROM orders UNION SELECT 'e' || CAST(c_custkey AS STRING) FROM customer) LEFT JOIN n USING (file) LEFT JOIN e USING (file))"
)


def _graphs(spark, sf):
    """All graphs: one per order, and one without nodes per customer."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file"))
    return o.union(table(spark, sf, "customer").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string"))))


_STATS = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, CAST(median({c}) AS DOUBLE) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in ("nodes", "edges")
)


@query("graph_size_statistics", "A6", ORDER_GRAPH_SQL + f", {_SIZES} SELECT count(*) AS graphs, {_STATS} FROM s")
def graph_size_statistics(spark, sf):
    s = Q.size_statistics(Q.graph_sizes(order_nodes(spark, sf), order_edges(spark, sf), _graphs(spark, sf)))
    return _rounded(s, "nodes_mean", "nodes_std", "edges_mean", "edges_std")


_COVER = (
    "g AS (SELECT file, CAST(bool_or(source_id IS NOT NULL) AS INTEGER) AS s, CAST(bool_or(sink_id IS NOT NULL) AS INTEGER) AS t, CAST(bool_or(sanitizer_kind IS NOT NULL) AS INTEGER) AS z FROM day_nodes GROUP BY file) "
    "SELECT count(*) AS graphs, CAST(sum(s) AS BIGINT) AS with_source, CAST(sum(t) AS BIGINT) AS with_sink, CAST(sum(z) AS BIGINT) AS with_sanitizer, "
    "round(avg(s) * 100, 6) AS source_coverage, round(avg(t) * 100, 6) AS sink_coverage, round(avg(z) * 100, 6) AS sanitizer_coverage FROM g"
)


@query(
    "rule_coverage", "A7",
    sql("day_nodes") + ", " + _COVER.replace("FROM day_nodes GROUP BY file) ", "FROM day_nodes GROUP BY file UNION ALL SELECT 'e' || CAST(c_custkey AS STRING), 0, 0, 0 FROM customer) "),
)
def rule_coverage(spark, sf):
    nodes = day_nodes(spark, sf)
    empty = table(spark, sf, "customer").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("file"))
    return _rounded(Q.rule_coverage(nodes, nodes.select("file").union(empty)), "source_coverage", "sink_coverage", "sanitizer_coverage")


@query(
    "validation_report", "A6 A7 S14",
    sql("day_nodes")
    + ", ch AS (SELECT file, count(*) - 1 AS edges, count(*) AS nodes FROM day_nodes GROUP BY file), a AS (SELECT count(*) AS graphs, round(avg(nodes), 6) AS nodes_mean, round(avg(edges), 6) AS edges_mean FROM ch), "
    + "c AS (WITH " + _COVER + ") SELECT a.*, source_coverage, sink_coverage, sanitizer_coverage FROM a, c",
)
def validation_report(spark, sf):
    from codeloom.plans.query_features import _chain

    r = PG.validation_report(day_nodes(spark, sf), _chain(spark, sf))
    return _rounded(
        r.select("graphs", "nodes_mean", "edges_mean", "source_coverage", "sink_coverage", "sanitizer_coverage"),
        "nodes_mean", "edges_mean", "source_coverage", "sink_coverage", "sanitizer_coverage",
    )


@query(
    "refreshed_cardinalities", "A8",
    sql("vuln_records")
    + "SELECT 'cve_id' AS \"column\", count(DISTINCT cve_id) AS \"distinct\" FROM vuln_records WHERE cwe_id IS NULL UNION ALL "
    "SELECT 'repo_url', count(DISTINCT repo_url) FROM vuln_records WHERE cwe_id IS NULL UNION ALL SELECT 'file_path', count(DISTINCT file_path) FROM vuln_records WHERE cwe_id IS NULL",
)
def refreshed_cardinalities(spark, sf):
    """Distinct values after records with a CWE have gone, from the states of two batches."""
    r = view(spark, sf, "vuln_records")
    names = ["cve_id", "repo_url", "file_path"]
    gone = RU.signed(r.where(F.lit(False)), r.where("cwe_id IS NOT NULL"))
    return RU.cardinalities(RU.merged_values(RU.value_states(RU.signed(r), names), RU.value_states(gone, names)))


@query(
    "corpus_cardinalities", "A8",
    sql("vuln_records") + "SELECT count(*) AS total_records, count(DISTINCT cve_id) AS unique_cves, count(DISTINCT repo_url) AS unique_repos, count(DISTINCT file_path) AS unique_files FROM vuln_records",
)
def corpus_cardinalities(spark, sf):
    return Q.corpus_cardinalities(view(spark, sf, "vuln_records"))


@query(
    "top_cves_repositories_types", "A9 L5",
    sql("vuln_records")
    + ", c AS (SELECT 'cve' AS what, cve_id AS value, count(*) AS n FROM vuln_records WHERE cve_id IS NOT NULL GROUP BY cve_id ORDER BY n DESC, value LIMIT 10), "
    "r AS (SELECT 'repo', split_part(repo_url, '/', -1) AS value, count(*) AS n FROM vuln_records GROUP BY ALL ORDER BY n DESC, value LIMIT 5), "
    "t AS (SELECT 'type', coalesce(vulnerability_type, 'Unknown') AS value, count(*) AS n FROM vuln_records GROUP BY ALL) SELECT * FROM c UNION ALL SELECT * FROM r UNION ALL SELECT * FROM t",
)
def top_cves_repositories_types(spark, sf):
    v = view(spark, sf, "vuln_records")
    repo = F.element_at(F.split("repo_url", "/"), -1)
    parts = [("cve", F.col("cve_id"), 10), ("repo", repo, 5), ("type", F.coalesce("vulnerability_type", F.lit("Unknown")), None)]
    out = [Q.top_counts(v, key, "value", k).select(F.lit(what).alias("what"), "value", "n") for what, key, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_LINES = "CASE WHEN {0} = '' THEN 0 WHEN {0} LIKE '%' || chr(10) THEN length({0}) - length(replace({0}, chr(10), '')) ELSE length({0}) - length(replace({0}, chr(10), '')) + 1 END"


@query(
    "record_code_quality", "A10",
    sql("vuln_records")
    + "SELECT count(*) FILTER (WHERE ok) AS records_with_code, count(*) FILTER (WHERE NOT ok) AS records_without_code, "
    "CAST(floor(avg(length(code_before)) FILTER (WHERE ok)) AS BIGINT) AS avg_code_length_before, CAST(floor(avg(length(code_after)) FILTER (WHERE ok)) AS BIGINT) AS avg_code_length_after, "
    f"CAST(floor(avg({_LINES.format('code_before')}) FILTER (WHERE ok)) AS BIGINT) AS avg_lines_before, CAST(floor(avg({_LINES.format('code_after')}) FILTER (WHERE ok)) AS BIGINT) AS avg_lines_after "
    "FROM (SELECT *, code_before <> '' AND code_after <> '' AS ok FROM vuln_records)",
)
def record_code_quality(spark, sf):
    return Q.code_quality(view(spark, sf, "vuln_records"))


@query(
    "graph_quality", "A11",
    ORDER_GRAPH_SQL + f", {_SIZES} SELECT (SELECT count(*) FROM s) AS total_graphs, count(*) AS valid_graphs, CAST(floor(avg(nodes)) AS BIGINT) AS avg_nodes, CAST(floor(avg(edges)) AS BIGINT) AS avg_edges FROM s WHERE nodes > 0",
)
def graph_quality(spark, sf):
    return Q.graph_quality(Q.graph_sizes(order_nodes(spark, sf), order_edges(spark, sf), _graphs(spark, sf)))


@query(
    "dataset_statistics", "A12",
    sql("samples") + ", s AS (SELECT CASE project WHEN 'src1' THEN 'test' WHEN 'src2' THEN 'val' ELSE 'train' END AS split, label FROM samples) SELECT split, label, count(*) AS n FROM s GROUP BY ROLLUP (split, label)",
)
def dataset_statistics(spark, sf):
    s = view(spark, sf, "samples").withColumn("split", F.expr("CASE project WHEN 'src1' THEN 'test' WHEN 'src2' THEN 'val' ELSE 'train' END"))
    return Q.dataset_statistics(s)


@query(
    "class_ratios", "A12",
    sql("samples")
    + "SELECT count(*) AS total_samples, count(*) FILTER (WHERE label = 1) AS vulnerable, count(*) FILTER (WHERE label = 0) AS safe, round(count(*) FILTER (WHERE label = 1) / count(*), 6) AS vulnerable_ratio, "
    "round(count(*) FILTER (WHERE label = 0) / count(*), 6) AS safe_ratio FROM samples",
)
def class_ratios(spark, sf):
    return _rounded(Q.class_ratios(view(spark, sf, "samples")), "vulnerable_ratio", "safe_ratio")


@query("vulnerable_by_framework", "A12", sql("samples") + "SELECT framework, count(*) AS n FROM samples WHERE label = 1 GROUP BY framework")
def vulnerable_by_framework(spark, sf):
    return Q.vulnerable_by(view(spark, sf, "samples"), "framework")


@query(
    "merge_report", "A13",
    sql("vuln_records")
    + ", r AS (SELECT coalesce(vulnerability_type, 'Unknown') AS vulnerability_type, synthetic FROM vuln_records) SELECT vulnerability_type, count(*) AS n, count(*) FILTER (WHERE synthetic) AS synthetic, "
    "round(count(*) FILTER (WHERE synthetic) * 100.0 / count(*), 6) AS synthetic_percentage FROM r GROUP BY ROLLUP (vulnerability_type)",
)
def merge_report(spark, sf):
    return _rounded(Q.merge_report(view(spark, sf, "vuln_records")), "synthetic_percentage")


@query(
    "needed_samples", "A14",
    sql("vuln_records")
    + ", t AS (SELECT * FROM (VALUES ('XSS', 100), ('SSRF', 300), ('DoS', 50), ('SQL Injection', 10)) v(vulnerability_type, target)), c AS (SELECT vulnerability_type, count(*) AS n FROM vuln_records GROUP BY 1) "
    "SELECT t.vulnerability_type, target, coalesce(n, 0) AS current, greatest(0, target - coalesce(n, 0)) AS needed FROM t LEFT JOIN c USING (vulnerability_type)",
)
def needed_samples(spark, sf):
    targets = spark.createDataFrame([("XSS", 100), ("SSRF", 300), ("DoS", 50), ("SQL Injection", 10)], "vulnerability_type string, target int")
    return Q.needed_samples(targets, view(spark, sf, "vuln_records"))


_RISK = "CASE WHEN synthetic THEN 0.9 WHEN patched THEN CASE WHEN post_patch THEN 0.2 ELSE 0.8 END WHEN bandit_score > 0 THEN bandit_score ELSE 0.0 END"


@query(
    "signal_statistics", "A15 X13",
    sql("signals")
    + f", s AS (SELECT *, CAST({_RISK} AS DOUBLE) AS risk_score FROM signals) SELECT count(*) AS samples, count(*) FILTER (WHERE patched) AS patched, count(*) FILTER (WHERE synthetic) AS synthetic, "
    + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("risk_score", "bandit_score"))
    + " FROM s",
)
def signal_statistics(spark, sf):
    s = view(spark, sf, "signals")
    risk = SG.risk_score(F.col("bandit_score"), F.col("patched"), F.col("post_patch"), F.col("synthetic"))
    out = Q.signal_statistics(s.withColumn("risk_score", risk))
    return _rounded(out, "risk_score_mean", "risk_score_std", "bandit_score_mean", "bandit_score_std")


@query(
    "risk_scores", "X13 X14 D12",
    sql("signals")
    + f"SELECT sample_id, CAST({_RISK} AS DOUBLE) AS risk, CAST(coalesce(explicit, label_bandit, CASE WHEN patched THEN CASE WHEN post_patch THEN 0.2 ELSE 0.8 END END, CASE WHEN synthetic THEN 0.9 END, 0.0) AS DOUBLE) AS label_risk, "
    "CAST(CASE WHEN bandit_score > 0 THEN bandit_score ELSE 0.0 END AS DOUBLE) AS weak_only, CAST(CASE WHEN patched THEN CASE WHEN post_patch THEN 0.2 ELSE 0.8 END ELSE 0.0 END AS DOUBLE) AS patch_only, "
    "CAST(CASE WHEN synthetic THEN 0.9 ELSE 0.0 END AS DOUBLE) AS synthetic_only FROM signals",
)
def risk_scores(spark, sf):
    b, p, o, s = (F.col(c) for c in ("bandit_score", "patched", "post_patch", "synthetic"))
    views = {"risk": "full", "weak_only": "weak", "patch_only": "patch", "synthetic_only": "synthetic"}
    return view(spark, sf, "signals").select(
        "sample_id", SG.label_risk_score(F.col("explicit"), F.col("label_bandit"), p, o, s).alias("label_risk"),
        *[SG.risk_score(b, p, o, s, SG.SIGNAL_SETS[k]).alias(n) for n, k in views.items()],
    )


@query(
    "quality_score", "A26",
    sql("vuln_records")
    + ", t AS (SELECT lang AS v, count(*) AS total_records, count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN n_chars % 60 END) AS unique_cves, count(*) FILTER (WHERE doc_id % 7 = 0) AS records_without_code, count(*) FILTER (WHERE quality = 1) AS valid_graphs "
    "FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source), s AS (SELECT *, greatest(0, 100 - CASE WHEN total_records < 10 THEN 30 ELSE 0 END - CASE WHEN unique_cves < 3 THEN 20 ELSE 0 END - CASE WHEN records_without_code > total_records * 0.1 THEN 15 ELSE 0 END - CASE WHEN valid_graphs = 0 THEN 25 ELSE 0 END) AS quality_score FROM t) "
    "SELECT quality_score, CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'acceptable' ELSE 'needs improvement' END AS band, count(*) AS n FROM s GROUP BY ALL",
)
def quality_score(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    t = d.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct(F.expr("CASE WHEN doc_id % 4 <> 0 THEN n_chars % 60 END")).alias("unique_cves"),
        F.count_if(F.expr("doc_id % 7 = 0")).alias("records_without_code"), F.count_if(F.col("quality") == 1).alias("valid_graphs"),
    )
    return Q.quality_score(t).groupBy("quality_score", "band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_diagnosis", "A27 J1",
    sql("label_rows")
    + f", {_BALANCE} SELECT g AS graph_count, l AS label_count, g = l AS aligned, abs(g - l) AS difference, round(r, 6) AS imbalance_ratio, "
    "concat_ws(';', CASE WHEN g <> l THEN 'Fix graph-label alignment' END, CASE WHEN r > 2 THEN 'Use weighted loss function' END, CASE WHEN classes < 2 THEN 'Add samples from the missing class' END) AS recommendations "
    "FROM b, (SELECT count(*) AS g FROM documents), (SELECT count(*) AS l FROM labels)",
)
def dataset_diagnosis(spark, sf):
    d = Q.diagnosis(table(spark, sf, "documents"), view(spark, sf, "label_rows"))
    return d.select(
        "graph_count", "label_count", "aligned", "difference", F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
        F.array_join("recommendations", ";").alias("recommendations"),
    )


@query(
    "graph_label_alignment", "J1",
    "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS matched, count(*) FILTER (WHERE l.doc_id IS NULL) AS graphs_only, "
    "(SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS labels_only FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def graph_label_alignment(spark, sf):
    return Q.alignment(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
