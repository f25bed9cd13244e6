"""Tenants, projects, scans, jobs and audit logs: P18, P20, L3-L5, A21-A25, X15, X23."""

from pyspark.sql import functions as F

from codeloom.operators import rollups as RU
from codeloom.operators import tenancy as TN
from codeloom.operators import weak_signals as WS
from codeloom.plans.registry import query
from codeloom.plans.views import day_nodes, sql, table, view
from codeloom.session import dealt, grown, scratch_path


@query(
    "filtered_findings", "P18",
    sql("findings") + "SELECT finding_id FROM findings WHERE severity = 'high' AND status = 'open' AND owasp_category = 'A13'",
)
def filtered_findings(spark, sf):
    return TN.only(view(spark, sf, "findings"), severity="high", status="open", owasp_category="A13", project_id=None).select("finding_id")


@query("scans_by_status", "P18 P20", sql("scans") + "SELECT scan_id FROM scans WHERE status = 'failed' AND tenant_id = 't3'")
def scans_by_status(spark, sf):
    return TN.only(view(spark, sf, "scans"), status="failed", tenant_id="t3").select("scan_id")


@query(
    "newest_audit_rows", "L4 P20",
    sql("audit") + "SELECT id, actor, action FROM audit WHERE tenant_id = 't4' AND result = 'failure' ORDER BY ts DESC, id LIMIT 50",
)
def newest_audit_rows(spark, sf):
    return TN.newest(view(spark, sf, "audit"), "ts", 50, tenant_id="t4", result="failure").select("id", "actor", "action")


@query("recent_scans", "L5", sql("scans") + "SELECT scan_id, status FROM scans ORDER BY created_at DESC, scan_id LIMIT 5")
def recent_scans(spark, sf):
    return TN.newest(view(spark, sf, "scans"), "created_at", 5, "scan_id").select("scan_id", "status")


@query(
    "recent_open_findings", "L5",
    sql("findings") + "SELECT finding_id, severity FROM findings WHERE status = 'open' ORDER BY created_at DESC, finding_id LIMIT 5",
)
def recent_open_findings(spark, sf):
    return TN.newest(view(spark, sf, "findings"), "created_at", 5, "finding_id", status="open").select("finding_id", "severity")


@query(
    "scan_page", "L3",
    sql("scans")
    + "SELECT scan_id, 3 AS page, 100 AS page_size, (SELECT count(*) FROM scans) AS total, CAST(ceil((SELECT count(*) FROM scans) / 100) AS BIGINT) AS total_pages FROM scans ORDER BY created_at DESC, scan_id LIMIT 100 OFFSET 200",
)
def scan_page(spark, sf):
    p = TN.page_of(view(spark, sf, "scans"), 3, 500, "created_at", "scan_id")
    return p.select("scan_id", "page", "page_size", "total", "total_pages")


@query(
    "order_page", "L3",
    sql("findings") + "SELECT finding_id, 1 AS page, 20 AS page_size, (SELECT count(*) FROM findings) AS total FROM findings ORDER BY created_at DESC, finding_id LIMIT 20",
)
def order_page(spark, sf):
    p = TN.page_of(view(spark, sf, "findings"), 0, None, "created_at", "finding_id")
    return p.select("finding_id", "page", "page_size", "total")


_NOW = "TIMESTAMP '2024-01-30 00:00:00'"


@query(
    "dashboard", "A21",
    sql("projects", "scans", "findings")
    + "SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM projects WHERE active) AS active_projects, (SELECT count(*) FROM scans) AS scans, "
    f"(SELECT count(*) FROM scans WHERE created_at > {_NOW} - INTERVAL 7 DAY) AS scans_this_week, (SELECT count(*) FROM scans WHERE created_at > {_NOW} - INTERVAL 30 DAY) AS scans_this_month, "
    "(SELECT count(*) FROM findings) AS findings, (SELECT count(*) FROM findings WHERE status = 'open') AS open_findings, (SELECT count(*) FROM findings WHERE status = 'fixed') AS fixed_findings, "
    + ", ".join(f"(SELECT count(*) FROM findings WHERE severity = '{s}') AS {s}" for s in TN.SEVERITIES)
    + ", (SELECT string_agg(owasp_category || '=' || CAST(n AS VARCHAR), ',' ORDER BY owasp_category) FROM (SELECT owasp_category, count(*) AS n FROM findings GROUP BY 1)) AS by_owasp",
)
def dashboard(spark, sf):
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    d = TN.dashboard(view(spark, sf, "projects"), view(spark, sf, "scans"), view(spark, sf, "findings"), now)
    flat = F.array_join(F.transform(F.map_entries("by_owasp"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return d.withColumn("by_owasp", flat)


@query(
    "daily_trend", "A22",
    sql("scans", "findings")
    + ", d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date), s AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM scans GROUP BY 1), "
    "f AS (SELECT CAST(created_at + INTERVAL 26 YEAR AS DATE) AS date, count(*) AS n FROM findings GROUP BY 1), x AS (SELECT CAST(fixed_at + INTERVAL 26 YEAR AS DATE) AS date, count(*) AS n FROM findings GROUP BY 1) "
    "SELECT strftime(d.date, '%Y-%m-%d') AS date, coalesce(s.n, 0) AS scans, coalesce(f.n, 0) AS findings, coalesce(x.n, 0) AS fixed FROM d LEFT JOIN s USING (date) LEFT JOIN f USING (date) LEFT JOIN x USING (date)",
)
def daily_trend(spark, sf):
    later = F.expr("INTERVAL 26 YEAR")
    f = view(spark, sf, "findings").withColumns({"created_at": F.col("created_at") + later, "fixed_at": F.col("fixed_at") + later})
    t = TN.daily_trend(view(spark, sf, "scans"), f, F.expr("DATE '2023-12-25'"), F.expr("DATE '2024-02-05'"))
    return t.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "project_stats", "A23",
    sql("projects", "scans", "findings")
    + ", s AS (SELECT project_id, count(*) AS n, max(created_at) AS m FROM scans GROUP BY 1), f AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS o, count(*) FILTER (WHERE status = 'fixed') AS x FROM findings GROUP BY 1) "
    "SELECT p.project_id, coalesce(s.n, 0) AS total_scans, coalesce(f.n, 0) AS total_findings, coalesce(o, 0) AS open_findings, coalesce(x, 0) AS fixed_findings, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_scan_at "
    "FROM projects p LEFT JOIN s USING (project_id) LEFT JOIN f USING (project_id)",
)
def project_stats(spark, sf):
    p = TN.project_stats(view(spark, sf, "projects"), view(spark, sf, "scans"), view(spark, sf, "findings"))
    return p.withColumn("last_scan_at", F.date_format("last_scan_at", "yyyy-MM-dd HH:mm:ss"))


_THEN, _MADE = "TIMESTAMP '2024-01-20 00:00:00'", "1996-01-01"
_LEFT = f", left_scans AS (SELECT * FROM scans WHERE NOT (status = 'failed' AND created_at < {_THEN}))"


def _refreshed(spark, sf):
    """States of a first batch, every finding then open, and of the changes since: new rows, fixed findings, removed failed scans."""
    scans, findings = view(spark, sf, "scans"), view(spark, sf, "findings")
    new_scan, new_finding = F.expr(f"created_at >= {_THEN.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}"), F.col("created_at") >= F.lit(_MADE).cast("date")
    was = findings.where(~new_finding)
    before = was.withColumns({"status": F.when(F.col("status") == "fixed", "open").otherwise(F.col("status")), "fixed_at": F.lit(None).cast(findings.schema["fixed_at"].dataType)})
    changed = F.col("finding_id").isNotNull() & F.col("fixed_at").isNotNull()
    old = was.where(changed).withColumns({"status": F.lit("open"), "fixed_at": F.lit(None).cast(findings.schema["fixed_at"].dataType)})
    folder = scratch_path(spark, "rollup")
    first = RU.day_states(RU.signed(scans.where(~new_scan)), RU.signed(before))
    RU.store_batch(first, folder, 1)
    since = RU.day_states(
        RU.signed(scans.where(new_scan), scans.where(~new_scan & (F.col("status") == "failed"))),
        RU.signed(findings.where(new_finding).unionByName(was.where(changed)), old),
    )
    for _ in range(2):  # the second time is a batch tried again
        RU.store_batch(since, folder, 2)
    left = scans.where(new_scan | (F.col("status") != "failed"))
    return RU.merged(RU.stored(spark, folder)), left


@query(
    "refreshed_project_stats", "A23",
    sql("projects", "scans", "findings") + _LEFT
    + ", s AS (SELECT project_id, count(*) AS n, max(created_at) AS m FROM left_scans GROUP BY 1), f AS (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS o, count(*) FILTER (WHERE status = 'fixed') AS x FROM findings GROUP BY 1) "
    "SELECT p.project_id, coalesce(s.n, 0) AS total_scans, coalesce(f.n, 0) AS total_findings, coalesce(o, 0) AS open_findings, coalesce(x, 0) AS fixed_findings, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_scan_at "
    "FROM projects p LEFT JOIN s USING (project_id) LEFT JOIN f USING (project_id)",
)
def refreshed_project_stats(spark, sf):
    states, left = _refreshed(spark, sf)
    p = RU.project_stats(view(spark, sf, "projects"), states, left)
    return p.withColumn("last_scan_at", F.date_format("last_scan_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "refreshed_totals", "A21",
    sql("scans", "findings") + _LEFT
    + " SELECT (SELECT count(*) FROM left_scans) AS scans, count(*) AS findings, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'fixed') AS fixed, "
    + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in TN.SEVERITIES) + " FROM findings",
)
def refreshed_totals(spark, sf):
    return RU.totals(_refreshed(spark, sf)[0])


@query(
    "refreshed_trend", "A22",
    sql("scans", "findings") + _LEFT
    + ", d AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date), s AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM left_scans GROUP BY 1), "
    "f AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM findings GROUP BY 1), x AS (SELECT CAST(fixed_at AS DATE) AS date, count(*) AS n FROM findings GROUP BY 1) "
    "SELECT strftime(d.date, '%Y-%m-%d') AS date, coalesce(s.n, 0) AS scans, coalesce(f.n, 0) AS findings, coalesce(x.n, 0) AS fixed FROM d LEFT JOIN s USING (date) LEFT JOIN f USING (date) LEFT JOIN x USING (date)",
)
def refreshed_trend(spark, sf):
    t = RU.daily_trend(_refreshed(spark, sf)[0], F.expr("DATE '1992-01-01'"), F.expr("DATE '2024-02-05'"))
    return t.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "scan_severities", "A24",
    sql("findings") + "SELECT scan_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in TN.SEVERITIES) + " FROM findings GROUP BY scan_id",
)
def scan_severities(spark, sf):
    return TN.scan_severities(view(spark, sf, "findings"))


@query(
    "ship_durations", "A24",
    "SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(date_diff('millisecond', o_orderdate, l_shipdate)) AS BIGINT) AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def ship_durations(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines, orders = dealt(["l_orderkey"], lines, orders)
    ms = TN.duration_ms(F.col("o_orderdate"), F.col("l_shipdate"))
    return lines.join(grown(orders), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("duration_ms"))


_ANALYSER = "SELECT 'u' || CAST(user_id AS VARCHAR) AS file, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'Low' ELSE 'NONE' END AS severity, CASE WHEN event_type <> 'signup' THEN 'B' || CAST(event_id % 20 AS VARCHAR) ELSE '' END AS test_id FROM events WHERE value > 30"


def _analyser(spark, sf):
    e = table(spark, sf, "events").where("value > 30")
    return e.select(
        F.expr("'u' || CAST(user_id AS STRING)").alias("file"),
        F.expr("CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'Low' ELSE 'NONE' END").alias("severity"),
        F.expr("CASE WHEN event_type <> 'signup' THEN 'B' || CAST(event_id % 20 AS STRING) ELSE '' END").alias("test_id"),
    )


_SIGNALS = (
    f"WITH a AS ({_ANALYSER}), s AS (SELECT file, max(CASE upper(severity) WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.3 ELSE 0.0 END) AS bandit_score, "
    "coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT b.test_id AS t FROM a b WHERE b.file = a.file AND b.test_id <> '')), '') AS bandit_rules, "
    "count(*) FILTER (WHERE upper(severity) = 'HIGH') AS high, count(*) FILTER (WHERE upper(severity) = 'MEDIUM') AS medium, count(*) FILTER (WHERE upper(severity) = 'LOW') AS low FROM a GROUP BY file) "
)


@query("analyser_signals", "A25 K4", _SIGNALS + "SELECT file, CAST(bandit_score AS DOUBLE) AS bandit_score, bandit_rules, high, medium, low FROM s")
def analyser_signals(spark, sf):
    s = WS.analyser_signals(_analyser(spark, sf)).withColumn("bandit_rules", F.array_join("bandit_rules", ","))
    return s.withColumnsRenamed({"HIGH": "high", "MEDIUM": "medium", "LOW": "low"})


@query(
    "attached_signals", "X15 X13 K4",
    _SIGNALS
    + ", g AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS file, c_custkey % 3 = 0 AS patched, c_custkey % 2 = 0 AS post, c_custkey % 7 = 0 AS synthetic FROM customer) "
    "SELECT g.file AS code_id, CAST(CASE WHEN synthetic THEN 0.9 WHEN patched THEN CASE WHEN post THEN 0.2 ELSE 0.8 END ELSE coalesce(bandit_score, 0) END AS DOUBLE) AS risk_score, CAST(coalesce(bandit_score, 0) AS DOUBLE) AS bandit_score, "
    "CASE WHEN patched THEN post END AS is_post_patch, CAST(coalesce(high, 0) AS INTEGER) AS high FROM g LEFT JOIN s USING (file)",
)
def attached_signals(spark, sf):
    g = table(spark, sf, "customer").selectExpr(
        "'u' || CAST(c_custkey AS STRING) AS file", "c_custkey % 3 = 0 AS patched", "c_custkey % 2 = 0 AS is_post_patch", "c_custkey % 7 = 0 AS synthetic"
    )
    e = WS.label_entries(WS.attached_signals(g, WS.analyser_signals(_analyser(spark, sf))))
    return e.select(
        "code_id", "risk_score", "metadata.bandit_score", "metadata.is_post_patch", F.col("metadata.severity_counts")["HIGH"].alias("high")
    )


@query(
    "expiry_dates", "X23 R6",
    sql("scans")
    + "SELECT scan_id, strftime(created_at + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at FROM scans WHERE created_at + INTERVAL 30 DAY > TIMESTAMP '2024-02-10 00:00:00'",
)
def expiry_dates(spark, sf):
    s = view(spark, sf, "scans").withColumn("expires_at", TN.expiry(F.col("created_at"), 30))
    live = TN.unexpired(s, "expires_at", F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'"))
    return live.select("scan_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query(
    "rule_signals", "K4 A25",
    sql("day_nodes")
    + "SELECT file, CAST(max(CASE WHEN sink_failed IS NULL THEN 1.0 ELSE 0.3 END) AS DOUBLE) AS bandit_score, count(*) FILTER (WHERE sink_failed IS NULL) AS high, count(*) FILTER (WHERE sink_failed IS NOT NULL) AS low "
    "FROM day_nodes WHERE sink_id IS NOT NULL GROUP BY file",
)
def rule_signals(spark, sf):
    s = WS.analyser_signals(WS.rule_results(day_nodes(spark, sf)))
    return s.select("file", "bandit_score", F.col("HIGH").alias("high"), F.col("LOW").alias("low"))


@query(
    "analysed_documents", "K4",
    "SELECT 'd' || CAST(doc_id AS VARCHAR) AS file, CAST(CASE WHEN contains(text, 'token') THEN 1.0 ELSE 0.6 END AS DOUBLE) AS bandit_score FROM documents WHERE contains(text, 'token') OR contains(text, chr(10))",
)
def analysed_documents(spark, sf):
    """A plugged-in analyser over whole texts."""
    def analyse(file, text):
        found = [("T1", "HIGH")] if "token" in text else []
        return found + ([("T2", "MEDIUM")] if "\n" in text else [])

    docs = table(spark, sf, "documents").select(F.expr("'d' || CAST(doc_id AS STRING)").alias("file"), F.col("text").alias("code"))
    return WS.analyser_signals(WS.analysed_files(docs, analyse)).select("file", "bandit_score")
