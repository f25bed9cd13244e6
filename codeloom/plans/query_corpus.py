"""Corpus building: U1, U2, W5, W6, L6, L7, D1-D4, D7-D9, S13."""

from pyspark.sql import functions as F

from codeloom.operators import corpus as C
from codeloom.plans import graphs as PG
from codeloom.operators.near_copies import near_copy_classes as near_copies_of
from codeloom.plans.registry import query
from codeloom.plans.views import ORDER_GRAPH_SQL, order_nodes, sql, table, view
from codeloom.session import scratch_path
from codeloom.sources import files as FI
from codeloom.sources import graphs as GR
from codeloom.sources import records as RC

_H = "sha256('42|' || CAST({0} AS STRING))"
_ORDER = f"{_H.format('sample_id')}, sample_id"


@query(
    "split_by_position", "W5 S13",
    sql("samples")
    + f", r AS (SELECT sample_id, row_number() OVER (ORDER BY {_ORDER}) AS rn, count(*) OVER () AS n FROM samples) "
    "SELECT sample_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r",
)
def split_by_position(spark, sf):
    return C.split_by_position(view(spark, sf, "samples")).select("sample_id", "split")


@query(
    "split_by_project", "D1",
    sql("samples")
    + f", p AS (SELECT project, count(*) AS n FROM samples GROUP BY project), c AS (SELECT project, (sum(n) OVER (ORDER BY {_H.format('project')}, project ROWS UNBOUNDED PRECEDING) - n) / sum(n) OVER () AS start FROM p) "
    "SELECT sample_id, CASE WHEN start < 0.6 THEN 'train' WHEN start < 0.6 + 0.2 THEN 'val' ELSE 'test' END AS split FROM samples JOIN c USING (project)",
)
def split_by_project(spark, sf):
    return C.split_by_project(view(spark, sf, "samples")).select("sample_id", "split")


@query(
    "split_by_time", "D2",
    "WITH r AS (SELECT event_id, percent_rank() OVER (ORDER BY ts, event_id) AS p FROM events) SELECT event_id, CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'val' ELSE 'test' END AS split FROM r",
)
def split_by_time(spark, sf):
    return C.split_by_time(table(spark, sf, "events"), "ts", "event_id").select("event_id", "split")


@query(
    "balanced_samples", "W6",
    sql("samples")
    + f", s AS (SELECT sample_id, row_number() OVER (ORDER BY {_ORDER}) AS rn, count(*) OVER () AS n FROM samples WHERE sample_type = 'originally_safe'), "
    "o AS (SELECT count(*) AS k FROM samples WHERE sample_type <> 'originally_safe'), t AS (SELECT greatest(1, floor(0.5 * k / (1 - 0.5))) AS target FROM o), "
    "c AS (SELECT sample_id, CAST(floor((target - rn + n) / n) AS BIGINT) AS copies FROM s, t) "
    "SELECT sample_id, 1 AS copies FROM samples WHERE sample_type <> 'originally_safe' UNION ALL SELECT sample_id, copies FROM c WHERE copies >= 1",
)
def balanced_samples(spark, sf):
    b = C.balanced(view(spark, sf, "samples"), 0.5)
    return b.groupBy("sample_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "balanced_per_framework", "D7",
    sql("samples")
    + f", r AS (SELECT framework, sample_id, row_number() OVER (PARTITION BY framework ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY framework) AS n FROM samples) "
    "SELECT framework, sample_id, CAST(floor((60 - rn + n) / n) AS BIGINT) AS copies FROM r WHERE floor((60 - rn + n) / n) >= 1",
)
def balanced_per_framework(spark, sf):
    b = C.balanced_per_group(view(spark, sf, "samples"), "framework", 60)
    return b.groupBy("framework", "sample_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "ratio_merge", "D8",
    sql("samples")
    + ", w AS (SELECT min(n / CASE origin WHEN 'real' THEN 0.6 WHEN 'synthetic' THEN 0.3 ELSE 0.1 END) AS whole FROM (SELECT origin, count(*) AS n FROM samples GROUP BY origin)), "
    f"r AS (SELECT origin, sample_id, row_number() OVER (PARTITION BY origin ORDER BY {_ORDER}) AS rn FROM samples) "
    "SELECT origin, sample_id FROM r, w WHERE rn <= floor(whole * CASE origin WHEN 'real' THEN 0.6 WHEN 'synthetic' THEN 0.3 ELSE 0.1 END + 0.000000001)",
)
def ratio_merge(spark, sf):
    return C.ratio_merge(view(spark, sf, "samples"), {"real": 0.6, "synthetic": 0.3, "augmented": 0.1}).select("origin", "sample_id")


@query(
    "sampled_per_project", "L6",
    sql("samples")
    + f", r AS (SELECT *, {_H.format('sample_id')} AS h, row_number() OVER (PARTITION BY project ORDER BY {_ORDER}) AS rn FROM samples) SELECT project, sample_id FROM r WHERE rn <= 10 ORDER BY h, sample_id LIMIT 120",
)
def sampled_per_project(spark, sf):
    return C.sampled_per_group(view(spark, sf, "samples"), "project", 10, 120).select("project", "sample_id")


@query(
    "review_samples", "D9",
    sql("samples")
    + f", r AS (SELECT *, row_number() OVER (PARTITION BY framework ORDER BY {_ORDER}) AS rn FROM samples) SELECT framework, sample_id FROM r WHERE rn <= 15",
)
def review_samples(spark, sf):
    return C.sampled_per_group(view(spark, sf, "samples"), "framework", 15).select("framework", "sample_id")


@query(
    "capped_collection", "L7",
    sql("samples")
    + ", q AS (SELECT *, row_number() OVER (PARTITION BY framework, project ORDER BY sample_id) AS a FROM samples), g AS (SELECT *, row_number() OVER (PARTITION BY framework ORDER BY project, sample_id) AS b FROM q WHERE a <= 3) "
    "SELECT framework, project, sample_id FROM g WHERE b <= 20",
)
def capped_collection(spark, sf):
    c = C.capped_collection(view(spark, sf, "samples"), "framework", "project", 3, 20, ["sample_id"])
    return c.select("framework", "project", "sample_id")


@query(
    "merged_corpora", "U1",
    "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark",
)
def merged_corpora(spark, sf):
    real = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return C.merged_corpora(real, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(
    "merged_by_name", "U1",
    "SELECT coalesce('f' || CAST(b.item_id AS STRING), 'f' || CAST(d.doc_id AS STRING)) AS name, coalesce(b.text, d.text) AS text FROM documents d FULL JOIN benchmark b ON b.item_id = d.doc_id",
)
def merged_by_name(spark, sf):
    real = table(spark, sf, "documents").select(F.expr("'f' || CAST(doc_id AS STRING)").alias("name"), "text")
    synthetic = table(spark, sf, "benchmark").select(F.expr("'f' || CAST(item_id AS STRING)").alias("name"), "text")
    return C.merged_by_name(real, synthetic)


@query(
    "training_samples", "U2",
    sql("vuln_records", "safe_files")
    + "SELECT label, sample_type, \"commit\", count(*) AS n, CAST(sum(length(code)) AS BIGINT) AS chars FROM (SELECT 1 AS label, 'vulnerable' AS sample_type, '-' AS \"commit\", code_before AS code FROM vuln_records "
    "UNION ALL SELECT 0, 'fixed', '-', code_after FROM vuln_records UNION ALL SELECT 0, 'originally_safe', coalesce(\"commit\", 'HEAD'), code FROM safe_files) WHERE code IS NOT NULL GROUP BY ALL",
)
def training_samples(spark, sf):
    s = C.training_samples(FI.version_rows(view(spark, sf, "vuln_records")), view(spark, sf, "safe_files"))
    commit = F.when(F.col("sample_type") == "originally_safe", F.col("commit")).otherwise("-")
    return s.groupBy("label", "sample_type", commit.alias("commit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars")
    )


_NORMAL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(
    "exact_duplicates", "D3",
    f"SELECT sha256({_NORMAL}) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
def exact_duplicates(spark, sf):
    return C.first_of_duplicates(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "without_duplicates", "D3",
    f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORMAL}",
)
def without_duplicates(spark, sf):
    return C.without_duplicates(table(spark, sf, "documents"), "text", "doc_id").select("doc_id")


@query(
    "large_enough_graphs", "D4",
    ORDER_GRAPH_SQL + "SELECT file, count(*) AS nodes FROM nodes GROUP BY file HAVING count(*) >= 8",
)
def large_enough_graphs(spark, sf):
    return C.large_enough(order_nodes(spark, sf), 8)


@query(
    "training_data_counts", "S13 U2 W5 W6",
    sql("vuln_records", "safe_files")
    + ", t AS (SELECT 2 * (SELECT count(*) FROM vuln_records) AS o, (SELECT count(*) FROM safe_files) AS s), n AS (SELECT o, greatest(1, floor(0.3 * o / (1 - 0.3))) AS safe FROM t), "
    "a AS (SELECT CAST(o + safe AS BIGINT) AS n, CAST(safe AS BIGINT) AS safe, CAST(o / 2 AS BIGINT) AS half FROM n) "
    "SELECT 'train' AS value, CAST(floor(n * 0.7) AS BIGINT) AS n FROM a UNION ALL SELECT 'val', CAST(floor(n * 0.15) AS BIGINT) FROM a UNION ALL "
    "SELECT 'test', n - CAST(floor(n * 0.7) AS BIGINT) - CAST(floor(n * 0.15) AS BIGINT) FROM a UNION ALL SELECT 'vulnerable', half FROM a UNION ALL SELECT 'fixed', half FROM a UNION ALL SELECT 'originally_safe', safe FROM a",
)
def training_data_counts(spark, sf):
    """Records and safe files to balanced samples, written split by split and read back."""
    path = scratch_path(spark, "training")
    PG.training_data(view(spark, sf, "vuln_records"), view(spark, sf, "safe_files"), path)
    rows = spark.read.parquet(path).select(F.explode(F.array("split", "sample_type")).alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# Word shingles of documents, and the smallest document of each set of them.
_SHINGLES = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
    n AS (SELECT doc_id, count(*) AS n, sum(hash(x)::HUGEINT) AS h FROM s GROUP BY doc_id),
    equal AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS equal_to FROM n),
    sets AS MATERIALIZED (SELECT doc_id, n, x FROM equal JOIN s USING (doc_id) WHERE doc_id = equal_to)
"""


@query(
    "near_copies", "D3",
    _SHINGLES
    + """
    SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity
    FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
    UNION ALL SELECT equal_to, doc_id, 1.0 FROM equal WHERE doc_id <> equal_to
    """,
)
def near_copies(spark, sf):
    """Near copies among all documents; tests compare it with all pairs of a small table."""
    return C.near_copies(table(spark, sf, "documents"), "text", "doc_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "near_copy_classes", "D3",
    _SHINGLES
    + """,
    alike AS (
        SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
    ways AS MATERIALIZED (SELECT u, v FROM alike UNION ALL SELECT v, u FROM alike),
    reach AS (SELECT doc_id AS u, doc_id AS top FROM equal WHERE doc_id = equal_to UNION SELECT ways.v, least(reach.top, ways.v) FROM reach JOIN ways ON ways.u = reach.u),
    tops AS (SELECT u, min(top) AS class_id FROM reach GROUP BY u)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, equal_to FROM equal JOIN tops ON tops.u = equal.equal_to
    """,
)
def near_copy_classes(spark, sf):
    """The class of near copies that each document belongs to."""
    return near_copies_of(table(spark, sf, "documents"), "text", "doc_id").withColumnRenamed("key", "doc_id")


_LENGTH = "CAST(length({0}) AS BIGINT)"


@query(
    "scanned_files", "S1",
    "SELECT CAST(doc_id AS VARCHAR) AS folder, 'ok' AS status, length(text) AS chars FROM documents",
)
def scanned_files(spark, sf):
    """Documents as text files, one folder each, and back through the tree scan."""
    path = scratch_path(spark, "tree")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("folder"), "text")
    FI.write_source_tree(docs, "folder", "text", path)
    found = FI.scan_source_files(spark, path, "*.txt")
    # the sink ends each text with a line feed
    return found.select(
        F.regexp_extract("file", "/folder=([0-9]+)/", 1).alias("folder"), "status", (F.length("code") - 1).cast("bigint").alias("chars")
    )


@query(
    "scanned_records", "S8",
    sql("vuln_records")
    + f"SELECT cve_id, cwe_id, commit_before, file_path, {_LENGTH.format('code_before')} AS before_chars, {_LENGTH.format('code_after')} AS after_chars, synthetic FROM vuln_records",
)
def scanned_records(spark, sf):
    path = scratch_path(spark, "records")
    RC.write_json(view(spark, sf, "vuln_records"), path)
    r = RC.read_vuln_records(spark, path)
    return r.select(
        "cve_id", "cwe_id", "commit_before", "file_path", F.length("code_before").cast("bigint").alias("before_chars"),
        F.length("code_after").cast("bigint").alias("after_chars"), "synthetic",
    )


@query(
    "scanned_safe_files", "S9",
    sql("safe_files") + f"SELECT repo_url, file_path, \"commit\", {_LENGTH.format('code')} AS chars FROM safe_files",
)
def scanned_safe_files(spark, sf):
    """Safe files written and read back; the folder that is not there adds nothing."""
    path = scratch_path(spark, "safe")
    RC.write_json(view(spark, sf, "safe_files"), path)
    every = RC.read_safe_files(spark, path).unionByName(RC.read_safe_files(spark, f"{path}-none"))
    return every.select("repo_url", "file_path", "commit", F.length("code").cast("bigint").alias("chars"))


@query(
    "scanned_labels", "S10",
    "SELECT doc_id % 3 AS spelling, quality AS label, count(*) AS n FROM labels GROUP BY 1, 2",
)
def scanned_labels(spark, sf):
    """Label lines under either spelling, among blank and corrupt lines."""
    path = scratch_path(spark, "labels")
    value = F.struct(F.col("doc_id").cast("double").alias("risk_score"), F.when(F.col("doc_id") % 3 == 0, F.col("quality")).alias("label"), F.when(F.col("doc_id") % 3 > 0, F.col("quality")).alias("target"))
    lines = table(spark, sf, "labels").select(F.explode(F.array(F.to_json(value), F.lit(""), F.lit("{broken"))).alias("value"))
    lines.write.text(path)
    back = GR.read_labels(spark, path)
    return back.groupBy((F.col("risk_score").cast("bigint") % 3).alias("spelling"), "label").agg(F.count(F.lit(1)).alias("n"))
