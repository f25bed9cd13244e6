"""Structured Streaming over the event table, each run to its end and compared in batch: R1-R9."""

from pyspark.sql import functions as F

from codeloom.plans.registry import query
from codeloom.plans.views import VIEWS, sql, table
from codeloom.session import buckets, scratch_path
from codeloom.streaming import jobs as S


WEEKS = ((1, 7), (8, 14), (15, 21), (22, 31))


def _events(spark, sf):
    """The events as a file stream of four micro-batches: a copy split by time, each part some files; rows without a time come last."""
    rows, path = table(spark, sf, "events"), scratch_path(spark, "events")
    day = F.coalesce(F.dayofmonth("ts"), F.lit(WEEKS[-1][1]))
    # As many files for each part, or a micro-batch would reach into the next one.
    files = max(1, min(buckets(spark), rows.count() // 100))
    for first, last in WEEKS:
        rows.where(day.between(first, last)).repartition(files).write.mode("append").parquet(path)
    return S.file_stream(spark, path, rows.schema, files=files)


def _late(spark, sf):
    """Events with a zoned time, as watermarks ask for."""
    return _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_taint_ingest", "R1 T1",
    sql("taint_lines")
    + "SELECT count(*) AS records FROM taint_lines WHERE json_valid(value) AND (json_exists(CAST(value AS JSON), '$.sink') OR json_exists(CAST(value AS JSON), '$.taint_sink') OR json_exists(CAST(value AS JSON), '$.to'))",
)
def stream_taint_ingest(spark, sf):
    lines = _events(spark, sf).selectExpr(*VIEWS["taint_lines"][1])
    done = S.run_to_end(S.ingested_taint(lines), "taint")
    return done.agg(F.count(F.lit(1)).alias("records"))


def _requests(events):
    return events.select(
        F.col("event_id").cast("string").alias("job_id"), F.expr("CASE WHEN event_type <> 'error' THEN 't' || CAST(user_id % 10 AS STRING) END").alias("tenant_id"),
        F.expr("CASE WHEN value > 3 THEN 'p' || CAST(user_id AS STRING) ELSE '' END").alias("project_id"), F.lit("org/r").alias("repo"),
        F.col("value").cast("int").alias("findings_count"), "ts",
    )


@query(
    "stream_job_intake", "R2 X23",
    "SELECT outcome, count(*) AS n, strftime(max(CASE WHEN outcome = 'queued' THEN ts + INTERVAL 30 DAY END), '%Y-%m-%d %H:%M:%S') AS last_expiry FROM (SELECT *, CASE WHEN event_type <> 'error' AND value > 3 THEN 'queued' ELSE 'quarantined' END AS outcome FROM events) GROUP BY outcome",
)
def stream_job_intake(spark, sf):
    jobs, bad = scratch_path(spark, "jobs"), scratch_path(spark, "quarantine")
    S.run_batches(S.job_intake(_requests(_events(spark, sf))), "intake", S.route_intake(jobs, bad))
    both = spark.read.parquet(jobs).withColumn("outcome", F.lit("queued")).unionByName(
        spark.read.parquet(bad).withColumn("outcome", F.lit("quarantined"))
    )
    return both.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("expires_at"), "yyyy-MM-dd HH:mm:ss").alias("last_expiry")
    )


_JOB = "user_id % 40"
_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(
    "stream_job_states", "R3",
    f"WITH e AS (SELECT {_JOB} AS job_id, {_STATE} AS status, ts, event_id, CAST(floor(value) AS INTEGER) AS c FROM events) SELECT job_id, max_by(status, ts) AS status, strftime(min(CASE WHEN status = 'running' THEN ts END), '%Y-%m-%d %H:%M:%S') AS started_at, "
    "strftime(max(CASE WHEN status IN ('done', 'failed') THEN ts END), '%Y-%m-%d %H:%M:%S') AS finished_at, max(c) AS findings_count FROM e GROUP BY job_id",
)
def stream_job_states(spark, sf):
    e = _late(spark, sf).select(
        F.expr(_JOB).alias("job_id"), F.expr(_STATE).alias("status"), "ts", "event_id", F.floor("value").cast("int").alias("findings_count")
    )
    path = scratch_path(spark, "job-states")
    # the jobs of this table start again and again, so none is forgotten
    S.run_batches(S.latest_states(e, keep_days=60), "job-states", S.keep_epochs(path), "update")
    text = "yyyy-MM-dd HH:mm:ss"
    return S.newest_rows(spark, path, ["job_id"]).select(
        "job_id", "status", F.date_format("started_at", text).alias("started_at"), F.date_format("finished_at", text).alias("finished_at"), "findings_count"
    )


@query(
    "stream_dead_letters", "R4",
    "SELECT user_id * 5 + length(event_type) % 5 AS message_id, count(*) AS receives, count(*) > 3 AS dead FROM events GROUP BY 1",
)
def stream_dead_letters(spark, sf):
    m = _late(spark, sf).select(F.expr("user_id * 5 + length(event_type) % 5").alias("message_id"), "ts")
    path, dead = scratch_path(spark, "receives"), scratch_path(spark, "dead")
    S.run_batches(S.receive_counts(m, keep_days=60), "receives", S.route_dead(path, dead), "update")
    counts = S.newest_rows(spark, path, ["message_id"]).select("message_id", "receives")
    letters = spark.read.parquet(dead).select("message_id").distinct().withColumn("dead", F.lit(True))
    return counts.join(letters, "message_id", "left").fillna(False, ["dead"])


@query(
    "stream_audit_rows", "R5 X23",
    "SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) || '-' || substr(md5('actor' || CAST(user_id AS VARCHAR)), 1, 8) AS log_id, event_type AS action, strftime(ts + INTERVAL 365 DAY, '%Y-%m-%d') AS expires_on FROM events",
)
def stream_audit_rows(spark, sf):
    e = _late(spark, sf).select(
        "ts", F.expr("'actor' || CAST(user_id AS STRING)").alias("actor"), F.col("event_type").alias("action"),
        F.lit("t").alias("tenant_id"), F.lit("success").alias("result"),
    )
    done = S.run_to_end(S.audit_rows(e), "audit")
    return done.select("log_id", "action", F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"))


@query(
    "stream_live_rows", "R6",
    "SELECT count(*) AS live FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-10 00:00:00'",
)
def stream_live_rows(spark, sf):
    rows = S.job_intake(_requests(_events(spark, sf)).withColumn("tenant_id", F.lit("t")).withColumn("project_id", F.lit("p")))
    done = S.run_to_end(S.live_rows(rows, "expires_at", F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'")), "live")
    return done.agg(F.count(F.lit(1)).alias("live"))


@query(
    "stream_expired_keys", "R6",
    "WITH k AS (SELECT user_id * 5 + length(event_type) % 5 AS key, max(ts) + INTERVAL 36 HOUR AS until FROM events WHERE ts IS NOT NULL GROUP BY 1), "
    "w AS (SELECT max(ts) - INTERVAL 1 DAY AS watermark FROM events) "
    "SELECT key, CASE WHEN until <= watermark THEN 'expired' ELSE 'live' END AS status, strftime(until, '%Y-%m-%d %H:%M:%S') AS until FROM k, w",
)
def stream_expired_keys(spark, sf):
    """Keys live for 36 hours after their last event; the state forgets them by itself."""
    e = _late(spark, sf).select(F.expr("user_id * 5 + length(event_type) % 5").alias("key"), "ts", F.expr("ts + INTERVAL 36 HOURS").alias("until"))
    path = scratch_path(spark, "expiring")
    S.run_batches(S.expiring_rows(e, "key", "ts", "until"), "expiring", S.keep_epochs(path), "update", rocksdb=True)
    return S.newest_rows(spark, path, ["key"]).select("key", "status", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"))


@query(
    "stream_first_findings", "R7",
    "SELECT DISTINCT md5(CAST(user_id AS VARCHAR) || event_type) AS fingerprint FROM events",
)
def stream_first_findings(spark, sf):
    f = _late(spark, sf).select(F.md5(F.concat(F.col("user_id").cast("string"), "event_type")).alias("fingerprint"), F.col("ts").alias("created_at"))
    return S.run_to_end(S.first_findings(f, within="60 days"), "first").select("fingerprint")


_WHAT = "CASE WHEN event_type = 'signup' THEN 'scan' WHEN event_type = 'purchase' THEN 'fixed' ELSE 'finding' END"


@query(
    "stream_daily_trend", "R8 A22",
    f"SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) FILTER (WHERE w = 'scan') AS scans, count(*) FILTER (WHERE w = 'finding') AS findings, count(*) FILTER (WHERE w = 'fixed') AS fixed FROM (SELECT ts, {_WHAT} AS w FROM events) GROUP BY 1",
)
def stream_daily_trend(spark, sf):
    e = _late(spark, sf).select("ts", F.expr(_WHAT).alias("what"))
    path = scratch_path(spark, "trend")
    S.run_batches(S.live_trend(e), "trend", S.keep_epochs(path), "update")
    return S.newest_rows(spark, path, ["date"]).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "scans", "findings", "fixed")


@query(
    "stream_tainted_calls", "R9 T6",
    "WITH m AS (SELECT user_id % 97 AS object_id, ts, event_id AS source FROM events WHERE event_type = 'signup'), a AS (SELECT user_id % 97 AS object_id, ts, event_id AS call_id FROM events WHERE event_type IN ('click', 'purchase')), "
    "j AS (SELECT a.call_id, (SELECT max_by(m.source, m.ts) FROM m WHERE m.object_id = a.object_id AND m.ts <= a.ts) AS source FROM a) SELECT call_id, source FROM j WHERE source IS NOT NULL",
)
def stream_tainted_calls(spark, sf):
    e = _events(spark, sf).where("event_type IN ('signup', 'click', 'purchase')").select(
        (F.col("user_id") % 97).alias("object_id"), "ts", F.expr("CASE WHEN event_type = 'signup' THEN 'mark' ELSE 'argument' END").alias("kind"),
        F.col("event_id").alias("source"), F.col("event_id").alias("call_id"), F.lit(0).alias("arg_pos"), F.col("event_id").alias("sink"), F.col("event_type").alias("sink_type"),
    )
    state, out = scratch_path(spark, "marks"), scratch_path(spark, "calls")
    S.run_batches(e, "correlation", S.live_correlation(spark, state, out, ["object_id"]))
    return spark.read.parquet(out).select("call_id", "source")
