"""Structured Streaming forms of the queue, job and log work.

All streams keep what they must in checkpoints and written tables on shared storage, and every
sink can run a batch again without changing the result.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.ordered import seconds
from codeloom.operators.taint import tainted_calls
from codeloom.operators.tenancy import audit_id, expiry
from codeloom.session import delete, scratch_path
from codeloom.sources.taint_log import taint_records

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_DAYS, AUDIT_DAYS = 30, 365
MAX_RECEIVES = 3
# Groups of keys that share a state.
STATE_GROUPS = 4096
FINAL = ("completed", "failed", "done")


def file_stream(
    spark: SparkSession, path: str, schema, glob: str | None = None, fmt: str = "parquet", files: int | None = None
) -> DataFrame:
    """A folder as a stream; ``files`` limits how many files make a micro-batch."""
    r = spark.readStream.schema(schema).format(fmt)
    r = r if files is None else r.option("maxFilesPerTrigger", files)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs everything that is there into a written table and returns that table."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None], mode: str = "append", rocksdb: bool = False,
    state: str | None = None,
) -> StreamingQuery:
    """Runs everything that is there; ``state`` names the checkpoint of a stream that goes on, ``rocksdb`` asks for that state store."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if rocksdb:
        conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (
            stream.writeStream.foreachBatch(handle).outputMode(mode)
            .option("checkpointLocation", state or scratch_path(stream.sparkSession, f"{label}-state"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        if rocksdb:
            conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)
    return q


def ingested_taint(lines: DataFrame) -> DataFrame:
    """Continuous normalisation of a taint log stream."""
    return taint_records(lines)


def job_intake(requests: DataFrame) -> DataFrame:
    """Requests as queued job rows, with ``accepted`` false where a required field is missing."""
    ok = (
        (F.coalesce("tenant_id", F.lit("")) != "") & (F.coalesce("project_id", F.lit("")) != "")
        & (F.coalesce("repo", F.lit("")) != "")
    )
    return requests.select(
        "job_id", "tenant_id", "project_id", "repo", "findings_count", F.col("ts").alias("created_at"),
        F.when(ok, "queued").alias("status"), F.when(ok, expiry(F.col("ts"), JOB_DAYS)).alias("expires_at"),
        ok.alias("accepted"),
    )


def route_intake(jobs_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes accepted rows and rejected rows apart, one folder per batch."""
    def handle(batch: DataFrame, epoch: int) -> None:
        for path, test in ((jobs_path, F.col("accepted")), (quarantine_path, ~F.col("accepted"))):
            batch.where(test).drop("accepted").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def _timeout(state, last_micros: int, keep_ms: int) -> None:
    state.setTimeoutTimestamp(max(last_micros // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))


def latest_states(events: DataFrame, late: str = "1 day", keep_days: float = 1.0) -> DataFrame:
    """Per job the last status, its first start, its end and the largest count, with state that ends.

    State is keyed by job.  A job in a final status is forgotten once the watermark has passed its last event by
    ``keep_days``; jobs that still run are kept.  Output in update mode; a sink keeps the last row per job.
    """
    keep_ms = int(keep_days * 86_400_000)

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        status, last, event, started, finished, most = state.get if state.exists else (None,) * 6
        for f in frames:
            top = f.sort_values(["us", "event_id"]).iloc[-1]
            if last is None or (top.us, top.event_id) > (last, event):
                status, last, event = top.status, int(top.us), int(top.event_id)
            runs, ends = f.us[f.status == "running"], f.us[f.status.isin(FINAL)]
            started = min([x for x in (started, *([int(runs.min())] if len(runs) else [])) if x is not None], default=None)
            finished = max([x for x in (finished, *([int(ends.max())] if len(ends) else [])) if x is not None], default=None)
            counts = f.findings_count.dropna()
            most = max([x for x in (most, *([int(counts.max())] if len(counts) else [])) if x is not None], default=None)
        state.update((status, last, event, started, finished, most))
        if status in FINAL:
            _timeout(state, last, keep_ms)
        yield pd.DataFrame(
            {"job_id": [key[0]], "status": [status], "s": pd.array([started], "Int64"), "e": pd.array([finished], "Int64"),
             "findings_count": pd.array([most], "Int64"), "u": pd.array([last], "Int64")}
        )

    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(
        "job_id", "status", F.unix_micros("ts").alias("us"), F.col("event_id").cast("bigint").alias("event_id"), F.col("findings_count").cast("bigint").alias("findings_count"), "ts"
    )
    out = rows.groupBy("job_id").applyInPandasWithState(
        fold, f"job_id {kind}, status string, s bigint, e bigint, findings_count bigint, u bigint",
        "status string, last bigint, event bigint, started bigint, finished bigint, most bigint", "update", "EventTimeTimeout",
    )
    at = F.timestamp_micros
    return out.select(
        "job_id", "status", at("s").alias("started_at"), at("e").alias("finished_at"), F.col("findings_count").cast("int").alias("findings_count"), at("u").alias("updated_at")
    )


def keep_epochs(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes each batch's changed rows to a folder of its own.

    Repeating an epoch overwrites the same folder; readers merge the folders by key.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return handle


def newest_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Per key the row of the newest epoch; combined before the shuffle."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*key, "epoch")]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
    return best.select(*key, "_r.*")


def _grouped(key: Column) -> list[Column]:
    """The key as text and its group: keys share states, as a call for each key costs far more than its few rows."""
    text = key.cast("string")
    return [text.alias("key"), F.pmod(F.xxhash64(text), F.lit(STATE_GROUPS)).alias("group")]


def _group_state(rows: DataFrame, fold, output: str, fields: str, ends: Callable[[int], int]) -> DataFrame:
    """key and ``output``, from a state that holds ``fields`` for each key of a group.

    ``fold`` takes the dict of a group's keys, which it changes, its frames and the watermark, and gives the rows to report.  A group
    wakes when the watermark has passed ``ends`` of the last field of one of its keys.
    """
    names = [x.split()[0] for x in fields.split(", ")]
    columns = ["key", *(x.split()[0] for x in output.split(", "))]

    def run(_, frames, state):
        stored = state.get if state.exists else [[] for _ in range(len(names) + 1)]
        held, now = dict(zip(stored[0], zip(*stored[1:], strict=True), strict=True)), state.getCurrentWatermarkMs()
        said = list(fold(held, () if state.hasTimedOut else frames, now))
        if held:
            state.update((list(held), *(list(x) for x in zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(max(min(ends(x[-1]) for x in held.values()), now, 1))
        elif state.exists:
            state.remove()
        if said:
            yield pd.DataFrame(dict(zip(columns, zip(*said, strict=True), strict=True)))

    kept = ", ".join(["keys array<string>", *(f"{x.split()[0]} array<{x.split()[1]}>" for x in fields.split(", "))])
    return rows.groupBy("group").applyInPandasWithState(run, f"key string, {output}", kept, "update", "EventTimeTimeout")


def receive_counts(
    messages: DataFrame, max_receives: int = MAX_RECEIVES, late: str = "1 day", keep_days: float = 14.0
) -> DataFrame:
    """message_id, receives, dead: a message is dead once it was received more often than allowed.

    Counts are state that is forgotten when a message was not received for ``keep_days`` (its retention).
    """
    keep_ms = int(keep_days * 86_400_000)

    def fold(held, frames, now):
        fresh = {}
        for f in frames:
            for m, us in zip(f.key, f.us.fillna(0), strict=True):
                n, last = fresh.get(m, (0, 0))
                fresh[m] = (n + 1, max(last, int(us)))
        for m, (n, last) in fresh.items():
            before, end = held.get(m, (0, 0))
            held[m] = (before + n, max(end, last // 1000 + keep_ms, now + 1))
            yield m, held[m][0], before + n > max_receives
        for m in [m for m, (_, end) in held.items() if end < now and m not in fresh]:
            del held[m]

    rows = messages.withWatermark("ts", late).select(*_grouped(F.col("message_id")), F.unix_micros("ts").alias("us"), "ts")
    kind = messages.schema["message_id"].dataType.simpleString()
    out = _group_state(rows, fold, "receives bigint, dead boolean", "n bigint, ends bigint", lambda ends: ends)
    return out.select(F.col("key").cast(kind).alias("message_id"), "receives", "dead")


def route_dead(counts_path: str, dead_path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that keeps the counts and puts dead messages into a sink of their own, one folder per batch."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{counts_path}/epoch={epoch}")
        # read back, as a second action would run the state a second time
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{counts_path}/epoch={epoch}")
        written.where("dead").write.mode("overwrite").parquet(f"{dead_path}/epoch={epoch}")

    return handle


def audit_rows(events: DataFrame) -> DataFrame:
    return events.select(
        audit_id(F.col("ts"), F.col("actor")).alias("log_id"), "tenant_id", "actor", "action", "result",
        F.col("ts").alias("timestamp"), expiry(F.col("ts"), AUDIT_DAYS).alias("expires_at"),
    )


def live_rows(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows that have not expired; the same filter serves a batch table and a stream."""
    return rows.where(F.col(expires) > now)


def expiring_rows(rows: DataFrame, key: str, time: str, expires: str, late: str = "1 day") -> DataFrame:
    """key, status (live or expired), until: changes of a keyed state in which each key lives until its latest expiry.

    A row that comes puts its key's end off; when the watermark, ``late`` behind the newest ``time``, reaches the end, the
    key is dropped from the state and reported as expired, whether or not anything reads it.  A key that comes again lives again.
    Rows without a key or an expiry are left out.
    """
    def fold(held, frames, now):
        fresh = {}
        for f in frames:
            for k, until in zip(f.key, f.until, strict=True):
                fresh[k] = max(fresh.get(k, until), until)
        for k, until in fresh.items():
            old = held.get(k)
            # what has ended before it came never lived
            if until > now and (old is None or until > old[0]):
                held[k] = (int(until),)
                yield k, "live", int(until)
        for k in [k for k, (until,) in held.items() if until <= now]:
            yield k, "expired", held.pop(k)[0]

    kind = rows.schema[key].dataType.simpleString()
    ends = rows.where(F.col(key).isNotNull() & F.col(expires).isNotNull()).withWatermark(time, late)
    ends = ends.select(*_grouped(F.col(key)), time, F.unix_millis(F.col(expires).cast("timestamp")).alias("until"))
    out = _group_state(ends, fold, "status string, until bigint", "until bigint", lambda until: until - 1)
    return out.select(F.col("key").cast(kind).alias("key"), "status", F.timestamp_millis("until").alias("until"))


def first_findings(findings: DataFrame, time: str = "created_at", within: str = "30 days") -> DataFrame:
    """Findings without repeats of a fingerprint inside the watermark."""
    return findings.withWatermark(time, within).dropDuplicatesWithinWatermark(["fingerprint"])


def live_trend(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Daily windows of (what): scans, findings, fixed.  Rows of one day are combined before the shuffle."""
    w = events.withWatermark(time, late).groupBy(F.window(time, "1 day"))
    return w.agg(
        F.count_if(F.col("what") == "scan").alias("scans"), F.count_if(F.col("what") == "finding").alias("findings"),
        F.count_if(F.col("what") == "fixed").alias("fixed"),
    ).select(F.to_date("window.start").alias("date"), "scans", "findings", "fixed")


def live_correlation(
    spark: SparkSession, state_path: str, out_path: str, objects: list[str], time: str = "ts", horizon: float = 3600.0,
    forget: float | None = None,
) -> Callable[[DataFrame, int], None]:
    """A batch handler for runtime events (kind 'mark' or 'argument').

    Each batch is joined as-of with the known marks by the same operator as in batch.  The state holds the marks
    of the last ``horizon`` seconds and of the older ones the last per object, which is all that arguments late by less
    than the horizon can see; objects not marked for ``forget`` seconds are dropped.  The state of an epoch is written
    from the one before it, so repeating an epoch repeats its result; older states are deleted.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        known = batch.where(F.col("kind") == "mark").select(*objects, time, "source")
        if epoch > 0:
            known = spark.read.parquet(f"{state_path}/epoch={epoch - 1}").unionByName(known)
        args = batch.where(F.col("kind") == "argument").select(
            *objects, time, "call_id", "arg_pos", "sink", "sink_type"
        )
        tainted_calls(known, args, objects, time).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        t = known.withColumn("_t", seconds(known, time))
        edge = t.agg((F.max("_t") - horizon).alias("_edge"), (F.max("_t") - (forget or 0)).alias("_gone"))
        t = t.crossJoin(F.broadcast(edge))  # one row
        if forget is not None:
            t = t.where("_t >= _gone")
        old = t.where("_t < _edge").groupBy(*objects).agg(F.max_by(F.struct(time, "source"), time).alias("m"))
        kept = t.where("_t >= _edge").select(*objects, time, "source").unionByName(old.select(*objects, "m.*"))
        kept.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        if epoch > 1:
            delete(spark, f"{state_path}/epoch={epoch - 2}")

    return handle
