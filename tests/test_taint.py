"""Taint records, positions and recorded edges; event correlation in batch and stream."""

import json

from pyspark.sql import functions as F

from codeloom.operators import taint as TA
from codeloom.session import scratch_path
from codeloom.sources import taint_log as L
from codeloom.streaming import jobs as S


def records(spark, *objects):
    lines = [o if isinstance(o, str) else json.dumps(o) for o in objects]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "n int, value string")
    return {r.n: r for r in L.taint_records(df).collect()}


P = {"file": "a.py", "line": 3, "col": 1}


def test_layouts(spark):
    got = records(
        spark,
        {"source": P, "sink": {"file": "a.py", "line": "9"}, "path": [P, {"line": 4}], "meta": {"k": 1}},
        {"taint_source": {"filename": "b", "lineno": 1, "column": 2}, "taint_sink": {"path": "c", "line": 5.0},
         "trace": [P, {}, "x", {"file": "z", "line": "no"}], "taint_type": "http"},
        {"from": P, "to": P, "via": [P], "tool": "t", "n": 7},
        {"source": {"file": "a"}, "sink": P, "from": P, "to": P},
        {"source": P}, {"from": P, "to": 3}, "", "{bad", "[1]", "7", {"taint_source": P, "taint_sink": {}},
    )
    assert set(got) == {0, 1, 2, 3}
    assert got[0].sink.line == 9 and got[0].sink.col is None and got[0].path[1].file is None and got[0].meta == {"k": "1"}
    assert got[1].source.asDict() == {"file": "b", "line": 1, "col": 2} and got[1].sink.asDict() == {"file": "c", "line": 5, "col": None}
    assert len(got[1].path) == 1 and got[1].meta == {"taint_kind": "http"}
    assert got[2].meta == {"tool": "t", "n": "7"} and len(got[2].path) == 1
    assert "source" in got[3].meta and got[3].source.line == 3


def test_canonical_positions_are_not_respelled(spark):
    other = {"filename": "b.py", "lineno": 4}
    got = records(spark, {"source": other, "sink": P})
    assert got[0].source.file is None and got[0].sink.file == "a.py"


NODES = [
    (1, "Module", 1, 0, 9, 0), (2, "Function", 1, 0, 5, 9), (3, "Arg", 1, 6, 1, 7), (4, "Stmt", 3, 4, 3, 20),
    (5, "Call", 3, 4, 3, 20), (6, "Name", 3, 4, 3, 8), (7, "Name", 3, 9, 3, 12), (8, "Literal", 70, 0, 70, 3),
]


def nodes(spark):
    rows = [("a.py", i, k, (a, b, c, d)) for i, k, a, b, c, d in NODES]
    return spark.createDataFrame(rows, "file string, id long, kind string, span struct<sl:int,sc:int,el:int,ec:int>")


def best(line, col, role):
    from codeloom.operators.taint import KIND_CHOICES

    first, second = KIND_CHOICES[role]

    def rank(n):
        i, k, sl, sc, el, ec = n
        return (0 if k in first else 1 if k in second else 3 if k == "Stmt" else 2, el - sl, ec - sc, i)

    fits = [
        n for n in NODES
        if n[2] <= line <= n[4] and (col is None or not ((line == n[2] and col < n[3]) or (line == n[4] and col > n[5])))
    ]
    return min(fits, key=rank)[0] if fits else None


def test_best_node_for_every_position(spark):
    asked = [(f, line, col, role) for f in ("a.py",) for line in (1, 3, 4, 9, 10, 70) for col in (None, 0, 4, 6, 9, 20, 21) for role in ("source", "sink", "path")]
    pos = spark.createDataFrame(asked + asked, "file string, line int, col int, role string")
    for width in (1, 4, 64):
        got = {(r.line, r.col, r.role): r.id for r in TA.node_at_position(pos, nodes(spark), width).collect()}
        want = {(l, c, r): best(l, c, r) for _, l, c, r in asked}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_recorded_edges(spark):
    p = "struct<file:string,line:int,col:int>"
    rows = [
        (1, ("a.py", 1, 6), ("a.py", 3, 4), [("a.py", 3, 9), ("zz", 1, 1)], {"k": "first"}),
        (2, ("a.py", 1, 6), ("a.py", 3, 4), [("a.py", 3, 9)], {"k": "second"}),
        (3, ("a.py", 1, 6), ("a.py", 3, 4), [], {}),
        (4, ("a.py", 1, 6), ("a.py", 99, 4), [], {}),
    ]
    rec = spark.createDataFrame(rows, f"record int, source {p}, sink {p}, path array<{p}>, meta map<string,string>")
    mapped = TA.mapped_records(rec, nodes(spark))
    e = {(r.src, r.dst): r.attrs for r in TA.recorded_flow_edges(mapped).collect()}
    # no kind is a first choice for the argument's place, so the smallest node there is taken
    assert e == {(3, 7): {"k": "first"}, (7, 5): {"k": "first"}, (3, 5): None}
    known = spark.createDataFrame([("a.py", 3, 7, "DDFG"), ("a.py", 3, 5, "DFG")], "file string, src long, dst long, kind string")
    assert {(r.src, r.dst) for r in TA.recorded_flow_edges(mapped, known).collect()} == {(7, 5), (3, 5)}


def plain_calls(marks, args):
    out = {}
    for call in {a[2] for a in args}:
        for o, t, _, pos in sorted([a for a in args if a[2] == call], key=lambda a: a[3]):
            seen = [(mt, s) for mo, mt, s in marks if mo == o and mt <= t]
            if seen:
                out[call] = max(seen)[1]
                break
    return out


def events():
    import random

    r = random.Random(4)
    marks = [(0 if r.random() < 0.5 else r.randrange(5), t, f"s{t}") for t in range(0, 300, 3)]
    args = [(0 if r.random() < 0.5 else r.randrange(5), t, t // 7, t % 7) for t in range(1, 320)]
    return marks, args


def frames(spark, marks, args):
    m = spark.createDataFrame(marks, "o int, ts int, source string")
    a = spark.createDataFrame([(*x, "k", "sql") for x in args], "o int, ts int, call_id int, arg_pos int, sink string, sink_type string")
    return m, a


def test_tainted_calls(spark):
    marks, args = events()
    m, a = frames(spark, marks, args)
    for limits in (None, [], [30.0, 31.0, 100.0, 250.0]):
        got = {r.call_id: r.source for r in TA.tainted_calls(m, a, ["o"], "ts", limits).collect()}
        assert got == plain_calls(marks, args)


def test_stream_correlation_equals_batch(spark):
    marks, args = events()
    calls = [(o, t, t, 0) for o, t, _, _ in args]  # one argument per call, so a call is in one batch
    m, a = frames(spark, marks, calls)
    both = m.withColumn("kind", F.lit("mark")).unionByName(a.withColumn("kind", F.lit("argument")), allowMissingColumns=True)
    src = scratch_path(spark, "events")
    for lo, hi in ((0, 100), (100, 200), (200, 400)):
        both.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(src)
    for horizon in (0.0, 30.0, 1000.0):
        state, out = scratch_path(spark, "marks"), scratch_path(spark, "out")
        stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(src)
        S.run_batches(stream, "corr", S.live_correlation(spark, state, out, ["o"], horizon=horizon))
        got = spark.read.parquet(out)
        assert got.select("epoch").distinct().count() == 3
        assert {r.call_id: r.source for r in got.collect()} == plain_calls(marks, calls)
        kept = spark.read.parquet(f"{state}/epoch=2").count()
        assert kept == len(marks) if horizon == 1000.0 else kept < len(marks)


def test_conversion_job_counts(spark, tmp_path):
    src = tmp_path / "log.jsonl"
    src.write_text(json.dumps({"source": P, "sink": P}) + "\n\nnope\n" + json.dumps({"x": 1}) + "\n")
    assert L.convert_taint_log(spark, str(src), str(tmp_path / "out")) == {"converted": 1, "skipped": 2}
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream_state_ends(spark):
    """Jobs in a final status and messages out of retention leave the state; running jobs stay."""
    schema = "job_id string, message_id string, status string, ts timestamp, event_id long, findings_count int"
    path = scratch_path(spark, "ending")
    days = [
        [("a", "m", "running", 0, 1), ("a", "m", "done", 1, 2), ("b", "n", "running", 1, 3)],
        [("c", "o", "running", 40, 4)], [("c", "o", "running", 80, 5)], [("a", "m", "running", 120, 6), ("b", "n", "done", 120, 7)],
    ]
    for rows in days:
        data = [(j, m, s, i) for j, m, s, _, i in rows]
        part = spark.createDataFrame(data, "job_id string, message_id string, status string, event_id long")
        at = F.when(F.lit(False), F.lit(0))
        for _, _, _, day, i in rows:
            at = at.when(F.col("event_id") == i, F.lit(day))
        part = part.withColumn("ts", F.timestamp_seconds((at + 1000) * 86_400)).withColumn("findings_count", F.lit(1))
        part.select("job_id", "message_id", "status", "ts", "event_id", "findings_count").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: S.file_stream(spark, path, schema, files=1)
    out, counts, dead = (scratch_path(spark, n) for n in ("out", "counts", "dead"))
    S.run_batches(S.latest_states(stream()), "ends", S.keep_epochs(out), "update")
    got = {r.job_id: r for r in S.newest_rows(spark, out, ["job_id"]).collect()}
    day = lambda t: t.timestamp() / 86_400 - 1000
    # a was forgotten after it was done and starts anew, b was not
    assert day(got["a"].started_at) == 120 and got["a"].finished_at is None and day(got["b"].started_at) == 1
    S.run_batches(S.receive_counts(stream(), 1), "receives", S.route_dead(counts, dead), "update")
    got = {r.message_id: r.receives for r in S.newest_rows(spark, counts, ["message_id"]).collect()}
    # o came again before the watermark had passed its retention
    assert got == {"m": 1, "n": 1, "o": 2} and {r.message_id for r in spark.read.parquet(dead).collect()} == {"m", "o"}


def test_dyadic_covers(spark):
    """A cover holds each place of its run once and no other, in a few cells; the top level takes what is longer."""
    runs = [(a, b) for a in range(0, 70, 3) for b in range(a, 90, 7)] + [(0, 0), (5, 5), (0, 1023), (1, 1022)]
    df = spark.createDataFrame([(a, b, v) for a, b in runs for v in (4, 16)], "a long, b long, levels int")
    for levels in (4, 16):
        got = df.where(F.col("levels") == levels).select("a", "b", TA.dyadic_cover(F.col("a"), F.col("b"), levels).alias("c")).collect()
        for r in got:
            held = sorted(x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level))
            assert held == list(range(r.a, r.b + 1))
            assert len(r.c) <= 2 * levels + ((r.b - r.a) >> levels)
    module = spark.range(1).select(TA.dyadic_cover(F.lit(0).cast("bigint"), F.lit(1_000_000 // TA.LINES_PER_BLOCK).cast("bigint")).alias("c")).first()
    assert len(module.c) <= 40
    cells = spark.range(1).select(TA.dyadic_cells(F.lit(1000).cast("bigint")).alias("c")).first().c
    assert [(c.level, c.cell) for c in cells] == [(k, 1000 >> k) for k in range(TA.LEVELS + 1)]


def test_expiry_is_keyed_state_that_survives_a_restart(spark):
    """Keys end by themselves when the watermark passes their last expiry, also in a later run of the same stream."""
    src, out, state = (scratch_path(spark, n) for n in ("src", "expiring", "expiring-state"))

    def add(*rows):
        df = spark.createDataFrame([*rows], "id long, at long").select("id", F.timestamp_seconds("at").alias("ts"), F.timestamp_seconds(F.col("at") + 60).alias("until"))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = S.file_stream(spark, src, df.schema)
        S.run_batches(S.expiring_rows(stream, "id", "ts", "until", "10 seconds"), "expiring", S.keep_epochs(out), "update", rocksdb=True, state=state)
        return {r.key: (r.status, int(r.until.timestamp())) for r in S.newest_rows(spark, out, ["key"]).collect()}

    before = spark.conf.get(S.STATE_STORE, None)
    assert add((1, 1000), (2, 1030), (None, 1030)) == {1: ("live", 1060), 2: ("live", 1090)}
    # the second key is put off by a row of the new run, the first one has ended
    assert add((2, 1080), (3, 1081)) == {1: ("expired", 1060), 2: ("live", 1140), 3: ("live", 1141)}
    assert add((4, 2000)) == {1: ("expired", 1060), 2: ("expired", 1140), 3: ("expired", 1141), 4: ("live", 2060)}
    # a key that comes again lives again; a row that is late beyond the watermark takes no part
    assert add((1, 1999), (5, 1000))[1] == ("live", 2059)
    assert spark.conf.get(S.STATE_STORE, None) == before


def test_keys_share_states_in_groups(spark, monkeypatch):
    """Receives and expiries of many keys come from a few states, a call of which serves all its keys; a null message counts, a row without a time too."""
    monkeypatch.setattr(S, "STATE_GROUPS", 4)
    src, counts, dead, out = (scratch_path(spark, n) for n in ("many", "counts", "dead", "ends"))
    want, until = {}, {}
    for part in range(3):
        rows = [(None if k == 7 else k, None if k % 50 == 9 else 1000 + 100 * part + k) for k in range(60 * part, 200) for _ in range(1 + k % 3)]
        df = spark.createDataFrame(rows, "id long, at long").select("id", F.timestamp_seconds("at").alias("ts"), F.timestamp_seconds(F.col("at") + 150).alias("until"))
        df.coalesce(1).write.mode("append").parquet(src)
        for k, at in rows:
            want[k] = want.get(k, 0) + 1
            if k is not None and at is not None:
                until[k] = max(until.get(k, 0), at + 150)
    stream = lambda: S.file_stream(spark, src, df.schema, files=1)
    messages = stream().select(F.col("id").alias("message_id"), "ts")
    q = S.run_batches(S.receive_counts(messages, 4), "many", S.route_dead(counts, dead), "update")
    got = {r.message_id: r.receives for r in S.newest_rows(spark, counts, ["message_id"]).collect()}
    assert got == want and {r.message_id for r in spark.read.parquet(dead).collect()} == {k for k, n in want.items() if n > 4}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    q = S.run_batches(S.expiring_rows(stream(), "id", "ts", "until", "1 day"), "many-ends", S.keep_epochs(out), "update", rocksdb=True)
    got = {r.key: (r.status, int(r.until.timestamp())) for r in S.newest_rows(spark, out, ["key"]).collect()}
    assert got == {k: ("live", t) for k, t in until.items()}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
