"""Corpus building, statistics, findings, tenancy and files."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import corpus as C
from codeloom.operators import findings as FN
from codeloom.operators import quality as Q
from codeloom.operators import tenancy as TN
from codeloom.plans import graphs as PG
from codeloom.sources import files as FI
from codeloom.sources import graphs as GR
from codeloom.sources import records as RC
from codeloom.session import cut_lineage


@pytest.fixture(scope="module")
def samples(spark):
    kinds = ["vulnerable"] * 10 + ["fixed"] * 10 + ["originally_safe"] * 2
    rows = [(f"s{i}", f"p{i % 5}", int(k == "vulnerable"), k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "sample_id string, project string, label int, sample_type string")


def test_balance_repeats_up_and_draws_down(samples):
    up = C.balanced(samples, 0.3).groupBy("sample_type").count().collect()
    assert {r.sample_type: r["count"] for r in up} == {"vulnerable": 10, "fixed": 10, "originally_safe": 8}
    down = C.balanced(samples, 0.04).where("sample_type = 'originally_safe'").count()
    assert down == 1
    only = samples.where("sample_type = 'originally_safe'")
    assert C.balanced(only, 0.3).count() == 2 and C.balanced(samples.where("label = 1"), 0.3).count() == 10


def test_splits_cover_every_row_once(spark, samples):
    for split in (C.split_by_position(samples), C.split_by_project(samples)):
        assert split.count() == 22 and split.select("sample_id").distinct().count() == 22
    n = {r.split: r["count"] for r in C.split_by_position(samples).groupBy("split").count().collect()}
    assert n == {"train": 15, "val": 3, "test": 4}
    per = C.split_by_project(samples).groupBy("project").agg(F.count_distinct("split").alias("n"))
    assert per.where("n > 1").count() == 0


def test_shuffle_is_the_same_for_every_bucket_width(samples):
    a = {r.sample_id: r.rn for r in C.shuffled(samples, "sample_id", digits=1).collect()}
    b = {r.sample_id: r.rn for r in C.shuffled(samples.repartition(7), "sample_id", digits=4).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 23))


def test_time_split_is_ordered(spark):
    rows = spark.range(100).select(F.col("id").alias("sample_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for limits in ([], [600.0, 4000.0]):
        s = C.split_by_time(rows, limits=limits)
        edge = {r.split: (r.a, r.b) for r in s.groupBy("split").agg(F.min("sample_id").alias("a"), F.max("sample_id").alias("b")).collect()}
        assert edge["train"][1] < edge["val"][0] and edge["val"][1] < edge["test"][0]


def test_merge_by_name_prefers_synthetic(spark):
    real = spark.createDataFrame([("a", "r"), ("b", "r")], "name string, code string")
    syn = spark.createDataFrame([("b", "s", 1), ("c", "s", 2)], "name string, code string, extra int")
    assert {r.name: (r.code, r.extra) for r in C.merged_by_name(real, syn).collect()} == {"a": ("r", None), "b": ("s", 1), "c": ("s", 2)}


def test_quality_score_bands(spark):
    rows = [(5, 1, 2, 0), (50, 10, 0, 7), (50, 2, 6, 3), (9, 3, 0, 1)]
    df = spark.createDataFrame(rows, "total_records int, unique_cves int, records_without_code int, valid_graphs int")
    got = [(r.quality_score, r.band, len(r.quality_issues)) for r in Q.quality_score(df).collect()]
    assert got == [(10, "needs improvement", 4), (100, "good", 0), (65, "acceptable", 2), (70, "acceptable", 1)]
    assert Q.quality_score(df).first().quality_issues[2] == "Many records without code (2/5)"


def test_one_class_is_infinitely_imbalanced(spark):
    r = Q.label_balance(spark.createDataFrame([(1,), (1,), (None,)], "label int")).first()
    assert r.total == 2 and r.imbalance_ratio == float("inf") and not r.is_balanced


def test_rows_without_a_group_are_a_group(spark):
    rows = spark.createDataFrame([(i, None if i < 6 else "a") for i in range(10)], "sample_id int, g string")
    got = {r.g: r["count"] for r in C.balanced_per_group(rows, "g", 5).groupBy("g").count().collect()}
    assert got == {None: 5, "a": 5}
    s = C.split_by_project(rows, "g")
    assert s.count() == 10 and s.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_paging_true_total_and_deep_pages(spark):
    rows = cut_lineage(spark.range(257).select("id", F.timestamp_seconds(F.col("id") % 50).alias("created_at")))
    want = [r.id for r in rows.orderBy(F.desc("created_at"), "id").collect()]
    p = TN.page_of(rows, 4, 30, "created_at", "id").collect()
    assert sorted(r.id for r in p) == sorted(want[90:120])
    assert {(r.page, r.page_size, r.total, r.total_pages) for r in p} == {(4, 30, 257, 9)}
    assert TN.page_bounds(0, 0) == (1, 20) and TN.page_bounds(-3, 1000) == (1, 100) and TN.page_bounds(None, None) == (1, 20)


def test_subjects_against_patterns(spark):
    rows = [
        ("repo:o/r:ref:main", ["repo:o/r:*"], True), ("repo:o/x:ref:main", ["repo:o/r:*"], False), ("any", [], True), ("any", None, True),
        ("repo:o/r:ref", ["no", "*:ref"], True), ("abcdef", ["abc"], True), ("xabc", ["abc"], False),
    ]
    df = spark.createDataFrame([(s, p) for s, p, _ in rows], "s string, p array<string>")
    assert [r[0] for r in df.select(TN.subject_allowed(F.col("s"), F.col("p"))).collect()] == [w for *_, w in rows]


def test_issue_match_by_fingerprint(spark):
    reports = spark.createDataFrame([("aa", "m1"), ("bb", "m2"), (None, "m3"), ("", "m4")], "fingerprint string, markdown string")
    issues = spark.createDataFrame([(7, "x\n<!-- fp:aa -->"), (5, "y fp:aa"), (9, None), (8, "fp:aab")], "issue_id int, body string")
    got = {r.fingerprint: (r.action, r.issue_id) for r in FN.issue_actions(reports, issues, F.lit("0123456789")).collect()}
    assert got == {"aa": ("update", 5), "bb": ("create", None)}


def test_gate_counts_missing_confidence_as_sure(spark):
    df = spark.createDataFrame([(True, None), (True, 0.5), (False, 0.9), (None, 0.9)], "is_vulnerable boolean, confidence double")
    assert [r.skip_reason for r in FN.report_gate(df).collect()] == [None, "low confidence", "not vulnerable", "not vulnerable"]


def test_graph_files_round_trip(spark, tmp_path):
    lines = [
        {"file": "a", "nodes": [{"id": 1, "kind": "Function"}, {"id": 2, "kind": "Name", "span": [1, 0, 1, 4], "attrs": {"is_source": "true"}}],
         "edges": [{"src": 1, "dst": 2, "kind": "AST"}, {"source": 2, "target": 1}], "metadata": {"frameworks": ["flask"]}},
        {"file": "b", "nodes": [], "edges": []},
    ]
    f = tmp_path / "g.jsonl"
    f.write_text("\n".join([json.dumps(lines[0]), "", "{broken", json.dumps(lines[1])]) + "\n")
    g = GR.read_graphs(spark, str(f))
    assert g.count() == 2 and GR.read_graphs(spark, str(f), 0, True).count() == 1
    n, e = GR.nodes_of(g), GR.edges_of(g)
    assert n.count() == 2 and {(r.src, r.dst, r.kind) for r in e.collect()} == {(1, 2, "AST"), (2, 1, "AST")}
    assert n.where("span IS NULL").count() == 1
    for most in (1, 100):
        out = str(tmp_path / f"out{most}")
        GR.write_graphs(GR.graph_documents(n, e, max_items=most), out)
        back = GR.read_graphs(spark, out)
        assert GR.nodes_of(back).count() == 2 and GR.edges_of(back).count() == 2
        assert {r.attrs.get("is_source") for r in GR.nodes_of(back).collect()} == {None, "true"}


def test_labels_take_label_or_target(spark, tmp_path):
    f = tmp_path / "l.jsonl"
    f.write_text('{"label": 1}\n{"target": 0}\n\n{"metadata": {"sample_type": "x"}}\nno\n')
    assert [r.label for r in GR.read_labels(spark, str(f)).collect()] == [1, 0, None]


def test_results_from_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"file_path": "x", "is_vulnerable": true, "confidence": 0.5}, {"file_path": "y"}]')
    (tmp_path / "b.json").write_text('{"file_path": "z", "is_vulnerable": false}')
    assert {r.file_path for r in RC.read_results(spark, str(tmp_path)).collect()} == {"x", "y", "z"}


def test_missing_safe_files_read_as_empty(spark, tmp_path):
    assert RC.read_safe_files(spark, str(tmp_path / "none")).count() == 0


def test_reports_are_written_by_job(spark, tmp_path):
    r = spark.createDataFrame([("j1", "f1", "# A\ntext"), ("j1", "f2", "# B")], "job_id string, fingerprint string, markdown string")
    RC.write_reports(r, str(tmp_path / "r"))
    assert (tmp_path / "r" / "job_id=j1").is_dir()
    back = spark.read.json(str(tmp_path / "r")).where("fingerprint = 'f1'").first()
    assert back.markdown == "# A\ntext" and back.path == "reports/j1/f1.md"


def test_source_tree_to_graph_tables(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg" / "__pycache__").mkdir(parents=True)
    (src / "a.py").write_text("import os\r\nos.system('x')\r\n")
    (src / "pkg" / "b.py").write_text("def f(:\n")
    (src / "pkg" / "__pycache__" / "c.py").write_text("x = 1\n")
    (src / "pkg" / "d.py").write_bytes(b"x = '\xff\xfe'\n")
    (src / "pkg" / "e.txt").write_text("x = 1\n")
    status = PG.build_from_path(spark, str(src), str(tmp_path / "out"))
    assert {r.status: r.files for r in status.collect()} == {"ok": 1, "unparsable": 1, "undecodable": 1}
    n = spark.read.parquet(str(tmp_path / "out" / "nodes"))
    assert n.where(F.col("attrs")["sink_id"] == "SINK_OS_SYSTEM").count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).where("kind = 'AST'").count() == n.count() - 1


def test_incremental_refresh(spark):
    def sha(df):
        return df.withColumn("content_sha", F.sha2(F.encode("code", "UTF-8"), 256))

    now = spark.createDataFrame([("a", "1"), ("b", "2b"), ("c", "3")], "file string, code string")
    stored = sha(spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "file string, code string")).drop("code")
    changed = FI.changed_files(now, stored)
    assert {r.file for r in changed.collect()} == {"b", "c"}
    rebuilt = sha(now.join(changed.select("file"), "file", "left_semi")).drop("code")
    assert {r.file for r in FI.refresh_graphs(stored, rebuilt, now).collect()} == {"a", "b", "c"}


def test_training_data_job(spark, tmp_path):
    rec = spark.createDataFrame(
        [(f"CVE-2023-{i}", "CWE-79", "u/r", f"b{i}", f"a{i}", f"m{i}.py", "XSS", "d", "x = 1", "x = 2") for i in range(20)],
        "cve_id string, cwe_id string, repo_url string, commit_before string, commit_after string, file_path string, "
        "vulnerability_type string, description string, code_before string, code_after string",
    )
    safe = spark.createDataFrame([("u/s", f"s{i}.py", None, "y = 1") for i in range(5)], "repo_url string, file_path string, commit string, code string")
    out = PG.training_data(rec, safe, str(tmp_path / "t"))
    n = {r.sample_type: r["count"] for r in out.groupBy("sample_type").count().collect()}
    assert n == {"vulnerable": 20, "fixed": 20, "originally_safe": 17}
    assert out.select("sample_id").distinct().count() == 57
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 39, "val": 8, "test": 10}


def test_scan_to_findings(spark):
    code = "import os\ndef f(x):\n    y = os.getenv('A')\n    os.system(y)\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", "x = 1\n")], "file string, code string")
    nodes, _, _ = PG.build_graphs(files)
    f = PG.scan_findings(cut_lineage(nodes), [0.1] * 128, 0.0, 5).collect()
    assert {r.file for r in f} == {"a.py", "b.py"} and all(r.is_vulnerable for r in f)
    a = next(r for r in f if r.file == "a.py")
    assert a.pattern_id == "CMDI_OS_SYSTEM_TAINTED" and a.owasp == "A03: Injection" and a.cwe_id == "CWE-78"


def test_payload_holds_no_secret(spark):
    files = spark.createDataFrame([("f.py", "a\npassword = 'hunter2222'\nb")], "file string, code string")
    rows = [(1, "t", "p", "o/r", "j", "fp", "HIGH", "R", "CWE-1", "f.py", 2, 0.5)]
    found = spark.createDataFrame(
        rows, "finding_id long, tenant_id string, project_id string, repo string, job_id string, fingerprint string, severity string, "
        "rule_id string, cwe string, file string, line int, confidence double"
    )
    doc = json.loads(FN.payload_documents(FN.payload_findings(found, files)).first().payload)
    assert "hunter" not in json.dumps(doc) and doc["limits"] == {"max_issues": 5}
    assert doc["findings"][0]["code_snippet_masked"] == "a\n<REDACTED_PASSWORD>\nb"
    nodes = spark.createDataFrame([("g", 1, "x", "token=" + "a" * 30), ("g", 2, "y", "c"), ("g", 9, "z", "d")], "file string, id long, symbol string, code string")
    edges = spark.createDataFrame([("g", 1, 2)], "file string, src long, dst long")
    seeds = spark.createDataFrame([("g", 1)], "file string, id long")
    n, e = FN.payload_subgraph(nodes, edges, seeds, "salt")
    assert {r.id for r in n.collect()} == {1, 2} and e.count() == 1
    assert all(r.symbol.startswith("VAR_") for r in n.collect()) and n.where("code LIKE '%aaa%'").count() == 0


def test_record_scans_skip_bad_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(
        '{"cve_id": "CVE-2023-1111", "commit_before": "b", "commit_after": "a", "file_path": "x/m.py", "code_before": "1"}\n'
        '{bad\n\n{"cve_id": null, "synthetic": true, "timestamp": "2024-01-02T03:04:05"}\n'
    )
    rows = RC.read_vuln_records(spark, str(tmp_path / "m.jsonl")).collect()
    assert [(r.cve_id, r.synthetic) for r in rows] == [("CVE-2023-1111", None), (None, True)]
    (tmp_path / "s.jsonl").write_text('{"repo_url": "u", "label": 0, "code": "x = 1"}\n')
    assert [r.code for r in RC.read_safe_files(spark, str(tmp_path / "s.jsonl")).collect()] == ["x = 1"]


def test_path_label_agreement(spark):
    from codeloom.operators.traverse import path_label_agreement

    paths = spark.createDataFrame([("a", 1), ("a", 2)], "file string, id long")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "file string, label int")
    got = {(r.label, r.has_path): r.files for r in path_label_agreement(paths, labels).collect()}
    assert got == {(1, 1): 1, (1, 0): 1, (0, 0): 1}


def test_near_copies_equal_all_pairs(spark):
    import random

    r = random.Random(2)
    texts = {}
    for g in range(12):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice([60, 120, 200]))]
        texts[g * 10] = " ".join(base)
        for c in range(1, 4):
            v = base[:]
            for _ in range(c):
                v[r.randrange(len(v))] = "changed"
            texts[g * 10 + c] = " ".join(v)
    texts |= {900: None, 901: "", 902: "a b", 903: texts[0].upper()}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = {(x.a, x.b): x.similarity for x in C.near_copies(df, "t", "k").collect()}
    sets = {k: set(C.shingles(t, 5).tolist()) for k, t in texts.items()}
    close = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert got and all(abs(close(a, b) - s) < 1e-9 and s >= 0.8 for (a, b), s in got.items())
    # copies with equal shingles are one text, and every group is connected
    groups = {k: k for k in texts}
    for a, b in sorted(got):
        groups = {k: groups[a] if v == groups[b] else v for k, v in groups.items()}
    for a in texts:
        for b in texts:
            if a < b and close(a, b) >= 0.8 and not {a, b} & {900, 901, 903}:
                assert groups[a] == groups[b]


def test_near_copies_between_the_middle_and_exact_copies(spark):
    import random

    r = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = {500: " ".join(base), 501: " ".join(base).upper(), 502: None, 503: ""}
    for c in range(120):
        v = base[:]
        at = r.randrange(0, 186)
        v[at : at + 14] = [f"x{c}y{i}" for i in range(14)]
        texts[c] = " ".join(v)
    texts[504] = texts[7]
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    got = [((x.a, x.b), x.similarity) for x in C.near_copies(df, "t", "k").collect()]
    sets = {k: set(C.shingles(t, 5).tolist()) for k, t in texts.items()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in texts for b in texts if a < b}
    copies = {501, 503, 504}
    want = {p: s for p, s in share.items() if s >= 0.8 and not copies & set(p)} | {(500, 501): 1.0, (502, 503): 1.0, (7, 504): 1.0}
    assert len(got) == len(dict(got)) and dict(got) == want and sum(500 in p for p in want) > 100


def test_near_copy_classes_equal_all_pairs(spark, monkeypatch):
    """Chains, stars, short, empty and null texts, copies, repeated and null keys; few counters and small cells change nothing."""
    import random

    from codeloom.operators import near_copies as NC

    r = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([7, 20, 60, 150]))]
        for c in range(r.randrange(1, 7)):
            rows.append((g * 10 + c, " ".join(base)))
            at = r.randrange(len(base))
            base = base[:at] + [f"new{g}x{c}"] * r.randrange(2) + base[at + 1 :]
    star = [f"b{i}" for i in range(200)]
    for c in range(80):
        at = r.randrange(0, 186)
        rows.append((1000 + c, " ".join(star[:at] + [f"x{c}y{i}" for i in range(14)] + star[at + 14 :])))
    rows += [(2000, " ".join(star)), (2001, " ".join(star).upper()), (2002, None), (2003, " \n"), (2004, "a b"), (2005, "A  b"), (None, "a b"), (2004, rows[0][1])]
    sets = [(k, frozenset(NC.shingle_digests(t, 5).tolist())) for k, t in rows if k is not None]
    different = sorted({s for _, s in sets}, key=sorted)
    top = {s: s for s in different}

    def find(s):
        return s if top[s] == s else find(top[s])

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if len(a & b) >= 0.8 * len(a | b) - 1e-12:
                top[find(a)] = find(b)
    classes = {}
    for k, s in sets:
        classes.setdefault(find(s), []).append(k)
    want = sorted((k, min(classes[find(s)]), len(classes[find(s)]), min(x for x, y in sets if y == s)) for k, s in sets)
    df = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "id long, t string, class_id string, n int")
    got = sorted(tuple(x) for x in NC.near_copy_classes(df, "t", "id").collect())
    assert got == want and any(n > 60 for _, _, n, _ in got)
    monkeypatch.setattr(NC, "CELLS", 64)
    monkeypatch.setattr(NC, "PAGE", 16)
    assert sorted(tuple(x) for x in NC.near_copy_classes(df, "t", "id").collect()) == want
    assert NC.near_copy_classes(df.limit(0), "t", "id").count() == 0


def test_near_copy_classes_send_few_whole_sets(spark, monkeypatch):
    """Texts that only share a phrase are told apart before their sets travel, and a group of many cells is sent a few times, not once per phrase and slice."""
    import random

    from codeloom.operators import near_copies as NC

    r = random.Random(5)
    texts = {}
    for c in range(120):
        own = [f"u{c}x{i}" for i in range(150)]
        phrase = [f"p{c // 3}x{i}" for i in range(5)]
        texts[c] = own[:60] + phrase + own[60:]
    base = [f"b{i}" for i in range(150)]
    for c in range(120):
        at = r.randrange(150)
        texts[1000 + c] = base[:at] + [f"n{c}"] + base[at + 1 :]
    monkeypatch.setattr(NC, "MASS", 4000, raising=False)
    sent, compare = [], NC.similar_pairs

    def counted(cells, least, every):
        sent.append(cells.agg(F.sum(F.length("digests") / 8)).first()[0] or 0)
        return compare(cells, least, every=every)

    monkeypatch.setattr(NC, "similar_pairs", counted)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "id long, t string")
    got = {k: (c, n) for k, c, n, _ in NC.near_copy_classes(df, "t", "id").collect()}
    assert got == {k: (k, 1) if k < 1000 else (1000, 120) for k in texts}
    whole = sum(len(set(w)) - 4 for k, w in texts.items() if k >= 1000)
    assert whole > 4 * 4000 and sum(sent) < 4 * whole


def test_near_copy_classes_of_groups_of_many_cells(spark, monkeypatch):
    """Stars whose leaves are unlike each other, and sets just below the asked similarity, in groups and buckets cut into many slices."""
    import random

    from codeloom.operators import near_copies as NC

    r = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"g{g}b{i}" for i in range(200)]
        rows.append((g * 1000, " ".join(base)))
        for c in range(1, 40):
            v = base[:]
            width = r.choice([6, 14, 17, 18, 19, 20, 22])
            at = r.randrange(4, 196 - width)
            v[at : at + width] = [f"g{g}x{c}y{i}" for i in range(width)]
            rows.append((g * 1000 + c, " ".join(v)))
    rows += [(5000, rows[3][1]), (3, "a b c"), (3, "a  b c"), (None, rows[0][1])]
    sets = [(k, frozenset(NC.shingle_digests(t, 5).tolist())) for k, t in rows if k is not None]
    top = {s: s for _, s in sets}

    def find(s):
        return s if top[s] == s else find(top[s])

    for a in list(top):
        for b in list(top):
            if len(a & b) >= 0.8 * len(a | b) - 1e-12:
                top[find(a)] = find(b)
    classes = {}
    for k, s in sets:
        classes.setdefault(find(s), []).append(k)
    want = sorted((k, min(classes[find(s)]), len(classes[find(s)]), min(x for x, y in sets if y == s)) for k, s in sets)
    monkeypatch.setattr(NC, "MASS", 900, raising=False)
    monkeypatch.setattr(NC, "SKETCHED", 600, raising=False)
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(tuple(x) for x in NC.near_copy_classes(df, "t", "id").collect()) == want
    sizes = {c: n for _, c, n, _ in want}
    assert any(n > 10 for n in sizes.values()) and list(sizes.values()).count(1) > 10


def test_held_out_rows_are_never_fitted(spark):
    from codeloom.operators import models as MD

    rows = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("string").alias("project"), (F.col("id") % 2).cast("int").alias("label"))
    seen = {}

    def fit(train):
        seen["train"] = {r.id for r in train.collect()}

    scored = {r.id for r in MD.held_out(rows, fit, lambda m, d: d, "project").collect()}
    assert seen["train"] and scored and not seen["train"] & scored and len(seen["train"] | scored) == 400


def test_a_value_without_a_text_keeps_its_file(spark):
    from codeloom.operators import facts as FA
    from codeloom.sources import files as FI

    code = "f(x=0x" + "f" * 5000 + ")\ng(1)\n"
    rows = spark.createDataFrame([("a.py", code), ("b.py", "def f(:\n"), ("c.py", None), ("d.py", "x = 1\n" * 3)], "file string, code string")
    assert {r.status: r.files for r in FI.status_counts(FA.extract_facts(rows)).collect()} == {"ok": 3, "unparsable": 1}
    assert FA.extract_facts(rows, ("file", "status", "id")).columns == ["file", "status", "id"]


def test_source_tree_is_written_by_the_tasks_themselves(spark, tmp_path):
    """One file per folder with all its texts; no file comes from Hadoop's local file system, which starts a process for each."""
    texts = [("1", "a\r\nb"), ("2", None), ("3", "ö"), ("3", "xyz"), (None, "q"), ("4", "")]
    rows = spark.createDataFrame(texts, "f string, t string")
    root = str(tmp_path / "tree")
    FI.write_source_tree(rows, "f", "t", root)
    got = {r.file.rsplit("folder=", 1)[1].split("/")[0]: (len(r.code), r.status) for r in FI.scan_source_files(spark, root, "*.txt").collect()}
    assert got == {"1": (4, "ok"), "2": (1, "ok"), "3": (6, "ok"), FI.NO_FOLDER: (2, "ok"), "4": (1, "ok")}
    assert sorted(p.name for p in (tmp_path / "tree").rglob("*") if p.is_file()) == ["part-0.txt"] * 5
