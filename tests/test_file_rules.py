"""Rules over the facts of files do their work in few passes, and their results stay the same."""

import os

import pytest

from codeloom.operators import features as FT
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.operators import taint as TA
from codeloom.plans import graphs as PG
from codeloom.sources import files as FI

CODE = 'import os\ndef f(x):\n    y = os.getenv("A")\n    if x:\n        z = y + x\n    os.system(z)\n    return z\n'


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f"f{i}.py", CODE) for i in range(3)], "file string, code string")


@pytest.fixture(scope="module")
def facts(files):
    return PG.stored_facts(files)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_stored_facts_are_matched_where_they_lie(facts):
    """F1 F8: a union of uses and imports was dealt anew, though the facts lie by file."""
    found = M.matched_nodes(facts)
    assert "Exchange" not in plan(found)
    hits = {(r.file, r.a, r.b) for r in found.selectExpr("file", "attrs.source_id AS a", "attrs.sink_id AS b").where("a IS NOT NULL OR b IS NOT NULL").collect()}
    assert hits == {(f"f{i}.py", *x) for i in range(3) for x in (("SRC_ENV", None), (None, "SINK_OS_SYSTEM"))}


def test_edges_of_a_row_and_depths_of_a_use_are_compiled(facts):
    """array_compact() and transform() interpreted what they were given, for every fact."""
    for found in (G.syntax_edges(facts), G.branch_edges(facts)):
        assert "lambda" not in plan(found) and found.where("src IS NULL OR dst IS NULL OR kind IS NULL").count() == 0
    assert G.branch_edges(facts).where("file = 'f0.py'").count() == 1
    assert G.syntax_edges(facts).where("file = 'f0.py'").count() == facts.where("file = 'f0.py' AND parent IS NOT NULL").count()


def test_names_are_normalised_in_one_pass_over_the_files(files):
    """names met their normal form in a join that parsed each file twice."""
    found = G.normalised_names(PG.facts_of(files, G.UNIT_FACTS)).where("function_id <> 0")
    assert plan(found).count("MapInArrow") == 1
    assert {(r.name, r.normal_name) for r in found.collect()} == {("x", "v1"), ("y", "v2"), ("os", "v3"), ("z", "v4")}


def test_names_without_file_have_no_normal_form(spark):
    rows = [(None, "ok", 1, [0, 1], "Name", "a", None), ("f", "ok", 2, [0, 1], "Name", None, None), ("f", "ok", 3, [0, 1], "Name", "b", None)]
    facts = spark.createDataFrame(rows, "file string, status string, id bigint, scopes array<bigint>, ast_type string, name string, code string")
    assert [(r.file, r.name, r.normal_name) for r in G.normalised_names(facts).collect()] == [("f", "b", "v2")]


def test_short_vectors_are_pooled_as_long_ones(spark):
    """each dimension of a short vector is an aggregate of its own."""
    rows = spark.createDataFrame([("a", [1.0, -2.0]), ("a", [4.0, 0.5]), ("b", [0.25, 8.0]), (None, [1.0, 1.0])], "file string, vec array<float>")
    key = lambda df: {r.file: [round(x, 9) for x in r.pooled] for r in df.collect()}
    assert key(FT.pooled_vectors(rows, ["file"], dims=2)) == key(FT.pooled_vectors(rows, ["file"])) != {}


def test_only_files_that_are_asked_for_are_cut_into_cells(spark, facts, monkeypatch):
    """the spans of all files were cut into cells, twice."""
    seen = []
    levels = TA._levels_in_use
    monkeypatch.setattr(TA, "_levels_in_use", lambda nodes, *a: (seen.append({r.file for r in nodes.collect()}), levels(nodes, *a))[1])
    asked = spark.createDataFrame([("f1.py", 3, 8, "source"), ("f1.py", 6, 4, "sink"), ("gone.py", 1, 0, "sink")], "file string, line int, col int, role string")
    nodes = M.matched_nodes(facts)
    got = {(r.line, r.role): r.id for r in TA.node_at_position(asked, nodes).collect()}
    lines = {r.id: r.span.sl for r in nodes.where("file = 'f1.py'").collect()}
    assert seen == [{"f1.py"}]
    assert {k: lines[v] for k, v in got.items()} == {(3, "source"): 3, (6, "sink"): 6}


def test_a_span_of_one_cell_is_that_cell(spark):
    rows = spark.createDataFrame([(0, 0), (5, 5), (3, 9), (7, 6)], "a bigint, b bigint")
    got = {(r.a, r.b): [(c.level, c.cell) for c in r.c] for r in rows.select("a", "b", TA.dyadic_cover(rows.a, rows.b).alias("c")).collect()}
    assert got[0, 0] == [(0, 0)] and got[5, 5] == [(0, 5)] and got[7, 6] == []
    assert sorted(x for level, cell in got[3, 9] for x in range(cell << level, (cell + 1) << level)) == list(range(3, 10))


def test_a_source_tree_is_listed_by_the_tasks(spark, tmp_path):
    """the driver kept the status of every file."""
    root = str(tmp_path / "tree")
    for name, text in {
        "a.py": b"x = 1\r\ny = 2\r", "sub/deep/b.py": "é = 1\n".encode(), "sub/bad.py": b"\xff\xfe", "sub/c.txt": b"no", "sub/__pycache__/d.py": b"no",
        ".git/e.py": b"no", "_hidden/f.py": b"no", "_k=1/g.py": b"pass", "empty.py": b"",
    }.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(text)
    found = FI.scan_source_files(spark, root)
    assert found.inputFiles() == []
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    assert {r.file for r in found.collect()} == {r.path for r in raw.collect() if "/__pycache__/" not in r.path}
    assert {r.file[len(f"file:{root}/"):]: (r.code, r.status) for r in found.collect()} == {
        "a.py": ("x = 1\ny = 2\n", "ok"), "sub/deep/b.py": ("é = 1\n", "ok"), "sub/bad.py": (None, "undecodable"), "_k=1/g.py": ("pass", "ok"),
    }


def test_stored_facts_are_not_sorted_before_they_are_written(spark, files):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert PG.stored_facts(files, G.UNIT_FACTS).select("file").distinct().count() == 3
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_followed_files_are_joined_once_and_lie_by_file(spark):
    """F2 F7: flow edges, value edges and lines each joined or shuffled the facts of all files."""
    texts = [("both.py", CODE), ("source.py", 'import os\ny = os.getenv("A")\n'), ("sink.py", "import os\nos.system(z)\n"), ("none.py", "a = 1\n")]
    nodes, followed = PG.followed_facts(PG.stored_facts(spark.createDataFrame(texts, "file string, code string"), PG.BASELINE_FACTS))
    assert {r.file for r in followed.collect()} == {"both.py"} and {r.file for r in nodes.collect()} == {"both.py", "source.py", "sink.py"}
    assert "Exchange" not in plan(G.flow_edges(followed)) and "Join" not in plan(G.value_edges(followed))
    assert [(r.file, r.sink_id) for r in PG.followed_paths(nodes, followed).collect()] == [("both.py", "SINK_OS_SYSTEM")]
