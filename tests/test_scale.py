"""Steps whose cost must follow the input: no table that grows is broadcast, and work per row stays bounded."""

import pytest

from codeloom.operators import graph_build as G
from codeloom.plans import graphs as PG
from codeloom.plans import query_build as QB

CODE = 'import os\ndef f(x):\n    y = os.getenv("A")\n    z = y + x\n    os.system(z)\n    return z\n'


@pytest.fixture(scope="module")
def facts(spark):
    return PG.stored_facts(spark.createDataFrame([(f"f{i}.py", CODE) for i in range(3)], "file string, code string"))


def broadcasts(df) -> int:
    """Joins by broadcast in the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin")


def test_edges_meet_their_lines_without_a_broadcast(facts):
    control = QB._by_line(G.sequence_edges(facts).unionByName(G.branch_edges(facts)), facts)
    flow = QB._by_line(G.flow_edges(facts), facts)
    assert broadcasts(control) == 0 and control.where("file = 'f1.py'").count() > 0
    assert broadcasts(flow) == 0 and flow.where("file = 'f1.py'").count() > 0


def test_names_meet_their_normal_form_without_a_broadcast(facts):
    named = G.normalised_names(facts).where("function_id <> 0")
    assert broadcasts(named) == 0
    assert {(r.name, r.normal_name) for r in named.where("file = 'f0.py'").collect()} == {("x", "v1"), ("y", "v2"), ("os", "v3"), ("z", "v4")}


def test_recorded_positions_meet_their_nodes_without_a_broadcast(spark, facts):
    from codeloom.operators import matching as M
    from codeloom.operators import taint as TA

    p = "struct<file:string,line:int,col:int>"
    records = spark.createDataFrame(
        [(i, (f"f{i}.py", 3, 8), (f"f{i}.py", 5, 4), [], {"tool": "t"}) for i in range(3)],
        f"record bigint, source {p}, sink {p}, path array<{p}>, meta map<string,string>",
    )
    edges = TA.recorded_flow_edges(TA.mapped_records(records, M.matched_nodes(facts)))
    assert broadcasts(edges) == 0 and edges.count() == 3


def test_witnesses_meet_their_lines_without_a_broadcast(facts):
    found = PG.rule_baseline(facts, witnesses=True)
    assert broadcasts(found) == 0 and {r.file for r in found.collect()} == {"f0.py", "f1.py", "f2.py"}


def test_positions_ask_only_sizes_that_a_span_has(spark):
    from codeloom.operators import taint as TA

    nodes = spark.createDataFrame(
        [("a", 1, "Call", (1, 0, 40, 9)), ("a", 2, "Call", (3, 2, 3, 8)), ("b", 3, "Name", (5, 0, 6, 1)), ("b", 4, "Name", None)],
        "file string, id bigint, kind string, span struct<sl:int,sc:int,el:int,ec:int>",
    )
    # 17 sizes of each sort were asked before
    assert TA._levels_in_use(nodes, 16, 64) == ([0, 1], [0])
    assert TA._levels_in_use(nodes.where("false"), 16, 64) == ([], [])
    asked = spark.createDataFrame([("a", 3, 4, "sink"), ("a", 39, None, "sink"), ("b", 5, None, "path"), ("b", 9, 1, "path")], "file string, line int, col int, role string")
    found = TA.node_at_position(asked, nodes).collect()
    assert {(r.file, r.line, r.id) for r in found} == {("a", 3, 2), ("a", 39, 1), ("b", 5, 3)}


def test_narrow_facts_hold_what_is_wanted_and_write_no_expressions_out(monkeypatch):
    from codeloom.operators import facts as FA

    code = "@app.get('/x')\ndef f(a: List[int] = 1) -> str:\n    b: int = g(a)\n    return [c for c in b]\n"
    whole = list(FA.file_facts(code))
    place = {n: i for i, n in enumerate(FA.ROW_COLUMNS)}
    monkeypatch.setattr(FA.ast, "unparse", lambda node: 1 / 0)
    narrow = list(FA.file_facts(code, True, False))
    for n in FA.ROW_COLUMNS:
        if n not in ("hint", "decorators"):
            assert [r[place[n]] for r in narrow] == [r[place[n]] for r in whole], n


def test_matching_and_baseline_read_only_their_facts(spark):
    from codeloom.operators import matching as M

    files = spark.createDataFrame([("a.py", CODE)], "file string, code string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(M.matched_nodes(PG.facts_of(files, M.MATCH_FACTS))) == key(M.matched_nodes(PG.facts_of(files)))
    assert set(PG.stored_facts(files, PG.BASELINE_FACTS).columns) == {*M.MATCH_FACTS, *G.EDGE_FACTS}


def test_default_embedding_needs_no_shuffle(spark):
    from codeloom.operators import models as MD

    nodes = spark.createDataFrame([(1, "f(x)"), (2, None), (3, "f(x)")], "id bigint, code string")
    got = MD.embedded_nodes(nodes, None, "code", 8)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == ["id", "code", "vec"]
    rows = {r.id: r for r in got.collect()}
    assert rows[1].vec == rows[3].vec and sum(rows[1].vec) == 4 and rows[2].code is None and not any(rows[2].vec)


def test_ship_durations_are_dealt_by_rows(spark, tmp_path):
    """A task's part of the join does not grow with the tables: more rows make more parts, and neither side is broadcast."""
    import datetime

    from codeloom.plans.query_tenancy import ship_durations
    from codeloom.session import dealt

    day = lambda n: datetime.date(2024, 1, n)
    lines = [(1, 1, day(5)), (1, 1, day(6)), (1, 2, None), (2, 1, day(9)), (None, 1, day(9)), (3, 1, day(9))]
    orders = [(1, day(1)), (2, day(1)), (2, day(4)), (None, day(1)), (4, day(1))]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate date")
    orders = spark.createDataFrame(orders, "o_orderkey long, o_orderdate date")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    df = ship_durations(spark, str(tmp_path))
    ms = 86_400_000
    assert broadcasts(df) == 0
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1, 2, 9 * ms), (1, 2, 1, None), (2, 1, 2, 13 * ms)]
    a, b = dealt(["k"], spark.range(200).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k"), each=10)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 20
