"""Graph rules against the brute-force walk, and the decided semantics one by one."""

import collections

import pytest

import brute
from codeloom.operators import facts as FA
from codeloom.operators import graph_build as G
from codeloom.operators import matching as M
from codeloom.plans import query_build as QB
from codeloom.plans.views import CODE_SHAPES
from codeloom.sources.catalogue import Catalogue
from pyspark.sql import functions as F

SNIPPETS = {
    "empty": "",
    "typed": "import os\n\ndef hello(who: str, n: Dict[str, int] = {}) -> List[int]:\n    return f'hi {who}' * n\n",
    "branches": "def f(x):\n    if x:\n        a = 1\n        b = a\n    elif x > 2:\n        c = 3\n    else:\n        d = x\n    e = d\n",
    "loops": "def f(xs):\n    for x in xs:\n        a = x\n        b = a\n    else:\n        a = 0\n    while a:\n        a = a - 1\n    return a\n",
    "tries": "def f(x):\n    try:\n        a = 1 / x\n    except (A, B) as e:\n        a = e\n    except C:\n        pass\n    else:\n        b = a\n    finally:\n        del x\n",
    "withs": "async def g(l):\n    async with l as m, l.n() as (o, p):\n        y = m\n    with open(y) as f:\n        f.read(o, p, *l, k=y)\n",
    "comps": "def f(xs, k):\n    a = [x * k for x in xs if x > k]\n    b = {x: [y for y in a if y in xs] for x in a}\n    c = {z for z in b}\n    return sum(w for w in c)\n",
    "scopes": "x = 1\ndef f(y=x):\n    def g(z):\n        nonlocal y\n        y = z + x\n        return y\n    x = 2\n    return g(x) + x\nclass C(object):\n    x = x\n    def m(self):\n        return self.x + x\nh = lambda q: q + x\nr = q\n",
    "decorated": "@app.route('/a')\n@auth(role=x)\ndef f(a):\n    x = a\n    return x\n",
    "match": "def f(v):\n    match v:\n        case [a, b]:\n            c = a\n        case {'k': d, **rest}:\n            c = d\n        case _:\n            c = v\n    return c\n",
    "async": "async def g(xs):\n    async for x in xs:\n        y = await do(x)\n    return [i async for i in y]\n",
    "unicode": "größe = 'äö'\nname = größe + 'é'\nprint(größe, name)\n",
    "walrus": "def f(d):\n    while (n := d.next()) is not None:\n        d.a.b = n\n        d[n] += n\n    return n, f'{n!r:>{d}}'\n",
    "annotated": "class A:\n    x: int = 1\n    y: Optional[Dict[str, int]]\n    def __init__(self, *args: int, **kw: str) -> None:\n        self.x: int = args[0]\n",
    "globals": "def f():\n    global z\n    z = 1\n    import a.b as c, d.e\n    from . import q\n    return z, c, q\n",
    "trystar": "try:\n    a = 1\nexcept* E:\n    b = 2\n",
    "twice": "def f(x):\n    return g(x, x, x.y(x))\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(k, v) for k, v in SNIPPETS.items()]
    rows += [(k, "\n".join(v).replace("{id}", "1") + "\n") for k, v in CODE_SHAPES.items()]
    files = spark.createDataFrame(rows, "file string, code string")
    return FA.extract_facts(M.with_frameworks(files)).cache()


def test_edges_equal_brute_force(facts):
    got = collections.defaultdict(list)
    for r in G.graph_edges(facts).select("file", "src", "dst", "kind").collect():
        got[r.file].append((r.src, r.dst, r.kind))
    for name, code in SNIPPETS.items():
        assert sorted(got[name]) == brute.edges(code), name


def test_nodes_equal_brute_force(facts):
    got = collections.defaultdict(list)
    for r in G.graph_nodes(facts).collect():
        got[r.file].append((r.id, r.kind))
    for name, code in SNIPPETS.items():
        want = [(i, brute.kind(n)) for i, (n, _, _) in enumerate(brute.numbered(code), 1)]
        assert sorted(got[name]) == want, name


def test_shape_tables_equal_brute_force():
    count = collections.Counter
    for shape, lines in CODE_SHAPES.items():
        code = "\n".join(lines).replace("{id}", "9") + "\n"
        rows, edges = brute.numbered(code), brute.edges(code)
        line = [0] + [brute.line(n) for n, _, _ in rows]

        def of(table):
            return {r[1:-1] if len(r) > 3 else r[1]: r[-1] for r in table if r[0] == shape}

        assert of(QB.NODE_COUNTS) == dict(count(brute.kind(n) for n, _, _ in rows))
        assert of(QB.EDGE_COUNTS) == dict(count(k for _, _, k in edges))
        for kind, table in (("DFG", QB.FLOW_LINES), ("CFG", QB.CONTROL_LINES)):
            assert of(table) == dict(count((line[a], line[b]) for a, b, k in edges if k == kind))


def test_then_tail_reaches_else_head_unless_split_by_field(spark, facts):
    f = facts.where("file = 'branches'")
    line = {r.id: r.sl for r in f.select("id", "sl").collect()}
    joined = {(line[r.src], line[r.dst]) for r in G.sequence_edges(f).collect()}
    split = {(line[r.src], line[r.dst]) for r in G.sequence_edges(f, by_field=True).collect()}
    assert (4, 5) in joined and (4, 5) not in split
    assert (3, 4) in joined and (3, 4) in split


def test_span_code_and_type_attributes(facts):
    n = {(r.file, r.kind, r.symbol): r for r in G.graph_nodes(facts).collect()}
    f = n["typed", "Function", "hello"]
    assert f.attrs == {"ContainerType": "List", "DataType": "int"} and f.type_hint == "List[int]"
    assert n["typed", "Arg", "n"].attrs == {"ContainerType": "Dict", "DataType": "str, int"}
    assert n["typed", "Arg", "who"].attrs == {"DataType": "str"}
    module = n["typed", "Module", None]
    assert tuple(module.span) == (1, 0, 4, len("    return f'hi {who}' * n")) and module.code == SNIPPETS["typed"].rstrip("\n")
    empty = n["empty", "Module", None]
    assert tuple(empty.span) == (1, 0, 1, 0) and empty.code is None


def test_unparsable_files_are_counted(spark):
    from codeloom.sources.files import status_counts

    files = spark.createDataFrame(
        [("a", "x = 1"), ("b", "def ("), ("c", "a\0b"), ("d", "(" * 500)], "file string, code string"
    )
    facts = FA.extract_facts(files)
    assert {r.status: r.files for r in status_counts(facts).collect()} == {"ok": 1, "unparsable": 3}
    assert G.graph_nodes(facts).select("file").distinct().count() == 1


MATCH = """from flask import request as rq
import jwt, subprocess, hashlib as hl
import requests.sessions
from sqlalchemy import text
def f(cur, u):
    a = rq.args.get("x")
    b = rq.get_json(force=True)
    jwt.decode(a, verify=False)
    jwt.decode(a, options={"verify_signature": False})
    jwt.decode(a, verify=0)
    jwt.decode(a, algorithms=["none"])
    jwt.decode(a)
    subprocess.run(a, shell=1)
    subprocess.run(a, shell=a)
    hl.sha1(b)
    text(a)
    x.y.os.getenv("k")
    getenv("k")
    sqlite3.Cursor.execute("select ?", a)
    sqlite3.Cursor.execute(f"select {a}", a)
    sqlite3.Cursor.execute(a, b)
    sqlite3.Cursor.execute("select 1", b)
    sqlite3.Cursor.execute("select ?")
"""


def matches(spark, code, **kw):
    files = spark.createDataFrame([("f", code)], "file string, code string")
    facts = FA.extract_facts(M.with_frameworks(files)).cache()
    rows = M.matched_nodes(facts, **kw).where("kind in ('Call', 'Attribute')").collect()
    return {(r.span.sl, r.kind, r.code): r.attrs for r in rows if any(k.startswith(("is_", "san")) for k in r.attrs)}


def test_rule_matches(spark):
    got = matches(spark, MATCH)
    at = {}
    for (line, kind, _), a in got.items():
        at.setdefault((line, kind), []).append(a)
    assert at[6, "Call"][0]["source_id"] == "SRC_FLASK_REQUEST" and at[6, "Attribute"][0]["source_kinds"] == "http_request"
    # flask.request.get_json is an attribute rule: the attribute node matches, the call's base does not
    assert (7, "Attribute") in at and (7, "Call") not in at
    failed = {line: a[0].get("sink_constraint_failed") for (line, k), a in at.items() if "sink_id" in a[0]}
    assert failed[8] is None and failed[10] is None  # verify=False and verify=0 are equal values
    assert failed[9] == "true" and failed[11] == "true"  # only constants are read
    assert failed[12] == "true" and failed[13] is None and failed[14] == "true"
    assert at[12, "Call"][0]["sanitizer_id"] == "SAN_JWT_VERIFY"
    assert at[15, "Call"][0]["sink_id"] == "SINK_HASHLIB_WEAK" and at[16, "Call"][0]["sink_id"] == "SINK_SQLALCHEMY_TEXT"
    assert at[17, "Call"][0]["source_id"] == "SRC_ENV" and (18, "Call") not in at
    sane = {line for (line, k), a in at.items() if a[0].get("sanitizer_id") == "SAN_SQL_PARAM"}
    assert sane == {19, 21}


def test_literal_kwargs_extend_constraints(spark):
    got = matches(spark, MATCH, literal_kwargs=True)
    failed = {line: a.get("sink_constraint_failed") for (line, k, _), a in got.items() if a.get("sink_id") == "SINK_JWT_DECODE"}
    assert failed[9] is None and failed[11] is None and failed[12] == "true"


def test_alias_is_visible_only_after_its_import_and_later_wins(spark):
    code = "os1.getenv('a')\nimport os as os1\nos1.getenv('b')\nimport posix as os1\nos1.getenv('c')\n"
    assert {line for line, _, _ in matches(spark, code)} == {3}


def test_framework_gate(spark):
    assert not matches(spark, "request.GET\n")
    assert matches(spark, "import django\nrequest.GET\nrequest.POST.get(1)\n")


def test_later_sink_with_same_id_replaces_the_earlier_in_its_place():
    sinks = [{"id": "A", "calls": ["a"]}, {"id": "B", "calls": ["b"]}]
    c = Catalogue([], [], [{"id": "p", "sinks": sinks}, {"id": "q", "sinks": [{"id": "A", "calls": ["z"]}]}])
    assert [(s["id"], s["calls"]) for s in c.sinks] == [("A", ["z"]), ("B", ["b"])]


def test_endpoints_without_decorator(spark):
    code = "@app.route('/a')\ndef a(): pass\n@app.route('/b')\n@login_required\ndef b(): pass\n@router.get('/c')\nasync def c(): pass\ndef d(): pass\n"
    facts = FA.extract_facts(spark.createDataFrame([("f", code)], "file string, code string"))
    from codeloom.sources.catalogue import AUTH_DECORATORS, ENDPOINT_DECORATORS

    assert {r.symbol for r in G.unguarded_endpoints(facts, ENDPOINT_DECORATORS, AUTH_DECORATORS).collect()} == {"a", "c"}


def test_repository_merge_keeps_ids_unique(spark, facts):
    n, e = G.merged_ids(G.graph_nodes(facts).select("file", "id"), G.syntax_edges(facts))
    assert n.count() == n.select("id").distinct().count()
    ends = e.select("file", F.explode(F.array("src", "dst")).alias("id"))
    assert ends.join(n, ["file", "id"], "left_anti").count() == 0


def test_pattern_inference_ties_keep_catalogue_order(spark):
    row = spark.range(1).select(
        M.inferred_pattern(F.lit(None).cast("string"), F.lit("SINK_DBAPI_EXECUTE"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("p"),
        M.inferred_pattern(F.lit("SRC_ENV"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x")).alias("q"),
        M.inferred_pattern(F.lit("SRC_ENV"), F.lit(None).cast("string"), F.lit("auth"), F.lit("x")).alias("r"),
    ).first()
    assert row.p.pattern_id == "SQLI_RAW_STRING_FORMAT" and row.p.score == 10
    assert row.q is None and row.r.pattern_id == "JWT_VERIFY_DISABLED"
