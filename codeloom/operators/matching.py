"""Catalogue matching: rules become column expressions, so nodes are matched without a shuffle.

The catalogue is a rule file held by the driver (tens of names), which makes literals safe.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.functions.hold import held, inlined
from codeloom.operators.graph_build import NODE_FACTS, graph_nodes, node_kind, parsed, span_struct
from codeloom.sources.catalogue import DEFAULT, FRAMEWORK_MARKS, Catalogue, canonical_value

# What matching reads of a fact.
MATCH_FACTS = (*NODE_FACTS, "frameworks", "n_args", "query_kind", "query_text", "kwargs", "literal_kwargs", "imports")

# SQL placeholders.
PLACEHOLDERS = ["%s", "%d", "%f", "?", ":name", ":id", ":value"]
NAMED_PLACEHOLDER = r"%\([^)]+\)[sd]"

# Marks of the heuristic candidates.
INPUT_WORDS = ["input", "request", "args", "kwargs", "data", "user"]
DANGEROUS_WORDS = [
    "execute", "query", "cursor.execute", "run_sql_query", "executescript",
    "system", "popen", "call", "run", "check_call", "check_output",
    "eval", "exec", "__import__", "compile",
    "open", "file", "read", "write",
    "loads", "load", "pickle.loads", "yaml.load",
    "render_template_string", "mark_safe",
]

# Keyword bonus of pattern inference, by a part of the pattern id.
KEYWORD_BONUS = {
    "sqli": ["execute", "query", "cursor"],
    "cmdi": ["subprocess", "system", "popen"],
    "ssrf": ["requests", "urlopen", "httpx"],
    "xss": ["markup", "html", "response"],
}


def frameworks_of(code: Column) -> Column:
    """ARRAY of the frameworks a source text mentions, in name order."""
    low = F.lower(code)
    hits = [F.when(X.contains_any(low, marks), F.lit(fw)) for fw, marks in FRAMEWORK_MARKS.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def with_frameworks(files: DataFrame) -> DataFrame:
    return files.withColumn("frameworks", frameworks_of(F.col("code")))


def is_parameterised_query(n_args: Column, query_kind: Column, query_text: Column) -> Column:
    """Two or more arguments and a query that is not built in place."""
    holder = X.contains_any(query_text, PLACEHOLDERS) | query_text.rlike(NAMED_PLACEHOLDER)
    static = F.when(query_kind == "literal", holder).when(query_kind == "fstring", False).otherwise(True)
    return F.coalesce((n_args >= 2) & static, F.lit(False))


def constraint_holds(kwargs: Column, constraint: dict) -> Column:
    """All required keyword arguments are present and equal; any_of needs one of its options."""
    tests = [
        F.coalesce(kwargs[key] == canonical_value(value), F.lit(False))
        for key, value in (constraint.get("kwargs") or {}).items()
    ]
    if "any_of" in constraint:
        tests.append(X.any_of([constraint_holds(kwargs, c) for c in constraint["any_of"]]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _sql_text(value) -> str:
    """SQL literal of a string, flag or list of strings."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "cast(array(" + ", ".join(_sql_text(v) for v in value) + ") as array<string>)"


def rule_literal(rules: list[dict], fields: dict) -> Column:
    """Rules in catalogue order as one constant ARRAY<STRUCT>; ``fields`` maps a name to its value."""
    rows = [
        "named_struct('ord', " + str(i) + "".join(f", '{n}', {_sql_text(get(r))}" for n, get in fields.items()) + ")"
        for i, r in enumerate(rules)
    ]
    return F.expr(f"array({', '.join(rows)})")


_RULE_FIELDS = {
    "id": lambda r: r["id"],
    "kind": lambda r: r.get("kind") or ",".join(r.get("kinds", [])),
    "frameworks": lambda r: r.get("frameworks") or [],
    "calls": lambda r: r.get("calls") or [],
    "attrs": lambda r: r.get("attrs") or [],
    "parameters": lambda r: bool(r.get("needs_parameters")),
}


def _places(rules: list[dict], field: str) -> Column:
    """Constant MAP of each name in ``field`` to the places of the rules that hold it."""
    places: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for name in dict.fromkeys(_RULE_FIELDS[field](r)):
            places.setdefault(name, []).append(i)
    if not places:
        return F.expr("cast(map() as map<string,array<int>>)")
    return F.expr("map(" + ", ".join(f"{_sql_text(n)}, array({', '.join(map(str, at))})" for n, at in places.items()) + ")")


def _named_rules(rules: list[dict], base_attr: bool = False) -> Column:
    """ARRAY of the places of the rules that a row's names lead to; null for rows that are no calls or attributes.

    Needs the columns kind, _suffixes (dotted suffixes of the call name), _attr and _base.
    """
    kind, none = F.col("kind"), F.array().cast("array<int>")
    by_call, by_attr = _places(rules, "calls"), _places(rules, "attrs")
    call = F.flatten(F.transform("_suffixes", lambda s: F.coalesce(by_call[s], none)))
    if base_attr:
        call = F.concat(call, F.coalesce(by_attr[F.col("_base")], none))
    return F.when(kind == "Call", call).when(kind == "Attribute", F.coalesce(by_attr[F.col("_attr")], none))


def _first_rule(rules: list[dict], places: str, extra=None) -> Column:
    """STRUCT of the first rule in ``places`` whose frameworks fit the row; null if there is none."""
    if not rules:
        return F.lit(None).cast("struct<id:string,kind:string>")
    literal = rule_literal(rules, _RULE_FIELDS)

    def fits(place):
        r = F.get(literal, place)
        gate = (F.size(r["frameworks"]) == 0) | F.arrays_overlap(r["frameworks"], F.col("frameworks"))
        return gate if extra is None else gate & extra(r)

    return F.when(F.size(places) > 0, F.get(literal, F.array_min(F.filter(places, fits))))


def match_places(catalogue: Catalogue = DEFAULT) -> dict[str, Column]:
    """The places of the sources, sinks and sanitizers that a row's names lead to: a name is looked up, not compared with every rule."""
    return {
        "_sources": _named_rules(catalogue.sources, base_attr=True), "_sinks": _named_rules(catalogue.sinks),
        "_sanitizers": _named_rules(catalogue.sanitizers),
    }


def match_columns(catalogue: Catalogue = DEFAULT) -> dict[str, Column]:
    """source, sink and sanitizer as rule structs."""
    param = is_parameterised_query(F.col("n_args"), F.col("query_kind"), F.col("query_text"))
    return {
        "source": _first_rule(catalogue.sources, "_sources"),
        "sink": _first_rule(catalogue.sinks, "_sinks"),
        "sanitizer": _first_rule(catalogue.sanitizers, "_sanitizers", extra=lambda r: ~r["parameters"] | param),
    }


def sink_constraint(catalogue: Catalogue = DEFAULT, literal_kwargs: bool = False) -> Column:
    """Whether the matched sink's constraint holds; sinks without one always do."""
    kwargs = F.map_concat("kwargs", "literal_kwargs") if literal_kwargs else F.col("kwargs")
    ok = F.lit(True)
    for r in catalogue.sinks:
        if r.get("constraints"):
            bound = (F.col("kind") == "Call") & (F.col("sink.id") == r["id"])
            ok = F.when(bound, constraint_holds(kwargs, r["constraints"])).otherwise(ok)
    return ok


def with_match_names(nodes: DataFrame, code: str, longest: int) -> DataFrame:
    """The normal forms the name tests look at."""
    c = F.col(code)
    return (
        nodes.withColumn("_suffixes", X.dotted_suffixes(X.call_name(c), longest))
        .withColumn("_attr", X.attribute_name(c))
        .withColumn("_base", X.attribute_name(X.call_base(c)))
    )


def import_aliases(facts: DataFrame) -> DataFrame:
    """file, alias, path, pos: every imported name; the last one in a file wins."""
    return parsed(facts).where(F.col("imports").isNotNull()).select(
        "file", F.col("id").alias("pos"), F.inline("imports")
    ).select("file", "alias", "path", "pos")


def last_aliases(facts: DataFrame) -> DataFrame:
    return import_aliases(facts).groupBy("file", "alias").agg(F.max_by("path", "pos").alias("path"))


def _first_identifier(code: Column) -> Column:
    head = F.trim(F.substring_index(code, ".", 1))
    return F.trim(F.substring_index(head, "(", 1))


def with_resolved_code(facts: DataFrame) -> DataFrame:
    """Calls and attributes with ``resolved``: their code with the first name replaced by the path it
    was imported from, as far as an earlier import is visible.  One as-of window per (file, name)."""
    uses, none = F.col("ast_type").isin("Call", "Attribute"), "array<struct<use:boolean,key:string,path:string>>"
    no_path = F.lit(None).cast("string")
    use = F.when(uses, F.array(F.struct(F.lit(True).alias("use"), _first_identifier(F.col("code")).alias("key"), no_path.alias("path"))))
    brought = F.transform("imports", lambda i: F.struct(F.lit(False).alias("use"), i["alias"].alias("key"), i["path"].alias("path")))
    records = F.concat(*[F.coalesce(r, F.array().cast(none)) for r in (use, brought)])
    # one scan for both: a union would deal rows that lie by file already
    rows = inlined(parsed(facts).where(uses | F.col("imports").isNotNull()), records, *facts.columns)
    rows = rows.withColumn("_digest", F.xxhash64("file", "key"))  # rows are sorted by a number first, as paths begin alike
    w = W.partitionBy("_digest", "file", "key").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_path", F.last("path", ignorenulls=True).over(w)).where("use")
    rest = F.when(
        F.contains(F.col("code"), F.lit(".")),
        F.concat(F.lit("."), F.substring(F.col("code"), F.instr("code", ".") + 1, F.length("code"))),
    ).otherwise("")
    resolved = F.when(F.col("_path").isNotNull(), F.concat("_path", rest)).otherwise(F.col("code"))
    return seen.select(*facts.columns, resolved.alias("resolved"))


def matched_nodes(
    facts: DataFrame, catalogue: Catalogue = DEFAULT, literal_kwargs: bool = False
) -> DataFrame:
    """Nodes with type and match attributes, keyed by (file, id).

    Only calls and attributes can match, so only they are resolved and looked up; all other nodes
    pass by.  Materialise ``facts`` first: they are read three times.
    """
    rows = with_resolved_code(facts).withColumn("kind", node_kind(F.col("ast_type")))
    rows = with_match_names(rows, "resolved", catalogue.longest_call)
    rows = held(rows, **match_places(catalogue))
    rows = held(rows, **match_columns(catalogue))
    rows = rows.withColumn("sink_ok", sink_constraint(catalogue, literal_kwargs))
    others = graph_nodes(facts.where(~F.col("ast_type").isin("Call", "Attribute")))
    return rows.select(
        "file", "id", "kind", span_struct().alias("span"), "code", F.col("name").alias("symbol"),
        F.col("hint").alias("type_hint"), F.array().cast("array<string>").alias("flags"), match_attrs().alias("attrs"),
    ).unionByName(others)


def match_attrs() -> Column:
    """MAP of the match attributes that apply."""
    failed = F.when(F.col("sink").isNotNull() & ~F.col("sink_ok"), "true")
    entries = [
        ("is_source", F.when(F.col("source").isNotNull(), "true")),
        ("source_id", F.col("source.id")),
        ("source_kinds", F.nullif("source.kind", F.lit(""))),
        ("is_sink", F.when(F.col("sink").isNotNull(), "true")),
        ("sink_id", F.col("sink.id")),
        ("sink_kind", F.col("sink.kind")),
        ("sink_constraint_failed", failed),
        ("sanitizer_id", F.col("sanitizer.id")),
        ("sanitizer_kind", F.col("sanitizer.kind")),
    ]
    full = F.create_map(*[x for k, v in entries for x in (F.lit(k), v)])
    some = F.col("source").isNotNull() | F.col("sink").isNotNull() | F.col("sanitizer").isNotNull()
    return F.when(some, F.map_filter(full, lambda _, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,string>"))


def source_candidates(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("attrs")["is_source"] == "true")


def sink_candidates(nodes: DataFrame) -> DataFrame:
    failed = F.coalesce(F.col("attrs")["sink_constraint_failed"], F.lit("")) == "true"
    return nodes.where((F.col("attrs")["is_sink"] == "true") & ~failed)


def heuristic_source(kind: Column, code: Column) -> Column:
    named = (kind == "Name") & X.contains_any(F.lower(F.coalesce(code, F.lit(""))), INPUT_WORDS)
    return (kind == "Arg") | named


def heuristic_sink(kind: Column, code: Column, symbol: Column) -> Column:
    low = F.concat_ws("\n", F.lower(code), F.lower(symbol))
    return (kind == "Call") & X.contains_any(low, DANGEROUS_WORDS)


def graph_frameworks(files: DataFrame) -> DataFrame:
    """file, metadata.frameworks as stored with a graph."""
    return files.select("file", F.struct(frameworks_of(F.col("code")).alias("frameworks")).alias("metadata"))


_PATTERN_FIELDS = {
    "pattern_id": lambda p: p["id"],
    "sources": lambda p: p.get("sources", []),
    "sinks": lambda p: [s["id"] for s in p.get("sinks", [])],
    "kinds": lambda p: [s.get("kind", "") for s in p.get("sinks", [])],
    "words": lambda p: [w for part, words in KEYWORD_BONUS.items() if part in p["id"].lower() for w in words],
}


def inferred_pattern(
    source: Column, sink: Column, kind: Column, code: Column, catalogue: Catalogue = DEFAULT
) -> Column:
    """STRUCT<pattern_id, score> of the best scoring pattern; ties keep catalogue order.

    +10 source named by the pattern, +5 source of the same family, +10 sink, +8 sink kind, +5 keyword.
    """
    asked = (F.coalesce(sink, F.lit("")) != "") | (F.coalesce(kind, F.lit("")) != "")
    # one element: what the pattern tests share is computed once and bound to a lambda variable
    shared = F.array(
        F.struct(F.split_part(source, F.lit("_"), F.lit(1)).alias("family"), F.lower(code).alias("code"), asked.alias("asked"))
    )

    def points(test, n):
        return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    def scored(p, z):
        family = (source != "") & F.exists(p["sources"], lambda x: F.startswith(x, z["family"]))
        score = (
            F.when(F.coalesce(F.array_contains(p["sources"], source), F.lit(False)), 10).otherwise(points(family, 5))
            + points(F.array_contains(p["sinks"], sink), 10)
            + points((kind != "") & F.array_contains(p["kinds"], kind), 8)
            + points(F.exists(p["words"], lambda w: F.contains(z["code"], w)), 5)
        )
        return F.struct(score.alias("score"), (-p["ord"]).alias("o"), p["pattern_id"].alias("pattern_id"))

    patterns = rule_literal(catalogue.patterns, _PATTERN_FIELDS)
    best = F.transform(
        F.filter(shared, lambda z: z["asked"]), lambda z: F.array_max(F.transform(patterns, lambda p: scored(p, z)))
    )
    hits = F.filter(best, lambda b: b["score"] > 0)
    named = F.transform(hits, lambda b: F.struct(b["pattern_id"].alias("pattern_id"), b["score"].alias("score")))
    return F.try_element_at(named, F.lit(1))
