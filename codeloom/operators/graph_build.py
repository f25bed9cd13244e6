"""Graph rules over syntax facts.

Syntax, branch and loop edges come from a row alone.  Sequential edges need one window per parent,
data-flow edges one as-of window per (file, name, scope).  Nothing here pairs rows.
"""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.functions.hold import inlined
from codeloom.functions.text import contains_any
from codeloom.operators.ordered import by_digest, running_sums
from codeloom.session import grown

# Node kinds by syntax class; every other class is a Stmt.
KIND_MAP = {
    "Module": "Module",
    "FunctionDef": "Function",
    "AsyncFunctionDef": "Function",
    "ClassDef": "Class",
    "With": "With",
    "AsyncWith": "With",
    "Try": "Try",
    "ExceptHandler": "Except",
    "Assign": "Assign",
    "AnnAssign": "AnnAssign",
    "AugAssign": "AugAssign",
    "Return": "Return",
    "Call": "Call",
    "Name": "Name",
    "Attribute": "Attribute",
    "Constant": "Literal",
    "arg": "Arg",
    "arguments": "Arguments",
    "JoinedStr": "JoinedStr",
    "FormattedValue": "FormattedValue",
    "ListComp": "ListComp",
    "SetComp": "SetComp",
    "DictComp": "DictComp",
    "GeneratorExp": "Generator",
    "AsyncFor": "AsyncFor",
    "Await": "Await",
}
DEFAULT_KIND = "Stmt"

LOOPS = ("For", "While", "AsyncFor")
WITHS = ("With", "AsyncWith")
CONTROL = ("If", "For", "While", "AsyncFor", "Try", "With", "AsyncWith")
ELEMENT_COMPS = ("ListComp", "SetComp", "GeneratorExp")
EDGE_COLUMNS = ("file", "src", "dst", "kind")
# What the rules read of a fact.
NODE_FACTS = ("file", "status", "id", "ast_type", "sl", "sc", "el", "ec", "code", "name", "hint")
EDGE_FACTS = (
    "file", "status", "id", "parent", "ast_type", "parent_type", "field", "ord", "last", "is_stmt", "name", "ctx", "base",
    "arg_names", "scopes", "comps",
)
UNIT_FACTS = ("file", "status", "id", "scopes", "ast_type", "name", "code")


def node_kind(ast_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_MAP.items() for x in pair])
    return F.coalesce(table[ast_type], F.lit(DEFAULT_KIND))


def type_attrs(hint: Column) -> Column:
    """MAP with DataType and, for X[Y], ContainerType; empty without a hint."""
    bracket = F.contains(hint, F.lit("[")) & F.endswith(hint, F.lit("]"))
    container = F.trim(F.substring_index(hint, "[", 1))
    rest = F.substring(hint, F.instr(hint, "[") + 1, F.length(hint))
    inner = F.trim(F.substring(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0))))
    split = F.create_map(F.lit("DataType"), inner, F.lit("ContainerType"), container)
    plain = F.create_map(F.lit("DataType"), hint)
    empty = F.create_map().cast("map<string,string>")
    return F.when(bracket & (container != ""), split).when(hint.isNotNull(), plain).otherwise(empty)


def span_struct() -> Column:
    return F.struct("sl", "sc", "el", "ec")


def parsed(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("status") == "ok")


def graph_nodes(facts: DataFrame) -> DataFrame:
    """Nodes without rule matches; keyed by (file, id)."""
    return parsed(facts).select(
        "file", "id", node_kind(F.col("ast_type")).alias("kind"), span_struct().alias("span"), "code",
        F.col("name").alias("symbol"), F.col("hint").alias("type_hint"),
        F.array().cast("array<string>").alias("flags"), type_attrs(F.col("hint")).alias("attrs"),
    )


def _edge(src: Column, dst: Column, kind: str) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))


def _row_edges(facts: DataFrame, ast: bool, control: bool) -> DataFrame:
    """The edges a fact row implies on its own."""
    parent, me = F.col("parent"), F.col("id")
    kind, field, ord_ = F.col("parent_type"), F.col("field"), F.col("ord")
    down = _edge(parent, me, "CFG")
    out = []
    if ast:
        out.append(F.when(parent.isNotNull(), _edge(parent, me, "AST")))
    if control:
        enters = (
            ((kind == "If") & field.isin("body", "orelse") & (ord_ == 0))
            | (kind.isin(*LOOPS) & (field == "body") & (ord_ == 0))
            | ((kind == "Try") & field.isin("body", "finalbody") & (ord_ == 0))
            | ((kind == "Try") & (field == "handlers"))
            | (kind.isin(*WITHS) & (field == "body") & (ord_ == 0))
            | (kind.isin(*ELEMENT_COMPS) & (field == "elt"))
            | ((kind == "DictComp") & (field == "value"))
        )
        loops_back = kind.isin(*LOOPS) & (field == "body") & F.col("last")
        out += [F.when(enters, down), F.when(loops_back, _edge(me, parent, "CFG"))]
    # nulls go after the rows are made: what array_compact() is given would be interpreted
    return inlined(parsed(facts), F.array(*out), "file").where("kind IS NOT NULL")


def syntax_edges(facts: DataFrame) -> DataFrame:
    return _row_edges(facts, ast=True, control=False)


def branch_edges(facts: DataFrame) -> DataFrame:
    """If, loop, try, with and comprehension edges."""
    return _row_edges(facts, ast=False, control=True)


def sequence_edges(facts: DataFrame, by_field: bool = False) -> DataFrame:
    """Each statement from the one before it under the same parent.

    By default all body fields of a parent are one chain; ``by_field`` keeps the fields of a control
    statement apart.
    """
    s = parsed(facts).where(F.col("is_stmt") & F.col("parent").isNotNull())
    chain = [F.col("file"), F.col("parent")]
    if by_field:
        chain.append(F.when(F.col("parent_type").isin(*CONTROL), F.col("field")))
    w = W.partitionBy(*chain).orderBy("id")
    return s.select("file", F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), F.lit("CFG").alias("kind")).where(
        F.col("src").isNotNull()
    )


def _definitions() -> Column:
    is_def = (F.col("ast_type") == "arg") | ((F.col("ast_type") == "Name") & (F.col("ctx") == "Store"))
    return F.when(
        is_def,
        F.array(
            F.struct(
                F.col("name").alias("name"), F.col("id").alias("at"), F.col("id").alias("def"),
                F.lit(None).cast("bigint").alias("target"), F.lit("def").alias("rule"),
                F.lit(0).alias("nth"),
            )
        ),
    )


def _use(name: Column, at: Column, rule: str, nth: Column | None = None) -> Column:
    return F.struct(
        name.alias("name"), at.alias("at"), F.lit(None).cast("bigint").alias("def"), at.alias("target"),
        F.lit(rule).alias("rule"), (F.lit(0) if nth is None else nth).alias("nth"),
    )


def _uses() -> list[Column]:
    kind, me = F.col("ast_type"), F.col("id")
    read = (kind == "Name") & (F.col("ctx") != "Store")
    return [
        F.when(read, F.array(_use(F.col("name"), me, "name"))),
        F.when((kind == "Attribute") & F.col("base").isNotNull(), F.array(_use(F.col("base"), me, "attribute"))),
        F.when(kind == "Call", F.transform("arg_names", lambda n, i: _use(n, me, "argument", i))),
        F.when((kind == "Call") & F.col("base").isNotNull(), F.array(_use(F.col("base"), me, "receiver"))),
        F.when(read, F.transform("comps", lambda c, i: _use(F.col("name"), c, "comprehension", i))),
    ]


def resolved_uses(facts: DataFrame) -> DataFrame:
    """file, rule, target, def: every use of a name with the definition it sees.

    A use looks through its function scopes from the inside; within a scope the latest definition
    before it counts.  Definitions and uses share one as-of window, so work is linear in the rows.
    """
    p = parsed(facts).where(F.col("ast_type").isin("arg", "Name", "Attribute", "Call"))
    empty = "array<struct<name:string,at:bigint,def:bigint,target:bigint,rule:string,nth:int>>"
    records = F.flatten(
        F.array(*[F.coalesce(r, F.array().cast(empty)) for r in (_definitions(), *_uses())])
    )
    r = inlined(p, records, "file", F.col("id").alias("row"), "scopes")
    # a definition lives in its innermost scope, a use is asked in each scope around it
    r = r.select("file", "row", "name", "at", "def", "target", "rule", "nth", F.size("scopes").alias("_n"), F.posexplode("scopes").alias("depth", "scope"))
    r = r.where((F.col("rule") != "def") | (F.col("depth") == F.col("_n") - 1)).drop("_n")
    r = r.withColumn("_digest", F.xxhash64("file", "name", "scope"))  # rows are sorted by a number first, as paths begin alike
    w = W.partitionBy("_digest", "file", "name", "scope").orderBy("at", F.col("def").isNotNull())
    seen = r.withColumn("seen", F.last("def", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    uses = seen.where((F.col("rule") != "def") & F.col("seen").isNotNull())
    return (
        uses.groupBy("file", "row", "rule", "nth", "target")
        .agg(F.max_by("seen", "depth").alias("def"))
        .select("file", "rule", "target", "def")
    )


def flow_edges(facts: DataFrame) -> DataFrame:
    """Data-flow edges, one per use."""
    return resolved_uses(facts).select(
        "file", F.col("def").alias("src"), F.col("target").alias("dst"), F.lit("DFG").alias("kind")
    )


def graph_edges(facts: DataFrame, by_field: bool = False) -> DataFrame:
    """All static edges.  Materialise ``facts`` first: they feed three branches."""
    local = _row_edges(facts, ast=True, control=True)
    out = local.unionByName(sequence_edges(facts, by_field)).unionByName(flow_edges(facts))
    return out.withColumn("attrs", F.lit(None).cast("map<string,string>"))


def value_edges(facts: DataFrame) -> DataFrame:
    """How a value moves inside a statement: from an expression to what encloses it, and from an
    assigning statement to its targets."""
    target = F.col("field").isin("targets", "target", "items.optional_vars")
    up = ~F.col("is_stmt") & ~target & ~F.col("ast_type").isin("arg", "alias", "ExceptHandler")
    rows = parsed(facts).where(F.col("parent").isNotNull() & (target | up))
    return rows.select(
        "file", F.when(target, F.col("parent")).otherwise(F.col("id")).alias("src"),
        F.when(target, F.col("id")).otherwise(F.col("parent")).alias("dst"), F.lit("VALUE").alias("kind"),
    )


def id_shifts(nodes: DataFrame) -> DataFrame:
    """(file, shift): what to add to a file's ids so that ids are unique in the repository.

    Files follow each other in the order of their path digest; a file's shift is the running sum of
    (largest id + 1) before it.  The digest's first digits are the buckets of that running sum.
    """
    per_file = nodes.groupBy("file").agg((F.max("id") + 1).alias("width"))
    keyed, bucket = by_digest(per_file.withColumn("_sha", F.sha2("file", 256)), "_sha")
    summed = running_sums(keyed, ["_sha"], bucket, {"_upto": F.col("width")})
    return summed.select("file", (F.col("_upto") - F.col("width")).alias("shift"))


def merged_ids(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File graphs as one repository graph with unique ids."""
    shift = id_shifts(nodes)
    n = nodes.join(shift, "file").withColumn("id", F.col("id") + F.col("shift")).drop("shift")
    e = edges.join(shift, "file")
    e = e.withColumn("src", F.col("src") + F.col("shift")).withColumn("dst", F.col("dst") + F.col("shift"))
    return n, e.drop("shift")


# Top-level modules told apart in the import inventory.
STANDARD_MODULES = [
    "collections", "typing", "json", "pathlib", "argparse", "sys", "os", "tempfile", "subprocess",
    "random", "math", "itertools", "functools", "dataclasses", "enum", "abc", "copy", "datetime",
    "time", "warnings", "traceback", "inspect", "glob", "re", "hashlib", "base64", "urllib",
]
THIRD_PARTY_MODULES = [
    "torch", "numpy", "sklearn", "transformers", "tqdm", "torch_geometric", "torch_geometric.nn",
    "torch_geometric.data", "torch_geometric.utils",
]


def import_inventory(facts: DataFrame) -> DataFrame:
    """file, module, origin ('standard', 'third_party', 'local') and the imported paths' count."""
    named = F.filter("imports", lambda i: i["module"].isNotNull())
    rows = parsed(facts).where(F.col("imports").isNotNull()).select("file", F.explode(F.transform(named, lambda i: i["module"])).alias("path"))
    top = F.substring_index("path", ".", 1)
    origin = (
        F.when(top.isin(*STANDARD_MODULES), "standard")
        .when(top.isin(*THIRD_PARTY_MODULES), "third_party")
        .otherwise("local")
    )
    return rows.groupBy("file", top.alias("module"), origin.alias("origin")).agg(
        F.countDistinct("path").alias("paths")
    )


def missing_imports(files: DataFrame) -> DataFrame:
    """file, issue for names that are used while nothing imports them."""
    code = F.col("code")

    def has(*words):
        return contains_any(code, list(words))

    issues = F.array_compact(
        F.array(
            F.when(
                has("Counter(") & ~has("from collections import Counter", "import collections"),
                "Counter is used but not imported",
            ),
            F.when(
                has("f1_score", "precision_score", "recall_score")
                & ~has("from sklearn.metrics import", "import sklearn"),
                "sklearn.metrics functions used but not imported",
            ),
            F.when(
                has("random.") & ~has("random_split") & ~has("import random", "from random"),
                "random module used but not imported",
            ),
        )
    )
    return files.select("file", F.explode(issues).alias("issue"))


def duplicate_imports(files: DataFrame) -> DataFrame:
    """file, line, statement for each import line that repeats an earlier one of the same file."""
    lines = files.select("file", F.posexplode(F.split("code", "\n", -1)).alias("i", "raw"))
    text = F.trim(F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    imports = lines.select("file", (F.col("i") + 1).alias("line"), text.alias("statement")).where(
        F.startswith(F.col("statement"), F.lit("import ")) | F.startswith(F.col("statement"), F.lit("from "))
    )
    first = imports.groupBy("file", "statement").agg(F.min("line").alias("first_line"))
    # min() above is combined before the shuffle, and the repeated lines join back to one row each
    return (
        imports.join(first, ["file", "statement"])
        .where(F.col("line") > F.col("first_line"))
        .select("file", "line", F.left("statement", F.lit(50)).alias("statement"))
    )


def unguarded_endpoints(facts: DataFrame, endpoint: dict, auth: list[str]) -> DataFrame:
    """Functions with an endpoint decorator and no known authentication decorator."""
    plain = F.transform("decorators", lambda d: F.substring_index(d, "(", 1))
    marks = [m for names in endpoint.values() for m in names]
    rows = parsed(facts).where(F.col("decorators").isNotNull()).withColumn("_plain", plain)
    return rows.where(
        F.arrays_overlap("_plain", F.array(*[F.lit(m) for m in marks]))
        & ~F.arrays_overlap("_plain", F.array(*[F.lit(a) for a in auth]))
    ).select("file", "id", F.col("name").alias("symbol"), F.col("sl").alias("line"))


def function_units(facts: DataFrame) -> DataFrame:
    """Every positioned node with its innermost enclosing function (0 = module level)."""
    return parsed(facts).select(
        "file", "id", F.element_at("scopes", -1).alias("function_id"), "ast_type", "name", "code"
    )


def normalised_names(facts: DataFrame) -> DataFrame:
    """Names and arguments per function renamed v1, v2, ... in the order they first appear.

    Facts are read once: a name's first place and the place's rank are windows over the same rows, dealt by function.
    """
    named = function_units(facts).where(F.col("ast_type").isin("Name", "arg"))
    key = ["file", "function_id"]
    named = named.select("id", *key, "name", F.xxhash64(*key).alias("_unit"), F.xxhash64(*key, "name").alias("_digest")).repartition(*key)
    first = named.withColumn("_first", F.min("id").over(W.partitionBy("_digest", *key, "name")))
    rank = F.dense_rank().over(W.partitionBy("_unit", *key).orderBy("_first", "name"))
    out = first.select("file", "id", "function_id", "name", F.concat(F.lit("v"), rank).alias("normal_name"))
    return out.where("file IS NOT NULL AND function_id IS NOT NULL AND name IS NOT NULL")
