"""Runtime taint: positions to nodes, records to flow edges, and correlation of raw events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ordered import by_value, latest_before, seconds
from codeloom.session import cut_lineage, grown

# Lines and columns of the smallest cells, and how often a cell doubles.
LINES_PER_BLOCK = 16
COLUMNS_PER_BLOCK = 64
LEVELS = 16

# Which node kinds a position prefers, by role (first choice, second choice).
KIND_CHOICES = {
    "sink": (
        ["Call", "Attribute", "Subscript", "Await"],
        ["Name", "Literal", "ListComp", "DictComp", "Generator", "AsyncFor"],
    ),
    "source": (
        ["Name", "Attribute", "Subscript"],
        ["Call", "Literal", "ListComp", "DictComp", "Generator"],
    ),
    "path": (
        ["Call", "Attribute", "Subscript", "Await", "Name"],
        ["Literal", "ListComp", "DictComp", "Generator"],
    ),
}


def kind_priority(role: Column, kind: Column) -> Column:
    """0 first choice, 1 second choice, 2 other, 3 generic statement."""
    general = F.when(kind == "Stmt", 3).otherwise(2)
    out = None
    for name, (first, second) in KIND_CHOICES.items():
        p = F.when(kind.isin(*first), 0).when(kind.isin(*second), 1).otherwise(general)
        out = F.when(role == name, p) if out is None else out.when(role == name, p)
    return out


def covers(span: Column, line: Column, col: Column) -> Column:
    """The span holds the position; without a column the line decides; the end column counts."""
    in_lines = line.between(span["sl"], span["el"])
    starts = (line != span["sl"]) | (col >= span["sc"])
    ends = (line != span["el"]) | (col <= span["ec"])
    return in_lines & (col.isNull() | (starts & ends))


def positions_of(records: DataFrame) -> DataFrame:
    """record, role, step, file, line, col: every position of every record, one row each."""
    def one(role, step, p):
        return F.struct(
            F.lit(role).alias("role"), step.alias("step"), p["file"].alias("file"), p["line"].alias("line"),
            p["col"].alias("col"),
        )

    n = F.coalesce(F.size("path"), F.lit(0))
    steps = F.coalesce(
        F.transform("path", lambda p, i: one("path", i + 1, p)),
        F.array().cast("array<struct<role:string,step:int,file:string,line:int,col:int>>"),
    )
    every = F.concat(
        F.array(one("source", F.lit(0), F.col("source"))), steps, F.array(one("sink", n + 1, F.col("sink")))
    )
    return records.select("record", F.inline(every))


def dyadic_cover(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """ARRAY of (level, cell): aligned cells of 1, 2, 4, ... that together make up first..last, at most two of a level.

    Only beyond ``2 ** levels`` the number grows with the length.
    """
    cells = []
    for k in range(levels):
        low = F.shiftright(first + F.lit(2**k - 1).cast("bigint"), k)
        high = F.shiftright(last + 1, k)
        some = low < high
        cells.append(F.when(some & (low % 2 == 1), F.struct(F.lit(k).alias("level"), low.alias("cell"))))
        cells.append(F.when(some & (high % 2 == 1), F.struct(F.lit(k).alias("level"), (high - 1).alias("cell"))))
    single = F.array(F.struct(F.lit(0).alias("level"), first.alias("cell")))
    low, high = F.shiftright(first + F.lit(2**levels - 1).cast("bigint"), levels), F.shiftright(last + 1, levels)
    top = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda c: F.struct(F.lit(levels).alias("level"), c.alias("cell"))))
    none = F.array().cast("array<struct<level:int,cell:bigint>>")
    return F.when(first == last, single).otherwise(F.concat(F.array_compact(F.array(*cells)), F.coalesce(top, none)))


def dyadic_cells(at: Column, levels: list[int] | None = None) -> Column:
    """ARRAY of (level, cell): the cell of each level that holds a place; one of them is in the cover of each run that holds it."""
    asked = range(LEVELS + 1) if levels is None else levels
    if not asked:
        return F.array().cast("array<struct<level:int,cell:bigint>>")
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("cell")) for k in asked])


def _places(cells: Column, line: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(line.alias("_line"), c["level"].alias("_level"), c["cell"].alias("_cell")))


def _span_cells(lines: int, columns: int) -> Column:
    """The cells that cover a span: of blocks of lines or, within one line, of blocks of columns and the line as a whole."""
    s, block = F.col("span"), lambda x, n: F.floor(x / n).cast("bigint")
    several = _places(dyadic_cover(block(s["sl"], lines), block(s["el"], lines)), F.lit(-1).cast("bigint"))
    one = _places(dyadic_cover(block(s["sc"], columns), block(F.greatest(s["ec"], s["sc"]), columns)), s["sl"].cast("bigint"))
    whole = F.struct(s["sl"].cast("bigint").alias("_line"), F.lit(-1).alias("_level"), F.lit(-1).cast("bigint").alias("_cell"))
    return F.when(s["sl"] != s["el"], several).otherwise(F.concat(one, F.array(whole)))


def _spans_by_cell(nodes: DataFrame, lines: int, columns: int) -> DataFrame:
    """Spans with the cells that cover them.

    Of the nodes with the same kind and span only the first is kept, as no other can win.
    """
    first = nodes.where(F.col("span").isNotNull()).groupBy("file", "kind", "span").agg(F.min("id").alias("id"))
    return first.select("file", "id", "kind", "span", F.inline(_span_cells(lines, columns)))


def _levels_in_use(nodes: DataFrame, lines: int, columns: int) -> tuple[list[int], list[int]]:
    """The levels that hold a span's cell, of lines and of columns: at most ``LEVELS`` + 1 each."""
    spans = nodes.where(F.col("span").isNotNull()).select(F.explode(_span_cells(lines, columns)).alias("c"))
    found = spans.select((F.col("c._line") == -1).alias("lines"), F.col("c._level").alias("level")).distinct().collect()
    of = lambda lines: sorted(r["level"] for r in found if r["lines"] is lines and r["level"] >= 0)
    return of(True), of(False)


def node_at_position(
    positions: DataFrame, nodes: DataFrame, lines: int = LINES_PER_BLOCK, columns: int = COLUMNS_PER_BLOCK
) -> DataFrame:
    """file, line, col, role, id: the best covering node per distinct position.

    A range join made equal: a span becomes the few aligned cells of doubling size that make it up, and a
    position asks its own cell of each size, so a module of a million lines is some forty rows and not one per block.  Spans of several lines are
    cut by lines, spans within a line by columns, so a file of one long line is cut as well.  A position asks only the sizes
    that some span has, found in one pass over the nodes, which should be written.  Positions are
    made distinct first, so a place hit by most records is looked up once.
    The best node is a combined minimum, not a sorted group.
    """
    want = positions.where(F.col("file").isNotNull() & F.col("line").isNotNull()).select(
        "file", "line", "col", "role"
    ).distinct()
    # nodes of files that nobody asks for are not cut into cells
    nodes = cut_lineage(nodes.select("file", "id", "kind", "span").join(grown(want.select("file").distinct()), "file", "left_semi"))
    by_line, by_column = _levels_in_use(nodes, lines, columns)
    in_line = _places(dyadic_cells(F.floor(F.col("col") / columns).cast("bigint"), by_column), F.col("line").cast("bigint"))
    whole = F.array(F.struct(F.col("line").cast("bigint").alias("_line"), F.lit(-1).alias("_level"), F.lit(-1).cast("bigint").alias("_cell")))
    over_lines = _places(dyadic_cells(F.floor(F.col("line") / lines).cast("bigint"), by_line), F.lit(-1).cast("bigint"))
    asks = F.concat(over_lines, F.when(F.col("col").isNull(), whole).otherwise(in_line))
    hit = want.select("*", F.inline(asks)).join(grown(_spans_by_cell(nodes, lines, columns)), ["file", "_line", "_level", "_cell"])
    s = F.col("span")
    hit = hit.where(covers(s, F.col("line"), F.col("col")))
    order = F.struct(
        kind_priority(F.col("role"), F.col("kind")).alias("p"), (s["el"] - s["sl"]).alias("dl"),
        (s["ec"] - s["sc"]).alias("dc"), F.col("id").alias("i"),
    )
    return hit.groupBy("file", "line", "col", "role").agg(F.min_by("id", order).alias("id"))


def record_positions(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Positions of all records with their node id; positions without a node are left out."""
    pos = positions_of(records)
    found = node_at_position(pos, nodes)
    same = (
        (F.col("p.file") == F.col("n.file")) & (F.col("p.line") == F.col("n.line"))
        & (F.col("p.role") == F.col("n.role")) & F.col("p.col").eqNullSafe(F.col("n.col"))
    )
    return pos.alias("p").join(grown(found.alias("n")), same).select("p.*", "n.id")


def mapped_records(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """record, source_id, sink_id, path_ids, meta; the group of a record is its own path."""
    at = record_positions(records, nodes)
    ids = at.groupBy("record").agg(
        F.max(F.when(F.col("role") == "source", F.col("id"))).alias("source_id"),
        F.max(F.when(F.col("role") == "sink", F.col("id"))).alias("sink_id"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == "path", F.struct("step", "id")))), lambda x: x["id"]
        ).alias("path_ids"),
    )
    empty = F.array().cast("array<bigint>")
    return records.select("record", F.col("source.file").alias("file"), "meta").join(grown(ids), "record", "left").select(
        "record", "file", "source_id", "sink_id", F.coalesce("path_ids", empty).alias("path_ids"), "meta"
    )


def recorded_flow_edges(mapped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """DDFG edges along source, path and sink.

    Records without both ends give none; an edge named by several records keeps the first one's
    attributes; edges that exist already are left out.
    """
    full = mapped.where(F.col("source_id").isNotNull() & F.col("sink_id").isNotNull())
    seq = F.concat(F.array("source_id"), F.col("path_ids"), F.array("sink_id"))
    hops = F.zip_with(
        F.slice(F.col("seq"), F.lit(1), F.size("seq") - 1), F.slice(F.col("seq"), F.lit(2), F.size("seq") - 1),
        lambda a, b: F.struct(a.alias("src"), b.alias("dst")),
    )
    meta = F.when(F.size("meta") > 0, F.col("meta"))
    e = full.withColumn("seq", seq).select("file", "record", meta.alias("meta"), F.inline(hops))
    e = e.groupBy("file", "src", "dst").agg(F.min_by(F.struct("meta"), "record").alias("first"))
    e = e.select("file", "src", "dst", F.lit("DDFG").alias("kind"), F.col("first.meta").alias("attrs"))
    return e if existing is None else new_edges(e, existing)


def new_edges(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (file, src, dst, kind) is not there yet."""
    key = ["file", "src", "dst", "kind"]
    return candidates.join(grown(existing.select(*key)), key, "left_anti")


def recorded_edge_counts(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "DDFG").groupBy("file").agg(F.count(F.lit(1)).alias("ddfg_edges"))


def graphs_with_records(graphs: DataFrame, records: DataFrame) -> DataFrame:
    """Graphs named by the source of a record."""
    files = records.select(F.col("source.file").alias("file"))
    return graphs.join(files, "file", "left_semi")


def first_record_per_file(records: DataFrame) -> DataFrame:
    """file, record: the earliest record of each source file, combined before the shuffle."""
    return records.groupBy(F.col("source.file").alias("file")).agg(F.min("record").alias("record"))


def tainted_calls(
    marks: DataFrame, arguments: DataFrame, objects: list[str], time: str = "ts",
    limits: list[float] | None = None,
) -> DataFrame:
    """Source-to-sink records from raw runtime events.

    ``marks`` (objects..., ts, source) say when an object was tainted, ``arguments`` (objects..., ts,
    call_id, arg_pos, sink, sink_type) which objects a sink call received.  An argument is tainted by
    the latest mark at or before the call; the first tainted argument of a call makes the record.
    Time buckets keep an object with most of the events from becoming one task.
    """
    source_type = marks.schema["source"].dataType
    both = marks.select(*objects, time, "source", F.lit(0).alias("_use")).unionByName(
        arguments.select(*objects, time, "call_id", "arg_pos", "sink", "sink_type",
                         F.lit(None).cast(source_type).alias("source"), F.lit(1).alias("_use")),
        allowMissingColumns=True,
    )
    both = both.withColumn("_t", seconds(both, time))
    both, slot = by_value(both, "_t", "_slot", limits)
    seen = latest_before(both, objects, [time, "_use"], "source", slot, "origin")
    hits = seen.where((F.col("_use") == 1) & F.col("origin").isNotNull())
    return (
        hits.groupBy("call_id")
        .agg(F.min_by(F.struct("origin", "sink", "sink_type", time), "arg_pos").alias("h"))
        .select(
            "call_id", F.col("h.origin").alias("source"), F.col("h.sink").alias("sink"),
            F.create_map(
                F.lit("taint_kind"), F.lit("user_input"), F.lit("sink_type"), F.col("h.sink_type")
            ).alias("meta"),
            F.col(f"h.{time}").alias(time),
        )
    )


def flows_or_predicted(recorded: DataFrame, predicted: DataFrame) -> DataFrame:
    """Recorded flows, and predicted ones for files without any recorded flow."""
    missing = predicted.join(recorded.select("file"), "file", "left_anti")
    return recorded.withColumn("origin", F.lit("recorded")).unionByName(
        missing.withColumn("origin", F.lit("predicted")), allowMissingColumns=True
    )
