"""The best source-sink pairs under any monotone scorer, without forming all pairs.

Nodes of a group are ordered along a space-filling curve of their parts and cut into blocks of blocks.  From the whole group
down, a pair of blocks is kept only if the score of its two corners (the largest value of every part) can still come before
the k-th best real pair known so far; corners and known pairs get closer with every level, and at the last level the
corners are the nodes themselves.  The result is exact; a scorer that hardly tells pairs apart makes more of them stay.
"""

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.operators.ordered import by_value, number_rows
from codeloom.session import cut_lineage, drop_tables

Scorer = Callable[[dict[str, Column], dict[str, Column]], Column]

# A part is cut where 1/2, 1/4, 1/8 ... of the values lie above: only high values can win.
_TAILS = [1 - 0.5**i for i in range(1, 16)]


def _tails(df: DataFrame, parts: list[str]) -> list[list[float]]:
    """Per part the values that cut off ever smaller shares of the rows, from one aggregate."""
    at = F.array(*[F.lit(x) for x in _TAILS])
    found = []
    for p in parts:
        sketch = F.kll_sketch_agg_double(p, 4096)
        found.append(F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, at)).alias(p))
    row = df.agg(*found).first()
    return [sorted(set(row[p] or ())) for p in parts]


def _ordered(nodes: DataFrame, group: str, parts: list[str]) -> DataFrame:
    """(g, block, hi, id, low): each node as a block of one, numbered in its group along the curve."""
    rows = nodes.select(F.col(group).alias("g"), "id", *[(F.col(p).cast("double") + 0.0).alias(p) for p in parts])
    usable = reduce(lambda a, b: a & b, [F.col(p).isNotNull() & ~F.isnan(p) for p in parts])
    rows = rows.where(usable & F.col("g").isNotNull() & F.col("id").isNotNull())
    placed = rows
    curved = parts[:12]  # twelve parts of four bits fit a DOUBLE; blocks need no more to be close
    for i, limits in enumerate(_tails(rows, curved)):
        placed, _ = by_value(placed, curved[i], f"_c{i}", limits=limits)
    bits = [F.shiftleft(F.getbit(F.col(f"_c{i}"), F.lit(b)).cast("long"), b * len(curved) + i) for b in range(4) for i in range(len(curved))]
    placed = placed.select(*rows.columns, (-reduce(lambda a, b: a + b, bits)).cast("double").alias("_z"))
    cut, bucket = by_value(placed, "_z", tie="id")
    numbered = number_rows(cut, [F.col("_z"), F.col("id")], bucket, ["g"], "_rn")
    hi = F.struct(*parts)
    return numbered.select("g", (F.col("_rn") - 1).alias("block"), hi.alias("hi"), F.struct("id", hi.alias("at")).alias("node"), F.col("id").alias("low"))


def _coarser(blocks: DataFrame, parts: list[str], fan: int) -> DataFrame:
    """Blocks of ``fan`` blocks: their corner, their node with the largest parts and their smallest id."""
    total = reduce(lambda a, b: a + b, [F.col(f"node.at.{p}") for p in parts])
    return blocks.groupBy("g", F.floor(F.col("block") / fan).alias("block")).agg(
        F.struct(*[F.max(f"hi.{p}").alias(p) for p in parts]).alias("hi"),
        F.max_by("node", F.struct(total, F.col("node.id"))).alias("node"), F.min("low").alias("low"),
    )


def _side(blocks: DataFrame, name: str, fan: int) -> DataFrame:
    return blocks.select(
        F.col("g").alias(f"{name}_g"), F.floor(F.col("block") / fan).alias(f"{name}_up"), F.col("block").alias(f"{name}_block"),
        F.col("hi").alias(f"{name}_hi"), F.col("node").alias(f"{name}_node"), F.col("low").alias(f"{name}_low"),
    )


def best_pairs(
    sources: DataFrame, sinks: DataFrame, k: int, score: Scorer, source_parts: list[str], sink_parts: list[str],
    group: str = "file", fan: int = 8,
) -> DataFrame:
    """group, source_id, sink_id, score, rank: the k best pairs of different nodes per group; ties by source, then sink.

    ``score`` maps the parts of a source and of a sink (columns by name) to a DOUBLE column, a UDF if need be, that never falls
    when a part grows.  Nodes with a null or NaN part, id or group take no part; ids are unique per side and group.  A group without a pair has no row.
    """
    name = sources.schema[group].dataType
    corner = {"source": source_parts, "sink": sink_parts}
    levels = {"source": [cut_lineage(_ordered(sources, group, source_parts))], "sink": [cut_lineage(_ordered(sinks, group, sink_parts))]}
    size = max(rows[0].agg(F.max("block")).first()[0] or 0 for rows in levels.values()) + 1
    depth = max(1, math.ceil(math.log(size, fan)) + (1 if fan ** math.ceil(math.log(size, fan)) < size else 0))
    for side, rows in levels.items():
        for _ in range(depth):
            rows.append(cut_lineage(_coarser(rows[-1], corner[side], fan)))

    def scored(which: str) -> Column:
        sides = [{p: F.col(f"{s}_{which}.{p}") for p in corner[s]} for s in ("source", "sink")]
        return score(*sides).cast("double")

    def place(value: Column, a: Column, b: Column) -> Column:
        """Orders pairs: a better one is the smaller struct."""
        return F.struct((-value + 0.0).alias("down"), a.alias("source_id"), b.alias("sink_id"))

    pairs = levels["source"][depth].select("g", F.col("block").alias("source_up")).join(
        levels["sink"][depth].select("g", F.col("block").alias("sink_up")), "g"
    )
    limit, written = None, None
    for level in range(depth - 1, -1, -1):
        s, t = _side(levels["source"][level], "source", fan), _side(levels["sink"][level], "sink", fan)
        near = pairs.join(s, (F.col("g") == F.col("source_g")) & (pairs["source_up"] == s["source_up"])).drop(s["source_up"])
        near = near.join(t, (F.col("g") == F.col("sink_g")) & (near["sink_up"] == t["sink_up"])).drop(t["sink_up"])
        real = F.when(F.col("source_node.id") != F.col("sink_node.id"), place(scored("at_s"), F.col("source_node.id"), F.col("sink_node.id")))
        near = near.withColumns({"source_at_s": F.col("source_node.at"), "sink_at_s": F.col("sink_node.at")})
        near = near.select(
            "g", F.col("source_block").alias("source_up"), F.col("sink_block").alias("sink_up"),
            place(scored("hi"), F.col("source_low"), F.col("sink_low")).alias("bound"), real.alias("real"), *(["limit"] if limit is not None else []),
        )
        if limit is not None:
            near = near.where(F.col("limit").isNull() | (F.col("bound") <= F.col("limit"))).drop("limit")
        step = cut_lineage(near.where("real IS NOT NULL") if level == 0 else near)
        rank = F.row_number().over(W.partitionBy("g").orderBy("real"))
        best = step.where("real IS NOT NULL").select("g", "real", rank.alias("rank")).where(F.col("rank") <= k)
        if level == 0:
            out = best.select(
                F.col("g").cast(name).alias(group), "real.source_id", "real.sink_id", (-F.col("real.down") + 0.0).alias("score"), "rank"
            )
            out = cut_lineage(out)
        else:
            limit = cut_lineage(best.where(F.col("rank") == k).select("g", F.col("real").alias("limit")))
            pairs = step.join(limit, "g", "left").where(F.col("limit").isNull() | (F.col("bound") <= F.col("limit")))
            pairs = pairs.select("g", "source_up", "sink_up", "limit")
        if written:
            drop_tables(*written)
        written = (step,) if limit is None else (step, limit)
    drop_tables(*written, *levels["source"], *levels["sink"])
    return out
