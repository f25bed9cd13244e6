"""Trie of conversation prefixes and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns.  It is named by its smallest member and its depth, so the nodes above it are the
prefixes of that one conversation: a path to the root is a range of rows and never has to be walked.
"""

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch
from codeloom.operators.ordered import by_value, number_rows

# Turns of a conversation per window, ids per packed list, nodes per component that a task finishes.
STRETCH, PACK, PART = 1 << 12, 1 << 9, 1 << 12


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, role, text): turns from 1 on by turn (null first), then role and text; null role or text is empty.

    Rows without a conv_id belong to no conversation.  A conversation that holds most rows is numbered in several tasks.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows, bucket = by_value(rows.withColumn("place", F.col("turn").cast("double")), "place")
    rows = number_rows(rows, [F.col("turn").asc_nulls_first(), "role", "text"], bucket, ["conv_id"], "i")
    return rows.select("conv_id", "i", "role", "text")


def shared_beginnings(turns: DataFrame, scratch: Scratch, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like their family's first one: (conv_id, d, role, text, length) and (conv_id, length).

    The first h turns of conversation c - c % ``family`` (all if fewer, none if absent) replace the first h of c; h is the CRC-32 of c in
    decimal, modulo ``most``.
    """
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % most).alias("h"), (c - c % family).alias("first"))
    begin = F.least("h", F.coalesce("first_n", F.lit(0)))
    convs = convs.join(convs.select(c.alias("first"), F.col("n").alias("first_n")), "first", "left").withColumn("begin", begin)
    convs = scratch.cut(convs.withColumn("length", F.col("begin") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    own = turns.join(convs.select("conv_id", "h", "begin", "length"), "conv_id").filter("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("begin")).alias("d"), "role", "text", "length")
    lead = turns.filter(F.col("i") < most).withColumnRenamed("conv_id", "first")
    lead = lead.join(convs.filter("begin > 0").select("conv_id", "first", "begin", "length"), "first").filter("i <= begin")
    return own.unionByName(lead.select("conv_id", F.col("i").alias("d"), "role", "text", "length")), convs.select("conv_id", "length")


def prefix_trie(rows: DataFrame, convs: DataFrame, part: int = PART, scratch: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, d, role, text, length) and ``convs`` (conv_id, length).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the textless root), n_convs, n_children, n_leaves (childless
    nodes of the subtree, its top included), saved_tokens (over the subtree: members but one, times code points of the last text),
    chars (of the last text) and ends_sha256 (of the ids that end at the node, ascending, comma-joined).  Every conversation is a member
    of the root, also one without turns; no conversations, no nodes.

    A prefix is known by two XOR sums of 60 digest bits of each turn and its place, so that a conversation of any length is handled in
    stretches.  Sums over subtrees come from ``subtree_sums``.
    """
    scratch = scratch or Scratch(rows.sparkSession, "trie")
    mark = F.md5(F.concat_ws("|", "d", F.length("role"), "role", "text").cast("binary"))
    bits = [F.conv(F.substring("mark", at, 15), 16, 10).cast("long").alias(n) for n, at in (("a", 1), ("b", 17))]
    marked = rows.select("conv_id", "d", "length", F.length("text").cast("long").alias("chars"), mark.alias("mark"))
    marked = marked.select("conv_id", "d", "length", "chars", *bits, F.shiftright("d", STRETCH.bit_length() - 1).alias("stretch"))
    marked = scratch.cut(marked, "marks")
    inside = W.partitionBy("conv_id", "stretch").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = marked.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = before.select("conv_id", "stretch", *[F.bit_xor(n).over(earlier).alias(f"before_{n}") for n in "ab"]).filter("before_a is not null")
    keyed = marked.select("*", *[F.bit_xor(n).over(inside).alias(f"in_{n}") for n in "ab"]).join(before, ["conv_id", "stretch"], "left")
    upto = {n: F.col(f"in_{n}").bitwiseXOR(F.coalesce(f"before_{n}", F.lit(0))) for n in "ab"}
    keyed = keyed.select("conv_id", "d", "length", "chars", *[k.alias(f"k{n}") for n, k in upto.items()], *[k.bitwiseXOR(F.col(n)).alias(f"p{n}") for n, k in upto.items()])
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("d"), "length", zero.alias("chars"), zero.alias("ka"), zero.alias("kb"), null.alias("pa"), null.alias("pb"))
    keyed = scratch.cut(keyed.withColumn("d", F.col("d").cast("long")).unionByName(root.withColumn("length", F.col("length").cast("long"))), "prefixes")

    # A node's weight, its members' turns from here on, is what its subtree's nodes count together, a node for each of its members.
    named = keyed.groupBy("d", "ka", "kb").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("d") + 1).alias("weight"),
        F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    named = scratch.cut(named, "named")
    above = named.select((F.col("d") + 1).alias("d"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("node").alias("up"))
    nodes = scratch.cut(named.join(above, ["d", "pa", "pb"], "left").drop("pa", "pb"), "nodes")
    paths = scratch.cut(keyed.select("conv_id", "d", "length", "ka", "kb").join(nodes.select("d", "ka", "kb", "node", "up"), ["d", "ka", "kb"]), "paths")
    children = nodes.filter("d > 0").groupBy(F.col("up").alias("node"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    tree = nodes.select("node", F.col("d").alias("depth"), "up", "n_convs", "chars", "weight", saved.alias("saved"))
    tree = tree.join(children.withColumnRenamed("d", "depth"), ["node", "depth"], "left").fillna(0, ["n_children"])
    tree = scratch.cut(tree.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "tree")
    scratch.drop(marked, keyed, named, nodes)
    steps = paths.select("conv_id", F.col("d").alias("depth"), "node", "up")
    sums = subtree_sums(tree.select("node", "depth", "up", "weight", "leaf", "saved"), steps, ["leaf", "saved"], part, scratch)
    out = tree.join(sums.withColumnsRenamed({"leaf": "n_leaves", "saved": "saved_tokens"}), ["node", "depth"])
    out = out.join(_ends(paths.filter("d = length").select("node", F.col("d").alias("depth"), "conv_id")), ["node", "depth"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        ends.alias("ends_sha256"), "chars",
    )


def _ends(last: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): ids are packed into bounded lists where they are, a node's lists are digested as they come."""
    packed = last.groupBy("node", "depth", F.shiftright("conv_id", PACK.bit_length() - 1).alias("pack")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    packed = packed.select("node", "depth", "pack", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return packed.repartition("node", "depth").sortWithinPartitions("node", "depth", "pack").mapInArrow(_digests, "node long, depth long, ends_sha256 string")


def _digests(batches):
    def row(key, state):
        cols = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(cols, names=["node", "depth", "ends_sha256"])

    at, state, done = None, None, []
    for batch in batches:
        for key, ids in zip(zip(*[batch.column(i).to_pylist() for i in (0, 1)], strict=True), batch.column(3).to_pylist(), strict=True):
            if key == at:
                state.update(b",")
            else:
                if at is not None:
                    done.append((at, state))
                at, state = key, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.concat_batches([row(*d) for d in done])
            done = []
    if at is not None:
        yield row(at, state)


# -- sums over subtrees -----------------------------------------------------------------------------------------------


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], part: int = PART, scratch: Scratch | None = None) -> DataFrame:
    """(node, depth, sum of each of ``values`` over the node's subtree) by centroid decomposition of the parent edges.

    ``nodes``: node, depth, up (the parent's node), weight (positive, the sum over the subtree of what each node weighs) and the values;
    ``paths``: conv_id, depth, node, up, the nodes above node c are the rows of conv_id c.

    Every component has a centroid, the deepest node that holds half of its weight or more.  What the component holds in the
    centroid's subtree is summed and added to all nodes from the centroid up to the component's top; then the centroid goes, and the
    rest, of which no component has more than half of the weight, is split in the same way.  Each ancestor and descendant
    are parted by one centroid, on the path between them, so each value arrives once.  Weights above a centroid lose what hangs below,
    so they are never summed anew.  Components over ``part`` nodes are split by joins, all of a level at once, and smaller ones each
    inside one task: the levels are at most the logarithm of the weight, and a task holds ``part`` nodes.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "rollup")
    top = ["top", "top_depth"]
    whole = nodes.filter("up is null").select(F.col("node").alias("top"), F.col("depth").alias("top_depth")).first()
    if whole is None:
        return nodes.select("node", "depth", *values)
    live = nodes.withColumns({t: F.lit(whole[t]) for t in top})
    small, gains, step = [], [], None
    while True:
        sizes = live.groupBy(*top).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("all"))
        large = scratch.cut(sizes.filter(F.col("n") > part).select(*top, "all"), "large")
        if large.isEmpty():
            small.append(live)
            break
        small.append(scratch.cut(live.join(large, top, "left_anti"), "small"))
        rest = live.join(large, top)
        centre = F.max(F.struct("depth", "node", "weight")).alias("c")
        centres = rest.filter(F.col("weight") * 2 >= F.col("all")).groupBy(*top).agg(centre)
        centres = scratch.cut(centres.select(*top, F.col("c.node").alias("c"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centres")
        up = paths.select(F.col("conv_id").alias("c"), "depth", "node")
        up = up.join(centres, "c").filter("depth between top_depth and c_depth").select(*top, "node", "depth", F.col("c_weight").alias("less"))
        up = scratch.cut(up, "up")
        below = paths.select(F.col("conv_id").alias("node"), F.col("depth").alias("at"), F.col("node").alias("at_node"), F.col("up").alias("at_up"))
        parted = rest.drop("all").join(centres, top).withColumn("at", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        parted = parted.join(below, ["node", "at"], "left").join(up.drop(*top), ["node", "depth"], "left")
        inside = F.coalesce(F.col("at_up") == F.col("c"), F.lit(False))
        is_centre = (F.col("node") == F.col("c")) & (F.col("depth") == F.col("c_depth"))
        parted = scratch.cut(parted.select(
            *nodes.columns, *top, "at_node", "c_depth", "less", inside.alias("inside"), is_centre.alias("is_centre"),
        ), "parted")
        totals = parted.filter("inside or is_centre").groupBy(*top).agg(*[F.sum(v).alias(v) for v in values])
        gains.append(scratch.cut(up.join(totals, top).select("node", "depth", *values), "gains"))
        live = parted.filter("not is_centre").select(
            *[c for c in nodes.columns if c != "weight"], (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"),
            F.when(F.col("inside"), F.col("at_node")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("inside"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
        scratch.drop(large, centres, up, *([step] if step is not None else []))
        step = parted
    kinds = ", ".join(f"{c} {t}" for c, t in nodes.select("node", "depth", *values).dtypes)
    for rows in small:
        rows = rows.select("node", "depth", "up", "weight", *top, *values).repartition(*top).sortWithinPartitions(*top, "depth")
        gains.append(rows.mapInArrow(_finished(values), kinds))
    out = gains[0]
    for g in gains[1:]:
        out = out.unionByName(g)
    return out.groupBy("node", "depth").agg(*[F.sum(v).alias(v) for v in values])


def _finished(values: list[str]):
    def run(batches):
        for batch in _whole_components(batches):
            column = [pc.fill_null(batch.column(i), 0).to_numpy() for i in range(4 + 2 + len(values))]
            bounds = np.flatnonzero((np.diff(column[4]) != 0) | (np.diff(column[5]) != 0)) + 1
            sums = [v.copy() for v in column[6:]]
            for a, b in pairwise([0, *bounds.tolist(), batch.num_rows]):
                if b - a > 1:
                    _decompose(*[c[a:b].tolist() for c in column[:4]], [c[a:b].tolist() for c in column[6:]], [s[a:b] for s in sums])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], names=["node", "depth", *values])

    return run


def _whole_components(batches):
    """Batches that end where a component ends; rows come sorted by component."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        top, depth = (batch.column(i).to_numpy() for i in (4, 5))
        if held and [held[0].column(i)[0].as_py() for i in (4, 5)] != [top[0], depth[0]]:
            yield pa.concat_batches(held)
            held = []
        other = np.flatnonzero((top != top[-1]) | (depth != depth[-1]))
        if len(other):
            yield pa.concat_batches([*held, batch.slice(0, int(other[-1]) + 1)])
            held = [batch.slice(int(other[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _decompose(node: list, depth: list, up: list, weight: list, values: list[list], sums: list) -> None:
    """Puts the sums over the subtrees of one component, whose nodes come from the top down, into ``sums``."""
    place = {key: i for i, key in enumerate(zip(node, depth, strict=True))}
    parent = [place.get((u, d - 1), -1) if i else -1 for i, (u, d) in enumerate(zip(up, depth, strict=True))]
    gain = [[0] * len(node) for _ in values]
    stack = [list(range(len(node)))]
    while stack:
        members = stack.pop()
        half = weight[members[0]]
        centre = next(i for i in reversed(members) if weight[i] * 2 >= half)
        branch, parts, rest = {centre: None}, {}, []
        for i in members:
            if i == centre:
                continue
            above = parent[i]
            if above in branch:
                branch[i] = i if above == centre else branch[above]
                parts.setdefault(branch[i], []).append(i)
            else:
                rest.append(i)
        totals = [sum(v[i] for i in branch) for v in values]
        at, less, first = centre, weight[centre], members[0]
        while True:
            for g, t in zip(gain, totals, strict=True):
                g[at] += t
            if at != centre:
                weight[at] -= less
            if at == first:
                break
            at = parent[at]
        stack.extend(p for p in (rest, *parts.values()) if p)
    for s, g in zip(sums, gain, strict=True):
        s[:] = g
