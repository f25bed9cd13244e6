"""Pairs of similar sets among the members of buckets: all pairs of a bucket are compared exactly, in cells of bounded size."""

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASS = 1 << 19


def in_cells(members: DataFrame, sets: DataFrame, mass: int = MASS) -> DataFrame:
    """(node, cell, side, digests) by cell, of ``members`` (node, n, bucket) and ``sets`` (node, digests); n is the size of the set.

    A bucket whose sets have more than ``mass`` elements is cut into slices, and slice meets slice in cells of their own, so that a
    cell holds about two slices and no pair of the bucket is left out.  Buckets of the same members are compared once.
    """
    mixed = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mixed{k}") for k in (1, 2)]
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("mass"), *mixed).filter("rows > 1")
    buckets = buckets.groupBy("rows", "mass", "mixed1", "mixed2").agg(F.min("bucket").alias("bucket"))
    buckets = buckets.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("mass") / mass)).cast("int").alias("slices"))
    side = F.pmod(F.xxhash64("node", "bucket"), F.col("slices")).cast("int")
    rows = members.join(buckets, "bucket").select("bucket", "node", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    rows = rows.select("node", F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "side")
    return rows.join(sets, "node").select("node", "cell", "side", "digests").repartition("cell").sortWithinPartitions("cell")


def similar_pairs(cells: DataFrame, least: float, every: bool) -> DataFrame:
    """(u, v, similarity) with a Jaccard similarity of ``least`` or more: ``every`` pair of a cell, or pairs that connect the same members."""

    def run(batches):
        for parts in whole_cells(batches):
            node = pa.concat_arrays([p.column(0) for p in parts])
            side = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column(3).to_pylist()]
            u, v, s = _similar(sets, side, least, every)
            if u:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v)), pa.array(s)], names=["u", "v", "similarity"])

    kind = cells.schema["node"].dataType.simpleString()
    return cells.mapInArrow(run, f"u {kind}, v {kind}, similarity double")


def whole_cells(batches):
    """The slices of batches that make up each cell; rows come sorted by cell."""
    held, last = [], None
    for batch in batches:
        cell = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]):
            if a == b:
                continue
            if held and cell[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = cell[a]
    if held:
        yield held


def _similar(sets: list[np.ndarray], side: np.ndarray, least: float, every: bool) -> tuple[list, list, list]:
    """Each set against the larger ones it can be similar to; elements that no other set of the cell has are left out of the comparison."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, side = [sets[i] for i in order], side[order]
    size = np.array([len(x) for x in sets])
    n, across = len(sets), bool((side != side[0]).any())
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[ids] > 1
    owner, ids = np.repeat(np.arange(n), size)[several], ids[several]
    begin = np.searchsorted(owner, np.arange(n + 1))
    mark, root = np.zeros(len(times), bool), np.arange(n)
    out = [], [], []
    for i in range(n - 1):
        with_i = size[i] >= least * size[i + 1 :] * (1 - 1e-12)
        if across:
            with_i &= side[i + 1 :] != side[i]
        if not every:
            with_i &= root[i + 1 :] != root[i]
        j = np.flatnonzero(with_i) + i + 1
        if not len(j):
            continue
        mark[ids[begin[i] : begin[i + 1]]] = True
        width = begin[j + 1] - begin[j]
        upto = np.cumsum(width)
        at = np.arange(upto[-1]) + np.repeat(begin[j] - upto + width, width)
        hits = np.concatenate(([0], np.cumsum(mark[ids[at]])))
        both = hits[upto] - hits[upto - width]
        mark[ids[begin[i] : begin[i + 1]]] = False
        share = both / np.maximum(size[i] + size[j] - both, 1)
        j, share = j[share >= least], share[share >= least]
        if not every and len(j):
            _, first = np.unique(root[j], return_index=True)
            j, share = j[first], share[first]
            root[np.isin(root, root[j])] = root[i]
        out[0].extend([int(order[i])] * len(j))
        out[1].extend(order[j].tolist())
        out[2].extend(share.tolist())
    return out
