"""Classes of near copies with full recall: an exact set-similarity join with prefix filtering."""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.similar_sets import MASS, whole_cells, in_cells, similar_pairs
from codeloom.session import cut_lineage, drop_tables

# Counters of the rarity order, counters per row in which they travel.
CELLS, PAGE = 1 << 20, 1 << 12
# Bytes of the bitmap of keys, bytes per row in which they travel.
KEYS, KEY_PAGE = 1 << 23, 1 << 15
# Bytes of the sketches in a slice of a bucket.
SKETCHED = 1 << 20


def shingle_digests(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit digests of the distinct word shingles in lower case; a shorter text is one shingle, null like empty."""
    w = (text or "").lower().split()
    found = {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in found), np.uint64, len(found)))


def near_copy_classes(rows: DataFrame, text: str, key: str, least: float = 0.8, words: int = 5) -> DataFrame:
    """key, class_id, class_size, equal_to: texts linked by a Jaccard similarity of ``least`` or more of their word shingles, over any number of links.

    class_id is the smallest key of the class, equal_to the smallest key with the same set of shingles.  Rows with a null key are left out; a
    repeated key counts each of its texts.  No link between different texts is lost:

    * Equal sets are one set from the start.
    * All sets order their shingles alike, rare ones first.  Two sets of the asked similarity must share one of the first
      n - ceil(least * n) + 1 of each, so only these are looked up, without those that occur nowhere else.
    * Sets that share such a shingle are told apart by their sizes and by sketches of up to a sixteenth of their length, which never show
      more differences than there are.  Those that remain are joined to groups, over any number of steps.
    * Only the sets of groups travel whole.  A group is compared exactly, in cells of bounded size; sets that a cell has already linked are not
      compared again.  A group of several cells is dealt twice at random, and then only what that has not linked meets all the rest of it.

    Rarity comes from counters of hashed shingles and the rows to read again from a bitmap of hashed keys, tables of fixed size; they decide how
    much is compared and sent, never what is found.
    """
    kind = rows.schema[key].dataType.simpleString()
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = cut_lineage(own.mapInArrow(_signed(words), f"key {kind}, whole binary, page int, cells binary"), "signed")
    signed = found.where("page is null").select("key", "whole")
    rarity = _joined_pages(found.where("page is not null").select("page", "cells"), CELLS, PAGE, np.int64, np.add)
    first = cut_lineage(signed.groupBy("whole").agg(F.min("key").alias("key")), "first")
    facts = own.select("text").mapInArrow(_prefixes(words, rarity, least), "node binary, n bigint, sketch binary, buckets array<bigint>")
    facts = cut_lineage(facts.dropDuplicates(["node"]), "prefixes")
    members = facts.select("node", F.length("sketch").cast("bigint").alias("n"), F.explode("buckets").alias("bucket"))
    several = cut_lineage(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket"), "several")
    shared = cut_lineage(members.join(several, "bucket"), "members")
    cells = in_cells(shared, facts.select("node", F.col("sketch").alias("digests")), SKETCHED)
    near = cut_lineage(_near_pairs(cells, least), "near")
    drop_tables(several, shared)
    below = connected(near)
    groups = below.unionByName(below.select(F.col("top").alias("node"), "top").distinct())
    groups = groups.join(first.withColumnRenamed("whole", "node"), "node").join(facts.select("node", "n"), "node")
    groups = cut_lineage(groups, "groups")
    drop_tables(facts, near)
    links = _links(own, groups, least, words)
    linked = connected(reduce(DataFrame.unionByName, links))
    drop_tables(*links)
    named = first.withColumnRenamed("whole", "node").join(linked, "node", "left")
    named = named.select("node", F.col("key").alias("equal_to"), F.coalesce("top", "node").alias("top"))
    named = cut_lineage(named, "named")
    classes = named.join(signed.groupBy(F.col("whole").alias("node")).agg(F.count(F.lit(1)).alias("rows")), "node")
    classes = cut_lineage(classes.groupBy("top").agg(F.min("equal_to").alias("class_id"), F.sum("rows").alias("class_size")), "classes")
    of_set = cut_lineage(named.join(classes, "top").select(F.col("node").alias("whole"), "class_id", "class_size", "equal_to"), "of-set")
    drop_tables(first, groups, named, classes)
    return signed.join(of_set, "whole").select("key", "class_id", "class_size", "equal_to")


def _links(own: DataFrame, groups: DataFrame, least: float, words: int) -> list[DataFrame]:
    """Tables (u, v) of links that connect all similar sets of each group; ``groups`` (node, top, key, n) names a row that holds the set."""
    pages = groups.select(F.xxhash64("key").alias("h")).mapInArrow(_key_pages, "page int, cells binary")
    keys = _joined_pages(pages, KEYS, KEY_PAGE, np.uint8, np.bitwise_or)
    sets = own.select(F.xxhash64("key").alias("h"), "text").mapInArrow(_sets(words, keys), "node binary, digests binary").dropDuplicates(["node"])
    slices = groups.groupBy("top").agg(F.ceil(F.sum("n") / MASS).alias("slices"))
    sets = cut_lineage(sets.join(groups.join(slices, "top").select("node", "top", "n", "slices"), "node"), "sets")
    links = [cut_lineage(_similar_in(sets, _dealt(0), F.lit(0), least), "links")]
    large = sets.where("slices > 1")
    if large.isEmpty():
        drop_tables(sets)
        return links
    links.append(cut_lineage(_similar_in(large, _dealt(1), F.lit(0), least), "links"))
    parts = large.select("node", "top", "n").join(connected(links[0].unionByName(links[1])).withColumnRenamed("top", "part"), "node", "left")
    parts = cut_lineage(parts.select("node", "top", "n", F.coalesce("part", "node").alias("part")), "parts")
    sums = parts.groupBy("top", "part").agg(F.sum("n").alias("mass")).groupBy("top")
    sums = sums.agg(F.max(F.struct("mass", "part")).alias("main"), F.sum("mass").alias("mass")).where("mass > main.mass")
    # The largest part of a group needs no comparison with itself: its slices come first, and meet only those of the rest.
    sums = sums.select(
        "top", F.col("main.part").alias("main"), F.ceil(F.col("main.mass") / MASS).alias("a"), F.ceil((F.col("mass") - F.col("main.mass")) / MASS).alias("b")
    )
    name, inside = F.xxhash64("node", F.lit(2)), F.col("part") == F.col("main")
    side = F.when(inside, F.pmod(name, "a")).otherwise(F.col("a") + F.pmod(name, "b"))
    others = F.sequence(F.when(inside, F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1)
    rest = parts.join(sums, "top").select("node", "top", side.cast("int").alias("side"), F.explode(others).alias("other"))
    rest = sets.select("node", "digests").join(rest, "node")
    links.append(cut_lineage(_similar_in(rest, F.xxhash64("top", F.least("side", "other"), F.greatest("side", "other")), F.col("side"), least), "links"))
    drop_tables(sets, parts)
    return links


def _dealt(deal: int):
    """A group's cell at random; another number deals anew."""
    return F.xxhash64("top", F.pmod(F.xxhash64("node", F.lit(deal)), F.col("slices")))


def _similar_in(sets: DataFrame, cell, side, least: float) -> DataFrame:
    cells = sets.select("node", cell.alias("cell"), side.cast("int").alias("side"), "digests").repartition("cell").sortWithinPartitions("cell")
    return similar_pairs(cells, least, every=False).select("u", "v")


def _whole(digests: np.ndarray) -> bytes:
    """A set's name, short as it stands in every row of its prefix."""
    return hashlib.blake2b(digests.tobytes(), digest_size=16).digest()


def _signed(words: int):
    """Each row's set by name, then by pages how many rows hold a shingle, by its digest modulo ``CELLS``."""

    def run(batches):
        cells, kind = np.zeros(CELLS, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            whole = []
            for t in batch.column(1):
                digests = shingle_digests(t.as_py(), words)
                np.add.at(cells, (digests % np.uint64(CELLS)).astype(np.int64), 1)
                whole.append(_whole(digests))
            none = [pa.nulls(len(whole), pa.int32()), pa.nulls(len(whole), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary()), *none], names=["key", "whole", "page", "cells"])
        for page in _pages(cells, PAGE):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), *page.columns], names=["key", "whole", "page", "cells"])

    return run


def _pages(cells: np.ndarray, width: int):
    for p in range(-(-len(cells) // width)):
        part = cells[p * width : (p + 1) * width]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["page", "cells"])


def _joined_pages(pages: DataFrame, size: int, width: int, kind, add) -> np.ndarray:
    """One array of ``size`` numbers from the tasks' ``pages`` (page, cells), each page put together in a task."""

    def run(batches):
        total = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(x, kind)
                total[p] = add(total[p], part) if p in total else part
        for p, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["page", "cells"])

    out = np.zeros(size, kind)
    for row in pages.repartition("page").mapInArrow(run, "page int, cells binary").collect():
        out[row["page"] * width : (row["page"] + 1) * width] = np.frombuffer(row["cells"], kind)
    return out


def _key_pages(batches):
    bits = np.zeros(KEYS, np.uint8)
    for batch in batches:
        at, bit = _key_bits(batch.column(0))
        np.bitwise_or.at(bits, at, bit)
    yield from _pages(bits, KEY_PAGE)


def _key_bits(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
    return ((h >> np.uint64(3)) % np.uint64(KEYS)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)


def _sets(words: int, keys: np.ndarray):
    """The sets of the rows whose hashed key is among ``keys``."""

    def run(batches):
        for batch in batches:
            at, bit = _key_bits(batch.column(0))
            texts = batch.column(1).filter(pa.array((keys[at] & bit) != 0))
            for a in range(0, len(texts), 256):
                found = [shingle_digests(t.as_py(), words) for t in texts.slice(a, 256)]
                cols = [pa.array([_whole(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "digests"])

    return run


def _prefixes(words: int, rarity: np.ndarray, least: float):
    """Each row's set by name, its size, its sketch and those of its first shingles that another row may hold."""
    sent = np.minimum(rarity, np.iinfo(np.int32).max).astype(np.int32)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                node, size, sketches, buckets = [], [], [], []
                for t in batch.column(0).slice(a, 256):
                    digests = shingle_digests(t.as_py(), words)
                    times = sent[(digests % np.uint64(CELLS)).astype(np.int64)]
                    n = len(digests) - int(np.ceil(least * len(digests) - 1e-9)) + 1
                    chosen = np.lexsort((digests, times))[:n]
                    node.append(_whole(digests))
                    size.append(len(digests))
                    sketches.append(_sketch(digests))
                    buckets.append(digests[chosen[times[chosen] > 1]].view(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(buckets), pa.int64()))
                cols = [pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(sketches, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "sketch", "buckets"])

    return run


def _sketch(digests: np.ndarray) -> bytes:
    """The set's size, then one bit for each remainder of the digests: set if an odd number of them has it.

    Two sets differ in at least as many elements as their bits do.  There are two to four bits to an element, 256 at least; half as many come
    from the halves, joined by exclusive or.
    """
    width = 1 << max(8, int(2 * len(digests) - 1).bit_length())
    odd = np.bincount((digests % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.uint64(len(digests)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _near_pairs(cells: DataFrame, least: float) -> DataFrame:
    """(u, v) that connect the members of a cell which their sketches do not show to be less similar than ``least``."""

    def run(batches):
        for parts in whole_cells(batches):
            node = pa.concat_arrays([p.column(0) for p in parts])
            side = np.concatenate([p.column(2).to_numpy(zero_copy_only=False) for p in parts])
            u, v = _near([x for p in parts for x in p.column(3).to_pylist()], side, least)
            if u:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], names=["u", "v"])

    return cells.mapInArrow(run, "u binary, v binary")


def _near(sketches: list[bytes], side: np.ndarray, least: float) -> tuple[list, list]:
    """Each set against the larger ones, whose sketches are folded to the width of its own."""
    size = np.array([int.from_bytes(x[:8], "little") for x in sketches])
    order = np.argsort(size, kind="stable")
    size, side, bits = size[order], side[order], [np.frombuffer(sketches[i], np.uint64, offset=8) for i in order]
    n, across = len(size), bool((side != side[0]).any())
    upto = np.searchsorted(size, size / max(least, 1e-9) * (1 + 1e-9), "right")
    root, folded, u, v = np.arange(n), {}, [], []
    for i in range(n - 1):
        with_i = root[i + 1 : upto[i]] != root[i]
        if across:
            with_i &= side[i + 1 : upto[i]] != side[i]
        j = np.flatnonzero(with_i) + i + 1
        if not len(j):
            continue
        width = len(bits[i])
        if width not in folded:
            # wider sketches belong to larger sets, which come later
            folded[width] = i, np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in bits[i:]])
        begin, own = folded[width]
        other = np.bitwise_count(own[j - begin] ^ bits[i]).sum(axis=1, dtype=np.int64)
        j = j[other <= (1 - least) / (1 + least) * (size[i] + size[j]) + 1e-6]
        if len(j):
            _, at = np.unique(root[j], return_index=True)
            j = j[at]
            root[np.isin(root, root[j])] = root[i]
            u.extend([int(order[i])] * len(j))
            v.extend(order[j].tolist())
    return u, v


def connected(links: DataFrame) -> DataFrame:
    """node, top: the smallest node that can be reached over ``links`` (u, v), for each node of a link between two.

    Each round hangs the larger neighbours of a node on its smallest, then a node on the smallest of its smaller ones, until nothing
    changes.  Smallest neighbours are written before they are joined, so that a node with very many links is a join that can be split.
    """
    cur = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    cur, before = cut_lineage(cur, "links"), None
    while True:
        state = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut_lineage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        smallest = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut_lineage(small, "links")
        drop_tables(cur, least, large, smallest)
        cur, before = after, state
    return cur.withColumnsRenamed({"u": "node", "v": "top"})
