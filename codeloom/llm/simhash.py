"""SimHash near-duplicates: anchors from a covering code, one comparison per anchor, components by joins."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import arrays as A
from codeloom.llm.components import components
from codeloom.llm.scratch import Scratch
from codeloom.operators.similar_sets import in_cells, similar_pairs

MOST = 4
CELL = 4096
SHORT = 80
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the perfect binary code of length 23, distance 7 and covering radius 3.
_GENERATOR = 0xC75
_TABLES: dict[str, np.ndarray] = {}


def _rest(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0)
    return word


def anchor_tables() -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each 16-bit value, and all anchors within radius + 1 of it that can be reached by one bit (-1: none).

    A value is read as a 23-bit word with seven zero bits; its anchor is the one codeword at distance 3 or less,
    named by its 12 message bits.
    """
    if not _TABLES:
        bits = 1 << np.arange(23)
        single = np.concatenate(([0], bits))
        errors = np.unique((single[:, None, None] ^ single[None, :, None] ^ single[None, None, :]).ravel())
        errors = errors[np.bitwise_count(errors) <= 3]
        fix = np.zeros(2048, np.int64)
        fix[_rest(errors)] = errors
        words = np.arange(1 << 16, dtype=np.int64) << 7
        home = ((words ^ fix[_rest(words)]) >> 11).astype(np.int64)
        near = np.stack([home] + [home[np.arange(1 << 16) ^ (1 << b)] for b in range(16)], axis=1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)
        _TABLES["home"], _TABLES["near"] = home, near[:, : int((near >= 0).sum(axis=1).max())]
    return _TABLES["home"], _TABLES["near"]


def shingle_digests(text: bytes, words: int):
    """XXH64 of the shingles of ``words`` words, in pieces of 32,768; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    k = min(words, len(w))
    heads = np.concatenate(([0], ends[:-1] + 1))[: len(w) - k + 1].tolist()
    tails = ends[k - 1 :].tolist()
    for a in range(0, len(heads), 1 << 15):
        some = zip(heads[a : a + (1 << 15)], tails[a : a + (1 << 15)], strict=True)
        yield np.array([xxh64_intdigest(line[i:j], 42) for i, j in some], np.uint64)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes, words: int) -> int:
    """A bit is 1 if it is set in over half the shingles' XXH64; no words: 0."""
    count, n = np.zeros(64, np.int64), 0
    for h in shingle_digests(text, words):
        count += _bits(h).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int((np.uint64(1) << np.flatnonzero(2 * count > n).astype(np.uint64)).sum(dtype=np.uint64))


def sample_prints(h: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """Values that two similar sets of shingles share: SimHashes of up to 16 samples, two to four shingles each on average.

    A sample is what falls into one of 2^level classes by the digests' first bits; the level follows the
    size of the set, and sets near the next power of two give samples of both levels, so two sets whose sizes differ by
    a quarter share a level.  Sets of up to ``SHORT`` shingles give their smallest digests, as many as it takes for two similar sets to
    share one for certain.  Of two similar sets, both have samples or both have smallest digests.
    """
    out = []
    if len(h) <= SHORT:
        out.append(h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1])
    size = np.log2(max(len(h), 2) / 2)
    for level in sorted({int(size), int(size + 0.33)}) if len(h) > int(similarity * SHORT) else ():
        part = (h >> np.uint64(64 - level)) if level else np.zeros(len(h), np.uint64)
        part = part[: np.searchsorted(part, 16)]
        if not len(part):
            continue
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        count = np.add.reduceat(_bits(h[: len(part)]), first, axis=0, dtype=np.int64)
        size_of = np.diff(np.append(first, len(part)))
        bits = (2 * count > size_of[:, None]).astype(np.uint8)
        prints = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        out.append(A.mix(prints + A.mix(part[first] * np.uint64(64) + np.uint64(level))))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def sampled(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(d, t, f, w, n, samples) of each text: fingerprint, digest and size of its set of shingles, and what similar sets share."""
    from xxhash import xxh64_intdigest

    def run(batches):
        for batch in batches:
            prints, wholes, sizes, samples = [], [], [], []
            for t in (t for _, _, texts in A.slices(batch.column(2)) for t in texts):
                h = [*shingle_digests(t, words), np.empty(0, np.uint64)]
                h = np.concatenate(h)
                count = _bits(h).sum(axis=0, dtype=np.int64) if len(h) < 1 << 20 else sum(_bits(x).sum(axis=0, dtype=np.int64) for x in np.array_split(h, len(h) >> 19))
                prints.append((np.uint64(1) << np.flatnonzero(2 * count > len(h)).astype(np.uint64)).sum(dtype=np.uint64))
                h = np.unique(h)
                wholes.append(xxh64_intdigest(h.tobytes(), 43))
                sizes.append(len(h))
                samples.append(sample_prints(h, similarity).view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, wholes)]
            cols = [batch.column(0), batch.column(1), *signed, pa.array(sizes, pa.int64()), pa.array(samples, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "t", "f", "w", "n", "samples"])

    return docs.mapInArrow(run, "d bigint, t bigint, f bigint, w bigint, n bigint, samples array<bigint>")


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for part in A.few_rows([batch]):
                sets = [_shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "digests"])

    return run


def _shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([*shingle_digests(text or b"", words), np.empty(0, np.uint64)]))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; all columns as they came.

    Groups are components of two kinds of links: whole-text fingerprints of five-word shingles within four bits, found at the anchors,
    and texts whose shingle sets have a Jaccard similarity of ``similarity`` or more, which at this level differ in far more than four
    bits.  The second kind is looked for where SimHashes of small samples of the shingles agree: all texts that share a sample are
    compared exactly with each other, in cells.  At a similarity of 0.8 a sample agrees about every second time and there are 16, so fewer than
    one pair in ten thousand shares none; sets of up to ``SHORT`` shingles share a value for certain.

    Null ids come last; of equal ids and of repeated rows one stays, chosen by digest of the text.  Texts without words are one group.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t")]
    texts = docs.select(*key, F.col("text").cast("binary").alias("text"))
    prints = scratch.cut(sampled(texts, words, similarity), "prints")
    near = links(prints.select("f").distinct(), scratch)
    # A node is a set of shingles; sets with one fingerprint hang on the smallest of them.
    least = scratch.cut(prints.groupBy("f").agg(F.min("w").alias("least")), "least")
    same = prints.select("f", "w").distinct().join(least, "f").select(F.col("w").alias("u"), F.col("least").alias("v")).filter("u <> v")
    ends = [least.select(F.col("f").alias(c), F.col("least").alias(f"of_{c}")) for c in ("u", "v")]
    near = near.join(ends[0], "u").join(ends[1], "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    reps = scratch.cut(prints.groupBy(F.col("w").alias("node")).agg(F.min(F.struct("d", "t", "n", "samples")).alias("r")).select("node", "r.*"), "reps")
    each = reps.select("node", "n", F.explode("samples").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("bucket")
    members = scratch.cut(each.join(shared, "bucket"), "members")
    wanted = members.select("node").distinct().join(reps.select("node", "d", "t"), "node")
    sets = texts.join(wanted, ["d", "t"]).select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(words), "node bigint, digests binary")
    sets = scratch.cut(sets, "sets")
    similar = similar_pairs(in_cells(members, sets), similarity, every=False).select("u", "v")
    all_links = scratch.cut(near.unionByName(same).unionByName(similar).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "all_links")
    scratch.drop(members, sets, least, reps)
    label = components(all_links, scratch)
    named = prints.select("d", "t", "w").join(label.withColumnRenamed("node", "w"), "w", "left").withColumn("component", F.coalesce("root", "w"))
    stay = named.groupBy("component").agg(F.min(F.struct("d", "t")).alias("s")).select("s.*")
    stay = scratch.cut(stay, "stay")
    scratch.drop(all_links, prints)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    return rows.join(stay, ["d", "t"]).dropDuplicates(["d", "t"]).select("row.*")


def fingerprints(docs: DataFrame, carry: list[str], words: int) -> DataFrame:
    """The ``carry`` columns in the struct ``row`` and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t, words) for _, _, texts in A.slices(batch.column(1)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["row", "f"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, f bigint")


def _anchored(batches):
    """Each fingerprint at every anchor it has to meet others at; ``home`` marks its own anchors.

    At four differing bits or fewer over four quarters, either both quarters of one half differ in one
    bit at most, and then the one fingerprint is replicated to the home of the other in that half, or
    the bits are two and two in one quarter of each half, and then the other two quarters are equal.
    """
    home, near = anchor_tables()
    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(f), 4096):
            part = f[a : a + 4096]
            u = part.view(np.uint64)
            quarter = [((u >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
            keys, values, homes = [], [], []
            for half, (i, j) in enumerate(((0, 1), (2, 3))):
                x, y = near[quarter[i]], near[quarter[j]]
                pair = (x[:, :, None] << 12) | y[:, None, :]
                own = (home[quarter[i]] << 12) | home[quarter[j]]
                at = np.nonzero(((x >= 0)[:, :, None] & (y >= 0)[:, None, :]))
                keys.append((half << 32) | pair[at])
                values.append(part[at[0]])
                homes.append(pair[at] == own[at[0]])
            for n, (i, j) in enumerate(((0, 2), (0, 3), (1, 2), (1, 3))):
                keys.append(((2 + n) << 32) | (quarter[i] << 16) | quarter[j])
                values.append(part)
                homes.append(np.ones(len(part), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, values, homes)], names=["anchor", "f", "home"])


def _forest(f: np.ndarray, heads: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``most`` bits: each home in ``heads`` against its range of rows."""
    root = np.arange(len(f))
    width = end - begin
    first = 0
    while first < len(heads):
        last = first + max(1, int(np.searchsorted(np.cumsum(width[first:]), 1 << 20)))
        w = width[first:last]
        i = np.repeat(heads[first:last], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[first:last], w)
        hit = (np.bitwise_count((f[i] ^ f[j]).view(np.uint64)) <= most) & (f[i] != f[j])
        i, j = i[hit], j[hit]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                jump = root[root]
                if (jump == root).all():
                    break
                root = jump
        first = last
    moved = np.flatnonzero(root != np.arange(len(f)))
    return f[moved], f[root[moved]]


def _compare(most: int):
    def run(batches):
        """Rows come sorted by cell; a cell that may go on in the next batch is carried over."""
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                cell, f, home = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
                held = [x[cut:] for x in (cell, f, home)]
                cell, f, home = cell[:cut], f[:cut], home[:cut]
            elif held is not None:
                cell, f, home = held
            else:
                return
            if len(cell):
                heads = np.flatnonzero(home)
                begin, end = np.searchsorted(cell, cell[heads], "left"), np.searchsorted(cell, cell[heads], "right")
                several = end - begin > 1
                u, v = _forest(f, heads[several], begin[several], end[several], most)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(prints: DataFrame, scratch: Scratch, most: int = MOST, cell: int = CELL) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``f`` at ``most`` or fewer differing bits (4 at most).

    An anchor with more than ``cell`` rows is cut into slices; slice meets slice in cells of their own,
    so no task holds more than about two slices of it and none of its links is lost.
    """
    if not 0 <= most <= MOST:
        raise ValueError("the anchors cover four differing bits at most")
    at = prints.mapInArrow(_anchored, "anchor bigint, f bigint, home boolean")
    hot = at.groupBy("anchor").count().filter(F.col("count") > cell)
    hot = hot.select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("slices"))
    rows = at.join(hot, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("f"), F.col("slices")).cast("int")
    all_slices = F.sequence(F.lit(0), F.col("slices") - 1)
    as_other = F.transform(all_slices, lambda s: F.struct(s.alias("i"), own.alias("j"), (F.col("home") & (s == own)).alias("home")))
    as_home = F.when(F.col("home"), F.transform(F.filter(all_slices, lambda s: s != own), lambda s: F.struct(own.alias("i"), s.alias("j"), F.lit(True).alias("home"))))
    both = F.when(F.col("slices") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), "home"))).otherwise(F.concat(as_other, F.coalesce(as_home, F.array())))
    rows = rows.select("anchor", "f", F.inline(both))
    rows = rows.select(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("anchor")).otherwise(F.xxhash64("anchor", "i", "j")).alias("cell"), "f", "home")
    dealt = rows.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare(most), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, carry: list[str], words: int = 4, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """Fingerprint ``f`` and component of each document, next to the ``carry`` columns in the struct ``row``.

    Texts are lower-cased in A-Z; shingles of ``words`` words, repeats included; a shorter text is one shingle and a text without
    words (null, empty) has fingerprint 0, linked like any other.  Documents with equal fingerprints are one node from the start, so a
    group of copies of any size is one row in the search.  ``component`` is the smallest fingerprint (signed) that can be
    reached and ``component_id`` the smallest doc_id, null where all ids are null.  Repeated rows stay repeated.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    prints = scratch.cut(fingerprints(docs, carry, words), "prints")
    nodes = scratch.cut(prints.groupBy("f").agg(F.min("row.doc_id").alias("least")), "nodes")
    label = components(links(nodes.select("f"), scratch, most), scratch)
    named = nodes.join(label.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("root", "f"))
    named = scratch.cut(named.select("f", "component", "least"), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "component").select("f", "component", "component_id"), "f")


def components_of(docs: DataFrame, **parameters) -> DataFrame:
    out = near_duplicates(docs, ["doc_id"], **parameters)
    return out.select("row.doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
