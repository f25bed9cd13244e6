"""Suffix-array dedup: a sparse suffix array in ranges, sorted deep-shallow, tells which byte windows repeat."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import arrays as A
from codeloom.llm.scratch import Scratch

SEED = 16
SHALLOW = 32
PASSAGE = 250
# Suffixes that a task sorts; their bytes and marks take about a kilobyte each.
RANGE = 40_000
NO_ID = (1 << 63) - 1


def _span(window: int) -> int:
    return (window - SEED + 1) // 2


def _seed_values(buf: np.ndarray) -> np.ndarray:
    """A 64-bit value of the 16 bytes from each place."""
    if len(buf) < SEED:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.tobytes(), strides=(1,))
    h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _suffixes(window: int):
    span, key_bytes = _span(window), window - _span(window) + 1

    def run(batches):
        for batch in batches:
            for a, b, texts in A.slices(batch.column(2)):
                buf, first, end = A.joined(texts)
                values = _seed_values(buf)
                owner = np.repeat(np.arange(b - a), end - first + 1)[: len(values)]
                leaves = np.minimum(np.arange(len(values)) + SEED, len(buf)) > end[owner]
                pos = A.minimizers(values, span, owner * 2 + leaves)
                pos = pos[pos + key_bytes <= end[owner[pos]]]
                of = owner[pos]
                ranges = A.Ranges(A.byte_values(buf))
                keys = ranges.of(pos, pos + key_bytes).view(np.int64)
                left, right = np.maximum(pos - span + 1, first[of]), np.minimum(pos + window, end[of])
                around = A.mix(ranges.of(left, right) ^ A.mix((pos - left).astype(np.uint64))).view(np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=b - a)))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys, around, (pos - first[of]).astype(np.int32))]
                whole = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
                ids = [batch.column(k).slice(a, b - a) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(end - first), whole, *lists], names=["d", "t", "n_bytes", "whole", "key", "around", "at"])

    return run


def _contexts(window: int):
    span = _span(window)

    def run(batches):
        """Bytes before a suffix, nearest first, and the first bytes of the suffix."""
        for batch in A.few_rows(batches):
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in wanted:
                    p = x["at"]
                    rows.append((x["key"], x["around"], x["n"], text[max(0, p - span + 1) : p][::-1], text[p : p + window]))
                    if len(rows) == 20_000:
                        yield _context_batch(rows)
                        rows = []
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "around", "n", "back", "suffix"])


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _reach(batches):
    """Adds to each row the most bytes before it that another row of its key can share.

    Rows come in order of key and ``back``, so neighbours share most; the first and last row of a task may have
    a neighbour elsewhere and keep their whole length.
    """
    held, before = None, None
    for batch in batches:
        key, back = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        if not key:
            continue
        common = [0 if k0 != k1 else shared(b0, b1) for k0, k1, b0, b1 in zip(key, key[1:], back, back[1:], strict=False)]
        if held is not None:
            (last_batch, last_left), (k0, b0) = held, before
            joint = shared(b0, back[0]) if k0 == key[0] else 0
            yield _with_reach(last_batch, [*last_left, joint])
            held = (batch, [joint, *common])
        else:
            held = (batch, [len(back[0]), *common])
        before = (key[-1], back[-1])
    if held is not None:
        yield _with_reach(held[0], [*held[1], len(before[1])])


def _with_reach(batch, common):
    most = np.maximum(np.array(common[:-1]), np.array(common[1:])).astype(np.int32)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(most)], names=["key", "around", "n", "back", "suffix", "reach"])


def multikey_quicksort(items: list[int], prefix: list[bytes], depth: int, limit: int) -> list[list[int]]:
    """Groups of items with equal first ``limit`` bytes, groups in order: three-way partitions by 8 bytes at a time."""
    if len(items) < 2 or depth >= limit:
        return [items] if items else []
    word = [prefix[i][depth : depth + 8] for i in items]
    if len(items) < 24:
        out: list[list[int]] = []
        previous = None
        for p, i in sorted((prefix[i][depth:limit], i) for i in items):
            if p == previous:
                out[-1].append(i)
            else:
                out.append([i])
                previous = p
        return out
    pivot = sorted(word[:: max(1, len(word) // 9)])[len(word[:: max(1, len(word) // 9)]) // 2]
    low = [i for i, w in zip(items, word, strict=True) if w < pivot]
    same = [i for i, w in zip(items, word, strict=True) if w == pivot]
    high = [i for i, w in zip(items, word, strict=True) if w > pivot]
    middle = multikey_quicksort(same, prefix, depth + 8, limit) if len(pivot) == 8 else [same]
    return multikey_quicksort(low, prefix, depth, limit) + middle + multikey_quicksort(high, prefix, depth, limit)


class BlindTrie:
    """Orders strings that share a long prefix; inner nodes keep a depth and branch bytes only.

    An insertion first goes down blindly to some leaf, compares with that leaf once, and then knows the depth to branch at.
    A leaf is the list of the items that have its string.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            kids = node[1]
            child = kids.get(self._byte(i, node[0]))
            node = child if child is not None else next(iter(kids.values()))
        a, b = self.strings[i], self.strings[node[0]]
        if a == b:
            node.append(i)
            return
        depth, other = shared(a, b), node[0]
        node, parent, edge = self.root, None, 0
        while isinstance(node, tuple) and node[0] < depth:
            parent, edge = node, self._byte(i, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(i, depth)] = [i]
            return
        fresh = (depth, {self._byte(other, depth): node, self._byte(i, depth): [i]})
        if parent is None:
            self.root = fresh
        else:
            parent[1][edge] = fresh


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Suffix order and the bytes each shares with its predecessor (0 below the shallow depth)."""
    order, common = [], []
    for group in multikey_quicksort(list(range(len(strings))), strings, 0, SHALLOW):
        if len(group) == 1:
            order += group
            common.append(0)
            continue
        trie = BlindTrie(strings)
        for i in group:
            trie.insert(i)
        _walk(trie, order, common)
    return order, common


def _walk(trie: BlindTrie, order: list[int], common: list[int]) -> None:
    """In-order walk without recursion; ``above`` is what a subtree's first leaf shares with the leaf before it."""
    stack = [(trie.root, 0)]
    while stack:
        node, above = stack.pop()
        if isinstance(node, tuple):
            depth, kids = node
            names = sorted(kids)
            for b in reversed(names[1:]):
                stack.append((kids[b], depth))
            stack.append((kids[names[0]], above))
        else:
            order += node
            common.append(above)
            common += [len(trie.strings[node[0]])] * (len(node) - 1)


def _repeats(window: int):
    span = _span(window)

    def run(batches):
        """Which windows around each suffix repeat.

        A window starts ``o`` bytes before a suffix.  Two suffixes share it if they share ``window - o`` bytes, that is, lie in one
        stretch of the order whose neighbours share as much, and ``o`` bytes before.  Stretches at the edges of the task
        may go on in another one: their windows are given out by digest, each once, with a mark where the task has but one.
        """
        key, around, n, back, suffix, reach = [], [], [], [], [], []
        for batch in batches:
            for to, k in ((key, 0), (around, 1), (n, 2), (back, 3), (suffix, 4), (reach, 5)):
                to.extend(batch.column(k).to_pylist())
        if not key:
            return
        order, lcp = deep_shallow(suffix)
        size = len(order)
        lcp = np.array(lcp)
        many = np.array([n[i] for i in order]) >= 2
        forward = np.array([len(suffix[i]) for i in order])
        behind = np.array([len(back[i]) for i in order])
        bound = np.array([reach[i] for i in order])
        flat = np.frombuffer(b"".join(back[i].ljust(span, b"\0") for i in order), np.uint8).reshape(size, span)
        digest = np.zeros(size, np.uint64)
        # The most bytes shared with a neighbour in the order; the edges may share all with a neighbour elsewhere.
        near = np.maximum(lcp, np.append(lcp[1:], window))
        near[0] = window
        open_rows, hits = [], np.zeros((size, span), bool)
        for o in range(span):
            if o:
                digest = (digest + A._BYTE[flat[:, o - 1]] + np.uint64(1)) * np.uint64(A._BASE)
            need = window - o
            exists = (behind >= o) & (forward >= need)
            hits[:, o] = exists & many
            alive = np.flatnonzero(exists & (near >= need) & ((bound >= o) | many))
            if not len(alive):
                continue
            stretch = np.cumsum(lcp < need)
            names = A.mix(A.mix(digest[alive]) + stretch[alive].astype(np.uint64))
            _, at, which, count = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            hits[alive, o] |= count[which] >= 2
            edge = (stretch[alive[at]] == stretch[0]) | (stretch[alive[at]] == stretch[-1])
            open_rows += [(i, o, one) for i, one in zip(alive[at[edge]].tolist(), (~hits[alive[at[edge]], o]).tolist(), strict=True)]
        yield _runs_batch(hits, order, key, around)
        for x in range(0, len(open_rows), 20_000):
            part = open_rows[x : x + 20_000]
            ids, at, single = [order[i] for i, _, _ in part], [o for _, o, _ in part], [one for _, _, one in part]
            windows = [hashlib.blake2b(back[i][:o][::-1] + suffix[i][: window - o], digest_size=16).digest() for i, o in zip(ids, at, strict=True)]
            yield _rows([key[i] for i in ids], [around[i] for i in ids], at, at, windows, single)

    return run


def _runs_batch(hits, order, key, around):
    step = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    ids = [order[i] for i in row]
    return _rows([key[i] for i in ids], [around[i] for i in ids], lo, hi - 1, [None] * len(ids), [False] * len(ids))


def _rows(key, around, lo, hi, window, single):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    cols = [pa.array(c, k) for c, k in zip((key, around, lo, hi, window, single), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["key", "around", "lo", "hi", "window", "single"])


def _cut(window: int):
    def run(batches):
        for batch in A.few_rows(batches):
            removed, spans, kept, readable = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                step = np.zeros(len(text) + 2, np.int32)
                for x in found:
                    first, last = max(0, x["at"] - x["hi"]), min(x["at"] - x["lo"], len(text) - window)
                    if first <= last:
                        step[first] += 1
                        step[last + window] -= 1
                gone = np.cumsum(step)[: len(text)] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                own = np.frombuffer(text, np.uint8)
                kept.append(own[~gone].tobytes())
                character = np.cumsum((own & 0xC0) != 0x80)
                readable.append(own[np.bincount(character, gone, minlength=1)[character] == 0].tobytes().decode("utf-8", "replace"))
            cols = [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(readable, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_removed", "n_spans", "kept", "kept_text"])

    return run


def dedup_bytes(docs: DataFrame, carry: list[str], window: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """Removes each byte covered by a ``window``-byte string that also starts anywhere else, in the same document or another.

    Returns the ``carry`` columns in the struct ``row``, n_bytes, n_removed, n_spans (maximal removed runs), ``kept`` (the bytes left;
    null where nothing was removed), ``kept_text`` (the same without characters that lost a byte) and kept_sha256.  Strings never cross documents and are judged on the input; all occurrences go.  Null texts are
    empty; repeated rows are copies of each other; null ids are allowed; an empty table gives an empty result.

    The suffix array is sparse: in every window the smallest of the first ``_span`` seeds is a suffix that all its
    copies share, so only suffixes whose first bytes repeat are sorted, and of those with equal surroundings one stands for all.  They
    are dealt by range of their bytes, so a very common passage is spread over tasks as far as its surroundings differ; windows of
    stretches that cross tasks meet by digest.  Memory of a task: its range of suffixes and their ``window`` bytes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    ids = [F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")]
    keyed = docs.select(*ids, F.col("text").cast("binary").alias("text"))
    found = keyed.mapInArrow(_suffixes(window), "d bigint, t bigint, n_bytes bigint, whole string, key array<bigint>, around array<bigint>, at array<int>")
    facts = scratch.cut(found, "suffixes")
    firsts = facts.groupBy("whole").agg(F.min(F.struct("d", "t")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = facts.select("d", "t", "n_bytes", "whole").dropDuplicates(["d", "t"]).join(firsts, "whole")
    texts = scratch.cut(texts.select("d", "t", "n_bytes", "whole", "n", (F.col("first") == F.struct("d", "t")).alias("own")), "texts")
    own = facts.dropDuplicates(["d", "t"]).join(texts.filter("own").select("d", "t", "n"), ["d", "t"])
    own = scratch.cut(own.select("d", "t", "n", F.inline(F.arrays_zip("key", "around", "at"))), "own")
    scratch.drop(facts)

    # Written, as both sides of the join have to be plain exchanges for adaptive execution to split a hot key.
    repeated = scratch.cut(own.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1").select("key"), "repeated")
    candidates = scratch.cut(own.join(repeated, "key"), "candidates")
    scratch.drop(own, repeated)
    contexts = candidates.groupBy("key", "around").agg(F.sum("n").alias("n"), F.min(F.struct("d", "t", "at")).alias("at"))
    contexts = scratch.cut(contexts, "contexts")
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1").select("key")
    to_sort = scratch.cut(contexts.join(several, "key"), "to_sort")

    listed = candidates.groupBy("d", "t").agg(F.count(F.lit(1)).alias("candidates"))
    store = scratch.cut(keyed.join(listed, ["d", "t"]).drop("candidates"), "store")
    wanted = to_sort.groupBy("at.d", "at.t").agg(F.collect_list(F.struct("key", "around", "n", F.col("at.at").alias("at"))).alias("wanted"))
    bytes_of = store.dropDuplicates(["d", "t"]).join(wanted, ["d", "t"]).select("text", "wanted")
    columns = "key bigint, around bigint, n bigint, back binary, suffix binary"
    suffixes = scratch.cut(bytes_of.mapInArrow(_contexts(window), columns), "bytes")
    # A task's range is held whole, so there are as many ranges as rows ask for.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // RANGE))
    reached = suffixes.repartitionByRange(n, "key", "back").sortWithinPartitions("key", "back").mapInArrow(_reach, columns + ", reach int")
    reached = scratch.cut(reached, "reach")
    runs = reached.repartitionByRange(n, "suffix", "back").mapInArrow(_repeats(window), "key bigint, around bigint, lo int, hi int, window binary, single boolean")
    runs = scratch.cut(runs, "runs")
    scratch.drop(suffixes, reached)
    crossing = runs.filter("window is not null")
    # One place can hold a window at several suffixes; two places that share it do so at one key and distance.
    same = ["key", "lo", "window"]
    # What repeats inside a task is settled there.
    met = crossing.groupBy(*same).agg(F.count(F.lit(1)).alias("tasks"), F.max("single").alias("open")).filter("tasks > 1 and open").select(*same)
    met = crossing.filter("single").join(met, same)
    alone = contexts.filter("n > 1").select("key", "around", F.lit(0).alias("lo"), F.lit(_span(window) - 1).alias("hi"))
    all_runs = runs.filter("window is null").drop("window", "single").unionByName(met.select("key", "around", "lo", "hi")).unionByName(alone)
    by_context = scratch.cut(all_runs.groupBy("key", "around").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "by_context")
    spans = candidates.join(by_context, ["key", "around"]).select("d", "t", "at", F.inline("runs"))
    spans = spans.groupBy("d", "t").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("spans"))
    cut = store.dropDuplicates(["d", "t"]).join(spans, ["d", "t"]).select(F.struct("d", "t").alias("row"), "text", "spans")
    cut = scratch.cut(cut.mapInArrow(_cut(window), "row struct<d:bigint,t:bigint>, n_removed bigint, n_spans bigint, kept binary, kept_text string"), "cut")
    scratch.drop(to_sort, store, candidates, contexts, runs, by_context)

    all_gone = (F.col("n") > 1) & (F.col("n_bytes") >= window)
    settled = texts.join(cut.select("row.*", "n_removed", "n_spans", "kept", "kept_text"), ["d", "t"], "left")
    kept = F.when(all_gone, F.lit(b"")).otherwise(F.col("kept"))
    settled = settled.select(
        "d", "t", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), kept.alias("kept"),
        F.when(all_gone, "").otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(kept.isNull(), F.col("whole")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"),
    )
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *ids).join(settled, ["d", "t"]).drop("d", "t")


def without_repeats(docs: DataFrame, window: int = PASSAGE, scratch: Scratch | None = None) -> DataFrame:
    """The documents with repeated strings cut out of ``text`` and ``n_chars`` (where there is such a column) counted anew.

    ``window`` is made for passages of over 50 words: 51 words at 4.9 bytes, the space included (on the documents of sf0.1 1.4 % of the stretches of 51
    words are shorter, half have 315 bytes or more).

    A character that is cut in part goes as a whole.  Documents of which nothing but white space is left go; texts that hold no repeat stay as they are.
    """
    out = dedup_bytes(docs, docs.columns, window, scratch)
    text = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(F.col("kept_text"))
    out = out.select("row", text.alias("left")).filter("left is null or row.text = left or trim(left) <> ''")
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        count = F.length("left").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("row.text").eqNullSafe(F.col("left")), F.col("row.n_chars")).otherwise(count)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])

