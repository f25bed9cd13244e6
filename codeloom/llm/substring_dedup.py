"""Substring dedup: repeated word windows as edges of a De Bruijn graph, compacted to source passages."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import arrays as A
from codeloom.llm.scratch import Scratch

# Equal windows choose the same seed: the smallest of SPAN consecutive SEED-word grams.  What follows it in the window is the key.
SEED = 8
NO_ID = (1 << 63) - 1


def _words(texts: list[bytes]):
    buf, first, _ = A.joined(texts)
    starts, ends = A.word_spans(buf)
    return A.word_digests(buf, starts, ends), np.searchsorted(first, starts, "right") - 1


def _seeds(window: int):
    span = (window - SEED + 1) * 3 // 4
    key_words = window - span + 1

    def run(batches):
        for batch in batches:
            for a, b, texts in A.slices(batch.column(2)):
                digest, owner = _words(texts)
                n_words = A.counts_by(owner, b - a)
                first = np.cumsum(n_words) - n_words
                ranges = A.Ranges(digest)
                at = np.arange(max(0, len(digest) - SEED + 1))
                grams = ranges.of(at, at + SEED)
                # Words of one text only: grams at a text's end reach into the next and are no window's choice.
                pos = A.minimizers(grams, span, _gram_owner(owner, first, n_words, len(grams)))
                pos = pos[pos + key_words <= (first + n_words)[owner[pos]]]
                keys = ranges.of(pos, pos + key_words).view(np.int64)
                count = np.bincount(owner[pos], minlength=b - a)
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                whole = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n_words), pa.array(whole),
                        pa.ListArray.from_arrays(offsets, pa.array(keys)),
                        pa.ListArray.from_arrays(offsets, pa.array((pos - first[owner[pos]]).astype(np.int32))),
                    ],
                    names=["d", "t", "n_words", "whole", "keys", "at"],
                )

    return run


def _gram_owner(owner: np.ndarray, first: np.ndarray, n_words: np.ndarray, n: int) -> np.ndarray:
    """The text of each gram, and a number of its own for a gram that leaves its text."""
    own = owner[:n].astype(np.int64) * 2
    return own + (owner[:n] != owner[SEED - 1 : SEED - 1 + n])


def _edges(window: int):
    reach = (window - SEED + 1) * 3 // 4 - 1

    def run(batches):
        for batch in batches:
            seeds = batch.column(3)
            for a, b, texts in A.slices(batch.column(2)):
                digest, owner = _words(texts)
                n_words = A.counts_by(owner, b - a)
                first = np.cumsum(n_words) - n_words
                flat = seeds.slice(a, b - a)
                count = np.asarray(flat.value_lengths())
                pos = flat.flatten().to_numpy() + np.repeat(first, count)
                begin = np.repeat(first, count)
                last = np.repeat(first + n_words - window, count)
                # Windows that start up to ``reach`` words before a repeated seed.
                step = np.zeros(len(digest) + 2, np.int32)
                lo, hi = np.maximum(pos - reach, begin), np.minimum(pos, last)
                np.add.at(step, lo[hi >= lo], 1)
                np.add.at(step, hi[hi >= lo] + 1, -1)
                at = np.flatnonzero(np.cumsum(step)[: len(digest)] > 0)
                ranges = A.Ranges(digest)
                pre = ranges.of(at, at + window - 1).view(np.int64)
                suf = ranges.of(at + 1, at + window).view(np.int64)
                of = owner[at]
                for x in range(0, len(at), 100_000):
                    s = slice(x, x + 100_000)
                    rows = pa.array(of[s] + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pre[s]), pa.array(suf[s]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - first[of])[s].astype(np.int32))],
                        names=["pre", "suf", "d", "t", "pos"],
                    )

    return run


def _runs(batches):
    """Maximal runs of consecutive windows of one occurrence of a path."""
    for batch in batches:
        base, start = batch.column(5).to_pylist(), batch.column(4).to_pylist()
        rows, at, n, source = [], [], [], []
        for i, p in enumerate(batch.column(6)):
            p = np.unique(p.values.to_numpy())
            cut = np.flatnonzero(np.diff(p) > 1) + 1
            heads, tails = p[np.concatenate(([0], cut))], p[np.concatenate((cut - 1, [len(p) - 1]))]
            rows += [i] * len(heads)
            at.append(heads)
            n.append(tails - heads + 1)
            source.append(heads - base[i] + start[i])
        if rows:
            flat = [pa.array(np.concatenate(x).astype(np.int32)) for x in (at, n, source)]
            ids = [batch.column(k).take(pa.array(rows)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*ids, *flat], names=["d", "t", "sd", "st", "at", "n", "source_at"])


def _passages(batches):
    """A 128-bit digest of the words of each wanted passage of a text."""
    for batch in A.few_rows(batches):
        ids, digests = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.split()
            for x in wanted:
                ids.append(x["id"])
                digests.append(hashlib.blake2b(b" ".join(words[x["at"] : x["at"] + x["words"]]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.binary())], names=["id", "digest"])


def _cut(window: int):
    def run(batches):
        for batch in A.few_rows(batches):
            kept, removed = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int32)
                for x in spans:
                    step[x["at"]] += 1
                    step[x["at"] + x["n"] + window - 1] -= 1
                gone = np.cumsum(step)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_removed", "kept"])

    return run


def compacted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated edges with the path they lie on: (pre, suf, sd, st, sp, start).

    An edge is a window, its nodes are the window without its last and without its first word.  Only windows of two or more
    ids are edges; each carries its first occurrence (smallest id, then text, then place) as source.  A node with one edge in and one
    out whose sources are neighbours does not branch, and the edges on both sides belong to one path.  ``start`` is where the path starts in its source.
    """
    source = F.min(F.struct("d", "t", "pos"))
    repeated = edges.groupBy("pre", "suf").agg(source.alias("s"), F.max("d").alias("last")).filter("s.d < last")
    repeated = scratch.cut(repeated.select("pre", "suf", F.col("s.d").alias("sd"), F.col("s.t").alias("st"), F.col("s.pos").alias("sp")), "repeated")
    place = F.struct("sd", "st", "sp")
    ends = repeated.select(F.col("suf").alias("node"), place.alias("came"), F.lit(None).cast("struct<sd:bigint,st:bigint,sp:int>").alias("goes"))
    heads = repeated.select(F.col("pre").alias("node"), F.lit(None).cast("struct<sd:bigint,st:bigint,sp:int>").alias("came"), place.alias("goes"))
    nodes = ends.unionByName(heads).groupBy("node").agg(F.count("came").alias("ins"), F.count("goes").alias("outs"), F.max("came").alias("came"), F.max("goes").alias("goes"))
    inner = nodes.filter("ins = 1 and outs = 1 and came.sd = goes.sd and came.st = goes.st and came.sp + 1 = goes.sp")
    inner = inner.select("goes.sd", "goes.st", "goes.sp", F.lit(True).alias("inner"))
    in_source = Window.partitionBy("sd", "st").orderBy("sp")
    out = repeated.join(inner, ["sd", "st", "sp"], "left").withColumn("start", F.max(F.when(F.col("inner").isNull(), F.col("sp"))).over(in_source))
    out = scratch.cut(out.select("pre", "suf", "sd", "st", "sp", "start"), "paths")
    scratch.drop(repeated)
    return out


def _verified(spans: DataFrame, store: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Spans whose words are those of the source passage, by digests of both."""
    words = (F.col("n") + window - 1).alias("words")
    name = F.concat_ws("-", "d", "t", "at", "sd", "st", "source_at", "n").alias("id")
    sides = spans.select("d", "t", F.struct(name, "at", words).alias("x")).unionByName(
        spans.select(F.col("sd").alias("d"), F.col("st").alias("t"), F.struct(name, F.col("source_at").alias("at"), words).alias("x"))
    )
    # A source that many texts repeat is asked for each passage once.
    sides = sides.groupBy("d", "t", F.col("x.at").alias("at"), F.col("x.words").alias("words")).agg(F.min("x.id").alias("id"))
    by_text = sides.groupBy("d", "t").agg(F.collect_list(F.struct(F.concat_ws("-", "d", "t", "at", "words").alias("id"), "at", "words")).alias("wanted"))
    texts = store.dropDuplicates(["d", "t"]).select("d", "t", "text")
    digests = scratch.cut(texts.join(by_text, ["d", "t"]).select("text", "wanted").mapInArrow(_passages, "id string, digest binary"), "passages")
    own = spans.select("*", F.concat_ws("-", "d", "t", "at", words).alias("id")).join(digests, "id").withColumnRenamed("digest", "own").drop("id")
    with_source = own.withColumn("id", F.concat_ws("-", "sd", "st", "source_at", words)).join(digests, "id")
    return with_source.filter("own = digest").select("d", "t", "at", "n")


def dedup_passages(docs: DataFrame, window: int = 50, carry: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Removes each word covered by a ``window``-word sequence that also starts in a document with a smaller doc_id.

    Returns the ``carry`` columns in the struct ``row``, n_words, n_removed and ``kept`` (the words left, joined by one space; null
    where nothing was removed) with ``kept_sha256``.  Words are split at ASCII white space.  Windows are judged on the input.
    Null and empty texts have no words; a null doc_id is larger than any other and is not smaller than another null; repeated rows and rows of
    one id do not remove each other's words.  Texts with equal words as one of a smaller id are
    settled by the digest of all words and do not enter the graph, so large groups of copies cost one text.

    Only windows around a repeated seed become edges; hot edges and seeds meet in partial aggregates and in joins that adaptive
    execution can split.  What is gathered per document is bounded by its own words.
    """
    if window < 2 * SEED:
        raise ValueError(f"windows of {2 * SEED} words at least")
    carry = ["doc_id"] if carry is None else carry
    scratch = scratch or Scratch(docs.sparkSession, "passages")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"),
        F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"),
    )
    seeds = keyed.select("d", "t", "text").mapInArrow(_seeds(window), "d bigint, t bigint, n_words bigint, whole string, keys array<bigint>, at array<int>")
    facts = scratch.cut(seeds, "seeds")
    firsts = facts.groupBy("whole").agg(F.min("d").alias("first"))
    texts = facts.select("d", "t", "n_words", "whole").dropDuplicates(["d", "t"]).join(firsts, "whole")
    texts = scratch.cut(texts.select("d", "t", "n_words", "whole", (F.col("first") < F.col("d")).alias("copy")), "texts")
    uncopied = facts.join(texts.filter("not copy").select("d", "t"), ["d", "t"]).select("d", "t", F.inline(F.arrays_zip("keys", "at")))
    uncopied = scratch.cut(uncopied, "uncopied")
    scratch.drop(facts)
    # Written, as both sides of the join have to be plain exchanges for adaptive execution to split a hot key.
    repeated = scratch.cut(uncopied.groupBy("keys").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a < b").select("keys"), "repeated")
    wanted = uncopied.join(repeated, "keys").groupBy("d", "t").agg(F.collect_set("at").alias("at"))
    store = scratch.cut(keyed.select("d", "t", "text").join(wanted, ["d", "t"]), "store")
    scratch.drop(uncopied, repeated)

    edges = store.select("d", "t", "text", "at").mapInArrow(_edges(window), "pre bigint, suf bigint, d bigint, t bigint, pos int")
    paths = compacted(edges, scratch)
    met = edges.join(paths, ["pre", "suf"]).filter("sd < d")
    base = F.col("pos") - (F.col("sp") - F.col("start"))
    met = met.groupBy("d", "t", "sd", "st", "start", base.alias("base")).agg(F.collect_list("pos").alias("pos"))
    spans = scratch.cut(met.mapInArrow(_runs, "d bigint, t bigint, sd bigint, st bigint, at int, n int, source_at int"), "spans")
    scratch.drop(paths)
    spans_of = _verified(spans, store, window, scratch).groupBy("d", "t").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    cut = store.select("d", "t", "text").join(spans_of, ["d", "t"]).select(F.struct("d", "t").alias("row"), "text", "spans")
    cut = scratch.cut(cut.mapInArrow(_cut(window), "row struct<d:bigint,t:bigint>, n_removed bigint, kept string").dropDuplicates(["row"]), "cut")
    scratch.drop(spans)

    all_gone = F.col("copy") & (F.col("n_words") >= window)
    settled = texts.join(cut.select("row.*", "n_removed", "kept"), ["d", "t"], "left").select(
        "d", "t", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, "").otherwise(F.col("kept")).alias("kept"), "whole",
    )
    settled = settled.withColumn("kept_sha256", F.when(F.col("kept").isNull(), F.col("whole")).otherwise(F.sha2("kept", 256))).drop("whole")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t")).join(settled, ["d", "t"]).drop("d", "t")
