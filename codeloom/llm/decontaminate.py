"""Benchmark decontamination: latent semantic retrieval of passages, then longest common subsequences and answers."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import arrays as A
from codeloom.llm.scratch import Scratch

# Bytes below 128 that are neither letters nor digits end a word; other bytes belong to it.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
HALF = 16
ANSWER = 8


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def _gaussian(terms: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((terms, k))


def _product(vocabulary: dict[bytes, int], idf: np.ndarray, right: np.ndarray, back: bool):
    """Per task: A^T (A right) by term, or (A right)^T (A right) by column, for the task's unit-length rows of A."""

    def run(batches):
        total = np.zeros((len(vocabulary) if back else right.shape[1], right.shape[1]))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids, tf = np.unique([vocabulary[w] for w in words_of(text)], return_counts=True)
                x = tf * idf[ids]
                x = x / np.linalg.norm(x)
                y = x @ right[ids]
                if back:
                    total[ids] += x[:, None] * y
                else:
                    total += np.outer(y, y)
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(list(total[rows]), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _summed(items: DataFrame, run, n: int, k: int) -> np.ndarray:
    """The sum of the tasks' matrices; ``n`` x ``k`` numbers reach the driver, both bounded by the block."""
    parts = items.mapInArrow(run, "i bigint, v array<double>")
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v"))
    out = np.zeros((n, k))
    for r in total.collect():
        out[r["i"]] = r["v"]
    return out


def latent_space(items: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int, seed: int = 5, rounds: int = 3) -> np.ndarray:
    """Randomised SVD of the TF-IDF rows of ``items`` (text): the leading right singular vectors, one column each."""
    k, n = min(rank + 8, len(vocabulary)), len(vocabulary)
    q = _gaussian(n, k, seed)
    for _ in range(rounds):
        q, _ = np.linalg.qr(_summed(items, _product(vocabulary, idf, q, True), n, k))
    gram = _summed(items, _product(vocabulary, idf, q, False), k, k)
    values, vectors = np.linalg.eigh(gram)
    keep = np.argsort(-values)[: min(rank, int((values > 1e-12).sum()))]
    return q @ vectors[:, keep]


def document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term of the block, counted over all documents."""

    def run(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        get = vocabulary.get
        for batch in batches:
            for _, _, texts in A.slices(batch.column(0)):
                n += len(texts)
                for text in texts:
                    found = {get(w) for w in set(words_of(text))}
                    found.discard(None)
                    if found:
                        total[list(found)] += 1
        ids = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.append(total[ids[:-1]], n))], names=["i", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"))
    out, n = np.zeros(len(vocabulary)), 0
    for r in rows.collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            out[r["i"]] = r["n"]
    return out, n


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word operation per 30 words of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def verdict(item: list, passage: list, least: float, paraphrase: float, within: tuple[int, int] | None = None) -> tuple[float, float, bool]:
    """Share of the item and share of its answer (the last 8 words) found in order, and whether that is a leak.

    The passage is read in windows of one and a half times the item's words, so that words far apart do not add up; ``within``
    says where windows may start.
    """
    size = max(len(item) * 3 // 2, 1)
    share = answer = 0.0
    hit = False
    starts = range(0, max(1, len(passage) - size // 2), max(1, size // 4))
    if within:
        own = set(item)
        known = np.concatenate(([0], np.cumsum([w in own for w in passage[within[0] : within[1] + size]])))
        starts = starts[-(-within[0] // starts.step) : -(-within[1] // starts.step)]
        # A window with fewer of the item's words than a paraphrase needs is not read.
        starts = [s for s in starts if known[min(s - within[0] + size, len(known) - 1)] - known[s - within[0]] >= paraphrase * len(item)]
    for s in starts:
        part = passage[s : s + size]
        x = lcs(item, part) / len(item)
        tail = item[-ANSWER:]
        y = lcs(tail, part) / len(tail) if x >= paraphrase else 0.0
        share, answer = max(share, x), max(answer, y)
        hit |= x >= (least if len(item) >= ANSWER else 1.0) or (len(item) >= 2 * ANSWER and x >= paraphrase and y >= 0.85)
    return share, answer, hit


class _Cover:
    """Every place where ``verdict`` can accept an item, found by the item's rarest words; no item is too long or too short.

    A leak holds a share of the item's places, so it holds one of the rarest places, one more than may be missing; a paraphrase also holds
    one of the rarest two of the answer's.  What holds one is counted: a stretch of a text has to have the words for the share.
    Stretches start every ``step`` words and are two steps long, a step being longer than the windows of its items.
    """

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, least: float, paraphrase: float):
        self.items, self.least, self.paraphrase = items, least, paraphrase
        self.steps: dict[int, tuple] = {}
        by_step: dict[int, list] = {}
        for i, t in enumerate(items):
            step = 128
            while step <= len(t) * 3 // 2:
                step *= 4
            by_step.setdefault(step, []).append(i)
        for step, own in by_step.items():
            terms, of = [], []
            for i in own:
                keys = set(self._rarest(items[i], idf, self._full(i)).tolist())
                if len(items[i]) >= 2 * ANSWER:
                    keys |= set(self._rarest(items[i][-ANSWER:], idf, 0.85).tolist())
                terms += sorted(keys)
                of += [i] * len(keys)
            order = np.argsort(terms, kind="stable")
            begin = np.searchsorted(np.array(terms)[order], np.arange(len(idf) + 2))
            self.steps[step] = begin, np.array(of)[order]

    def _full(self, i: int) -> float:
        return self.least if len(self.items[i]) >= ANSWER else 1.0

    @staticmethod
    def _rarest(places: np.ndarray, idf: np.ndarray, share: float) -> np.ndarray:
        missing = len(places) - int(np.ceil(share * len(places) - 1e-9))
        return places[np.argsort(-idf[places], kind="stable")][: missing + 1]

    def of(self, flat: np.ndarray):
        """(item, first, last) of the stretches of one text that may hold an item; verdict's windows start in first ... last - 1."""
        oov = len(next(iter(self.steps.values()))[0]) - 2
        for step, (begin, of) in self.steps.items():
            width = begin[flat + 1] - begin[flat]
            at = np.flatnonzero(width)
            if not len(at):
                continue
            width = width[at]
            upto = np.cumsum(width)
            item = of[np.arange(upto[-1]) + np.repeat(begin[flat[at]] - upto + width, width)]
            stretch = np.repeat(at // step, width)
            pairs = np.unique(np.concatenate([stretch, stretch[stretch > 0] - 1]) * len(self.items) + np.concatenate([item, item[stretch > 0]]))
            last, held = -1, np.zeros(oov + 1, bool)
            for k, i in zip((pairs // len(self.items)).tolist(), (pairs % len(self.items)).tolist(), strict=True):
                if k != last:
                    held[:] = False
                    held[flat[k * step : (k + 2) * step]] = True
                    held[oov] = False
                    last = k
                has = held[self.items[i]]
                n = len(has)
                found = int(has.sum())
                if found < self.paraphrase * n:
                    continue
                tail = has[-ANSWER:]
                if found >= self._full(i) * n - 1e-9 or (n >= 2 * ANSWER and tail.sum() >= 0.85 * len(tail)):
                    yield i, k * step, (k + 1) * step


class _Block:
    """One block of items: its terms as numbers, its latent space and its cover; bounded by the number of items in a block."""

    def __init__(self, items: list[tuple[int, list[bytes]]], known: dict[bytes, int], idf: np.ndarray, least: float, paraphrase: float):
        self.ids, self.items = [i for i, _ in items], [w for _, w in items]
        self.least, self.paraphrase = least, paraphrase
        self.vocabulary = {w: n for n, w in enumerate(sorted({x for w in self.items for x in w}))}
        terms = [known[w] for w in self.vocabulary]
        self.idf = idf[terms]
        # The round's numbers of words to the block's; the last but one stands for a word of other blocks only, the last for no word.
        self.local = np.full(len(known) + 2, len(terms), np.int64)
        self.local[terms] = np.arange(len(terms))
        self.local[-1] = -1

    def fit(self, texts: DataFrame, rank: int, seed: int) -> None:
        idf, terms = self.idf, [np.array([self.vocabulary[x] for x in w]) for w in self.items]
        space = latent_space(texts, self.vocabulary, idf, rank, seed)
        self.scaled = np.vstack([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        self.weight = np.append(idf**2, np.median(idf) ** 2).astype(np.float32)
        rows = np.zeros((len(terms), space.shape[1]))
        for i, places in enumerate(terms):
            t, tf = np.unique(places, return_counts=True)
            x = tf * idf[t]
            rows[i] = x @ space[t] / np.linalg.norm(x)
        # An item's own score is the length of its projection; candidates are measured against that.
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        self.goal = (rows / np.maximum(length, 1e-9) ** 2).T.astype(np.float32)
        self.cover = _Cover(terms, idf, self.least, self.paraphrase)

    def found(self, part: "_Slice", cosine: float):
        """(text, item id, cosine, share, share of the answer, whether the latent space led to it) of one slice."""
        flat, first, blocks, words = self.local[part.flat], part.first, part.blocks, part.words
        vec = np.zeros((len(flat) // HALF, self.scaled.shape[1]), np.float32)
        for s in range(0, len(vec), 2048):
            places = flat[s * HALF : (s + 2048) * HALF]
            vec[s : s + 2048] = self.scaled[places].reshape(-1, HALF, self.scaled.shape[1]).sum(axis=1)
        mass = np.where(flat >= 0, self.weight[flat], 0).reshape(-1, HALF).sum(axis=1)
        pair = vec.copy()
        pair[part.joined] += vec[1:][part.joined[:-1]]
        mass2 = mass.copy()
        mass2[part.joined] += mass[1:][part.joined[:-1]]
        pair /= np.sqrt(np.maximum(mass2, 1e-9))[:, None]
        near, done = {}, set()
        for s in range(0, len(pair), 4096):
            w, i = np.nonzero(pair[s : s + 4096] @ self.goal >= cosine)
            for x, y in zip((w + s).tolist(), i.tolist(), strict=True):
                near.setdefault((int(part.owner[x]), y), []).append(x)
        for (d, i), windows in near.items():
            best, item = None, self.items[i]
            for r in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1):
                lo, hi = (r[0] - first[d]) * HALF, (r[-1] - first[d] + 2) * HALF
                seen = verdict(item, words[d][max(0, lo - len(item)) : hi + len(item)], self.least, self.paraphrase)
                if seen[2] and (best is None or seen > best):
                    best = seen
            if best:
                done.add((d, i))
                yield d, self.ids[i], float((pair[windows] @ self.goal[:, i]).max()), best[0], best[1], True
        for d, n in enumerate(part.n.tolist()):
            rest = {}
            for i, lo, hi in self.cover.of(flat[first[d] * HALF : first[d] * HALF + n]):
                if (d, i) not in done:
                    seen = verdict(self.items[i], words[d], self.least, self.paraphrase, (lo, hi))
                    if seen[2]:
                        rest[i] = max(rest.get(i, seen), seen)
            for i, best in rest.items():
                score = float((pair[first[d] : first[d] + blocks[d]] @ self.goal[:, i]).max())
                yield d, self.ids[i], score, best[0], best[1], False


class _Slice:
    """The words of some texts as numbers; each text fills whole blocks, and places without a word weigh nothing."""

    def __init__(self, texts: list[bytes], known: dict[bytes, int]):
        get, other = known.get, len(known)
        self.words = [words_of(t) for t in texts]
        self.n = n = np.array([len(w) for w in self.words])
        self.blocks = -(-n // HALF)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.flat = np.full(int(self.blocks.sum()) * HALF, -1, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first * HALF, n)
        self.flat[at] = [get(x, other) for w in self.words for x in w]
        self.owner = np.repeat(np.arange(len(texts)), self.blocks)
        self.joined = np.append(self.owner[1:] == self.owner[:-1], False)


def _search(blocks: list[_Block], known: dict[bytes, int], cosine: float):
    """Each slice of texts is split into words once and meets the round's blocks one after the other."""

    def run(batches):
        for batch in batches:
            for a, _, texts in A.slices(batch.column(1)):
                part = _Slice(texts, known)
                out = [(a + d, *row) for block in blocks for d, *row in block.found(part, cosine)] if part.n.sum() else []
                if out:
                    at, item, *numbers, latent = zip(*out, strict=True)
                    cols = [batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), *[pa.array(x, pa.float64()) for x in numbers], pa.array(latent)]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "item_id", "cosine", "lcs_share", "answer_share", "latent"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], rank: int = 128, cosine: float = 0.4, least: float = 0.75,
    paraphrase: float = 0.55, block_items: int = 256, round_items: int = 8192, scratch: Scratch | None = None,
) -> DataFrame:
    """One row for each (document, benchmark item) where the document holds the item or a paraphrase of it.

    Columns: the ``carry`` columns in the struct ``row``, item_id, cosine (against the item's own score), lcs_share, answer_share, latent
    (whether the latent space led to it, so its recall can be read from the result).  The
    items are a query set that is taken in rounds of about ``round_items``; a round reads the documents twice, once to count the terms of
    all its items and once to search for them.  In a round each block of about ``block_items`` items has a latent space of its own.  The
    round's words, spaces and rows travel to all tasks: some 10 kB an item, so about 80 MB at the default, whatever the corpus.
    Term counts and the search cover every word of every document.  Windows of
    32 words, every 16, are compared in the latent space; what is near is decided by the longest common subsequence and the answer.  Items
    much longer or shorter than a window, and paraphrases, can lie below ``cosine``: what the items' rarest words point to is decided
    in the same way, so every document that ``verdict`` accepts is found, and the cosine only says how near it is.
    Null texts and texts without words match nothing; items that are null or without words are left out; repeated rows are judged alike; without
    items or documents there are no rows.  Documents are never shuffled.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    kept = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").cast("binary").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, item_id bigint, cosine double, lcs_share double, answer_share double, latent boolean"
    n_items = kept.count()
    rounds = max(1, math.ceil(n_items / max(round_items, block_items)))
    blocks = max(1, math.ceil(n_items / rounds / block_items))
    dealt = F.xxhash64("item_id", "text")
    kept = scratch.cut(kept.withColumns({"block": F.pmod(dealt, F.lit(blocks)), "round": F.pmod(F.shiftright(dealt, 32), F.lit(rounds))}), "items")
    seed = int.from_bytes(hashlib.sha256(b"space").digest()[:4], "big")
    out = spark.createDataFrame([], schema)
    for turn in range(rounds):
        items = kept.filter(F.col("round") == turn)
        by_block: dict[int, list] = {}
        for i, text, block in sorted((-1 if r["item_id"] is None else r["item_id"], bytes(r["text"]), r["block"]) for r in items.collect()):
            words = words_of(text)
            if words:
                by_block.setdefault(block, []).append((i, words))
        known = {w: n for n, w in enumerate(sorted({x for own in by_block.values() for _, w in own for x in w}))}
        if not known:
            continue
        frequency, n = document_frequency(docs, known)
        idf = np.log((n + 1) / (frequency + 1)) + 0.1
        filled = items.filter(F.length(F.trim(F.regexp_replace(F.lower(F.col("text").cast("string")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]", " "))) > 0)
        ready = [_Block(own, known, idf, least, paraphrase) for _, own in sorted(by_block.items())]
        for number, block in zip(sorted(by_block), ready, strict=True):
            block.fit(filled.filter(F.col("block") == number).select("text"), rank, seed)
        out = out.unionByName(rows.mapInArrow(_search(ready, known, cosine), schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, **parameters) -> DataFrame:
    """The documents without a leak, all columns as they came.

    Leaking documents are named by id and digest of the text, which is a small table; rows with equal id and text share a verdict.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    key = [F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t")]
    hits = leaks(docs.select(*key, "text"), benchmark, ["d", "t"], scratch=scratch, **parameters).select("row.*").distinct()
    hits = scratch.cut(hits, "hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("t"))
    return rows.join(hits, ["d", "t"], "left_anti").select("row.*")
