"""Exact top-k by inner product: candidates by descending length, rotated partial sums, Cauchy-Schwarz bounds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

# Bytes of queries that are sent to the executors at once, bytes of the head, vectors per block, dimensions that are rotated.
ROUND_BYTES, HEAD_BYTES, BLOCK, ROTATED = 64 << 20, 1 << 20, 1024, 512
_EXACT = float(1 << 52)
_MOST = 10**38 - 1


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm2): floor(scale * x) of each component as double, without vectors that are null or hold null or non-finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("v is not null and vec_id is not null").filter(F.forall("v", finite))
    # Not F.floor, which ends at the range of a long.
    rows = rows.select("vec_id", F.transform("v", lambda x: F.rint(x * scale) - (F.rint(x * scale) > x * scale).cast("double")).alias("v"))
    return rows.filter(F.forall("v", finite)).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def top_inner_products(vectors: DataFrame, is_query: str, k: int = 5, scratch: Scratch | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for each vector of ``vectors`` (vec_id, v, norm2) that is a query.

    ``v`` holds whole numbers.  Candidates are all rows with another vec_id, each row by itself (a repeated row comes twice); a repeated
    query counts once, by its smallest vector.  Ties go to the smaller vec_id, then one of them; all candidates, if there are fewer.
    Vectors of unequal length are filled up with zeros.  Ranks are those of the true scores (up to 10^38); one beyond a long
    is shown as the end of its range.  No rows, no result.

    1. The rows are written by descending length.  The matrix of second moments, summed over all rows, gives the rotation, the right singular vectors of
       the table, so that the first dimensions hold most of a product.
    2. The products with the longest rows, ``HEAD_BYTES`` of them, give each query a first bound, its k-th best score so far.
    3. Queries go to all tasks in rounds of ``round_bytes`` at most; a task reads its candidates from the longest to the shortest, in
       blocks.  A query skips a block if its length times the block's largest length is under its bound, and with it all later blocks.
       Else the rotated partial sums over growing parts of the dimensions, with the lengths of the two rests as the bound of what is left,
       leave the few rows whose whole numbers are multiplied.  Bounds rise on the way.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = scratch.cut(vectors.select("vec_id", "v", "norm2"), "vectors")
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    schema = "query_id long, vec_id long, score decimal(38,0)"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, facts["width"])
    rotation = _rotation(rows, width)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(spread, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    sorted_rows = scratch.cut(sorted_rows, "by-length")
    head = sorted_rows.orderBy(F.desc("norm2"), "vec_id").limit(max(k + 1, HEAD_BYTES // (8 * width))).select("vec_id", "v").toArrow()
    head = _Block(*_columns(head, width), width, rotation)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    bounded = scratch.cut(queries.mapInArrow(_first_bounds(head, k, width, rotation), "vec_id long, v array<double>, bound double"), "queries")
    n = bounded.count()
    rounds = max(1, -(-n * 16 * width // round_bytes))
    found = []
    for r in range(rounds):
        asked = bounded.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow()
        if asked.num_rows:
            sent = spark.sparkContext.broadcast((*_columns(asked, width), asked.column("bound").to_numpy()))
            best = sorted_rows.select("vec_id", "v").mapInArrow(_search(sent, k, width, rotation), schema)
            found.append(scratch.cut(_best(best, k), f"round{r}"))
            sent.destroy()
    scratch.drop(rows, sorted_rows, bounded)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    long = F.greatest(F.least("score", F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", long.alias("score"))


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix of the first ``ROTATED`` dimensions: eigenvectors of the second moments, the largest first; later ones stay.

    Moments are summed in the tasks and then by cell, so the driver reads one square matrix of bounded size.
    """
    w = min(width, ROTATED)

    def moments(batches):
        total = np.zeros((w, w))
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                m = _matrix(batch.column(0).slice(a, BLOCK), width)[:, :w]
                # Lengths do not matter for the directions; huge ones would drown the others.
                m = m / np.maximum(1.0, np.abs(m).max(axis=1, keepdims=True))
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(w, dtype=np.int32)), pa.array(list(total))], names=["i", "line"])

    lines = rows.select("v").mapInArrow(moments, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "x"))
    cells = lines.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    square = np.zeros((w, w))
    for c in cells:
        square[c["i"], c["j"]] = c["x"]
    out = np.eye(width)
    out[:w, :w] = np.linalg.eigh(square)[1][:, ::-1]
    return out


def _columns(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("vec_id").to_numpy(), _matrix(rows.column("v").combine_chunks(), width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column, short ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values
    return out


class _Block:
    """Vectors with their rotated form and the lengths of what is left after each cut of the dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, width: int, rotation: np.ndarray):
        self.ids, self.whole = ids, vectors
        self.length = np.sqrt((self.whole**2).sum(axis=1))
        self.turned = self.whole @ rotation
        self.cuts = sorted({max(1, width // 8), max(1, width // 3), width})
        self.left = [np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)) for c in self.cuts]


def _products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of paired whole vectors; doubles are exact below 2^53, Python's integers beyond."""
    if most < _EXACT:
        return (a * b).sum(axis=1)
    big = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return (big(a) * big(b)).sum(axis=1)


def _clip(score: int) -> int:
    return max(-_MOST, min(_MOST, score))


def _below(score: int) -> float:
    """The score as a bound: a double that is not above it."""
    return float(score) if abs(score) < _EXACT else score - abs(score) * 1e-15


class _Queries:
    """The best rows so far of each query of a task, from the bounds it starts with."""

    def __init__(self, block: _Block, bound: np.ndarray, k: int):
        self.block, self.k = block, k
        self.bound = np.array(bound, float)
        self.best: list[list] = [[] for _ in block.ids]

    def meet(self, rows: _Block) -> bool:
        """Takes in a block of candidates; False when no later, shorter one can reach a bound."""
        q, slack = self.block, 1e-9
        reach = q.length * rows.length.max(initial=0.0)
        able = np.flatnonzero(reach * (1 + slack) >= self.bound)
        if not len(able):
            return False
        for a in range(0, len(able), BLOCK):
            self._meet(rows, able[a : a + BLOCK])
        return True

    def _meet(self, rows: _Block, able: np.ndarray) -> None:
        q, slack = self.block, 1e-9
        size = q.length[able][:, None] * rows.length[None, :]
        bound = self.bound[able][:, None] - slack * size
        alive = (size >= bound) & (q.ids[able][:, None] != rows.ids[None, :])
        part = np.zeros(size.shape)
        i = j = None
        for at, (a, b) in enumerate(zip([0, *q.cuts[:-1]], q.cuts, strict=True)):
            if i is None and alive.mean() > 0.05:
                part += q.turned[able, a:b] @ rows.turned[:, a:b].T
                alive &= part + q.left[at][able][:, None] * rows.left[at][None, :] >= bound
                continue
            if i is None:
                i, j = np.nonzero(alive)
                sums, low, n = part[i, j], bound[i, j], able[i]
            else:
                n = able[i]
            for x in range(0, len(i), 1 << 16):
                s = slice(x, x + (1 << 16))
                sums[s] += np.einsum("nd,nd->n", q.turned[n[s], a:b], rows.turned[j[s], a:b])
            keep = sums + q.left[at][n] * rows.left[at][j] >= low
            i, j, sums, low = i[keep], j[keep], sums[keep], low[keep]
        if i is None:
            i, j = np.nonzero(alive)
        for x in range(0, len(i), 1 << 16):
            n, m = able[i[x : x + (1 << 16)]], j[x : x + (1 << 16)]
            score = _products(q.whole[n], rows.whole[m], float(size.max()))
            good = score >= self.bound[n]
            self._take(n[good], rows.ids[m[good]], score[good])

    def _take(self, n: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score, n)) if score.dtype != object else np.array(sorted(range(len(n)), key=lambda x: (n[x], -score[x], ids[x])), int)
        n, ids, score = n[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(n, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(n)], strict=True):
            at, b = int(n[a]), min(b, a + self.k)
            new = [(-int(s), int(i)) for s, i in zip(score[a:b], ids[a:b], strict=True)]
            self.best[at] = sorted(self.best[at] + new)[: self.k]
            if len(self.best[at]) == self.k:
                self.bound[at] = max(self.bound[at], _below(-self.best[at][-1][0]))


def _first_bounds(head: _Block, k: int, width: int, rotation: np.ndarray):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column(0).to_numpy()
                state = _Queries(_Block(ids, _matrix(part.column(1), width), width, rotation), np.full(len(ids), -np.inf), k)
                state.meet(head)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(state.bound)], names=["vec_id", "v", "bound"])

    return run


def _search(sent, k: int, width: int, rotation: np.ndarray):
    def run(batches):
        ids, vectors, bound = sent.value
        state = _Queries(_Block(ids, vectors, width, rotation), bound, k)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if not state.meet(_Block(part.column(0).to_numpy(), _matrix(part.column(1), width), width, rotation)):
                    break  # of this batch only: a task may read several sorted files
        out = [(q, i, _clip(-s)) for q, best in zip(state.block.ids.tolist(), state.best, strict=True) for s, i in best]
        for x in range(0, len(out), 50_000):
            cols = zip(*out[x : x + 50_000], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    return run
