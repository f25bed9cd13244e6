"""Exact top-k search against all products in plain Python."""

import math
import random

import numpy as np
import pytest

from codeloom.llm import exact_topk as K

COLUMNS = "vec_id long, embedding array<double>, label int, v string, norm2 string, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "v", "n", "r", "s") for i, e in rows], COLUMNS)


def brute(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for i, v in whole:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
        for r, (s, i) in enumerate(scores[:k], 1):
            out.add((q, r, i, max(-(1 << 63), min((1 << 63) - 1, -s))))
    return out


def got(df):
    rows = df.collect()
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "int", "bigint", "bigint"]
    assert len(rows) == len(set(rows))
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows}


def search(spark, rows, **more):
    return got(K.top_inner_products(K.integer_vectors(table(spark, rows)), "vec_id % 50 = 0", **more))


@pytest.mark.parametrize("round_bytes", [K.ROUND_BYTES, 4096])
def test_search_equals_brute_force(spark, round_bytes, monkeypatch):
    """Long and short vectors, a vector that a third of the rows share, ties; blocks and rounds that are small."""
    monkeypatch.setattr(K, "BLOCK", 37)
    monkeypatch.setattr(K, "HEAD_BYTES", 4000)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=24) * r.exponential()).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 24) for i in range(350)] + [(5000 + i, (np.round(r.normal(size=24)) / 4).tolist()) for i in range(100)]
    random.Random(1).shuffle(rows)
    assert search(spark, rows, round_bytes=round_bytes) == brute(rows)


def test_odd_vectors(spark):
    """Null, NaN and infinite components, null ids, unequal lengths, empty vectors, repeated rows, scores beyond 2^53 and beyond a long."""
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1e12, -1e12]), (50, [1e12, -1e12]), (100, []), (150, [1e9, 1.0 / 256, 0.0, 5.0]), (200, [1e15, 1.0])]
    rows += [(1, [math.nan, 1.0]), (2, [math.inf]), (3, [None, 1.0]), (4, None), (None, [9.0]), (5, [-0.001, 0.001]), (6, [1e9, 2.0 / 256]), (7, [1e9, 2.0 / 256]), (8, [1e9, 3.0 / 256])]
    rows += [(9, [2.0, 2.0, 2.0]), (9, [2.0, 2.0, 2.0]), (10, [1e15])]
    want = brute(rows)
    spread = search(spark, rows)
    # A repeated candidate takes two ranks, of equal id and score.
    assert spread == want


def test_few_rows_and_none(spark):
    assert search(spark, []) == set()
    assert search(spark, [(0, [1.0])]) == set()
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == set()
    assert search(spark, [(50, [1.0]), (2, [-1.0])]) == {(50, 1, 2, -65536)}


def test_bounds_leave_most_products_out():
    """Rotated partial sums and lengths prune: few exact products are made on skewed vectors."""
    r = np.random.default_rng(2)
    v = np.floor(256 * r.normal(size=(4000, 64)) * (0.7 ** np.arange(64))[r.permutation(64)] * r.exponential(size=(4000, 1)))
    order = np.argsort(-(v**2).sum(axis=1))
    v, rotation = v[order], np.linalg.eigh(v.T @ v)[1][:, ::-1]
    made = []
    plain = K._products
    try:
        K._products = lambda a, b, most: made.append(len(a)) or plain(a, b, most)
        state = K._Queries(K._Block(np.arange(80) * 50, v[::50], 64, rotation), np.full(80, -np.inf), 5)
        for a in range(0, 4000, 500):
            state.meet(K._Block(np.arange(a, a + 500), v[a : a + 500], 64, rotation))
    finally:
        K._products = plain
    assert sum(made) < 0.3 * 80 * 4000
    scores = v[::50] @ v.T
    scores[np.arange(80), np.arange(80) * 50] = -np.inf
    assert [[-s for s, _ in b] for b in state.best] == [sorted(s.tolist(), reverse=True)[:5] for s in scores]
