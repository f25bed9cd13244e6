import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom.operators import best_pairs as BP

ROWS = "file string, id long, a double, b double"


def brute(sources, sinks, k, score):
    out = {}
    for g, i, *s in sources:
        for h, j, *t in sinks:
            if g == h and i != j and g is not None and None not in s and None not in t:
                out.setdefault(g, []).append((-score(s, t), i, j))
    return {(g, n + 1, i, j, -v) for g, rows in out.items() for n, (v, i, j) in enumerate(sorted(rows)[:k])}


def found(spark, sources, sinks, k, score, **more):
    s, t = spark.createDataFrame(sources, ROWS), spark.createDataFrame(sinks, ROWS)
    got = BP.best_pairs(s, t, k, score, ["a", "b"], ["a", "b"], **more).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.file, r["rank"], r.source_id, r.sink_id, r.score) for r in got}


def made(r, n, ids, group=lambda r: "big" if r.random() < 0.7 else f"g{r.randrange(6)}"):
    return [(group(r), i, r.randrange(40) / 8, r.randrange(-20, 20) / 4) for i in r.sample(range(ids), n)]


@pytest.fixture(scope="module")
def sides():
    r = random.Random(3)
    s, t = made(r, 300, 500), made(r, 260, 500)
    s += [("null", 1, None, 2.0), (None, 2, 1.0, 1.0), ("alone", 3, 1.0, 1.0), ("self", 4, 9.0, 9.0)]
    t += [("null", 5, 1.0, 1.0), (None, 6, 1.0, 1.0), ("self", 4, 9.0, 9.0)]
    return s, t


@pytest.mark.parametrize("k, fan", [(1, 8), (7, 3)])
def test_products_and_minima_equal_all_pairs(spark, sides, k, fan):
    score = lambda s, t: F.least(s["a"] * t["a"], s["b"] + t["b"])
    want = brute(*sides, k, lambda s, t: min(s[0] * t[0], s[1] + t[1]))
    assert found(spark, *sides, k, score, fan=fan) == want


def test_a_scorer_that_tells_no_pairs_apart_is_cut_by_ids(spark, sides):
    want = brute(*sides, 4, lambda s, t: 1.0)
    assert found(spark, *sides, 4, lambda s, t: F.lit(1.0)) == want


def test_any_monotone_function_of_python(spark, sides):
    @F.pandas_udf("double")
    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        return (a > 2).astype(float) * 2 + (b > 1).astype(float)

    want = brute(*sides, 3, lambda s, t: float(2 * (s[0] > 2) + (t[1] > 1)))
    assert found(spark, *sides, 3, lambda s, t: steps(s["a"], t["b"])) == want


def test_no_rows_no_pairs(spark, sides):
    assert found(spark, [], sides[1], 3, lambda s, t: s["a"] + t["a"]) == set()
    assert found(spark, [], [], 3, lambda s, t: s["a"] + t["a"]) == set()


def test_most_pairs_are_never_formed(spark, monkeypatch):
    r = random.Random(5)
    one = lambda r: "f"
    s, t = [(g, i, r.random(), r.random()) for g, i, *_ in made(r, 2000, 9000, one)], [(g, i, r.random(), r.random()) for g, i, *_ in made(r, 2000, 9000, one)]
    sizes, cut = [], BP.cut_lineage
    monkeypatch.setattr(BP, "cut_lineage", lambda df: sizes.append((out := cut(df)).count()) or out)
    got = found(spark, s, t, 5, lambda s, t: s["a"] * t["b"] + F.least(s["b"], t["a"]))
    assert got == brute(s, t, 5, lambda x, y: x[0] * y[1] + min(x[1], y[0]))
    assert sum(sizes) < len(s) * len(t) / 20, sizes
