"""Traversal against plain breadth-first search, with a hub."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import features as FT
from codeloom.operators import traverse as T


def bfs(links, seeds, depth):
    seen = {s: 0 for s in seeds}
    level = set(seeds)
    for d in range(1, depth + 1):
        level = {b for a, b in links if a in level} - set(seen)
        seen.update({n: d for n in level})
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    pairs = {(0, n) for n in range(1, 60)} | {(r.randrange(120), r.randrange(120)) for _ in range(90)}
    edges = spark.createDataFrame([("f", a, b, "DFG") for a, b in pairs], "file string, src long, dst long, kind string")
    return pairs, edges


@pytest.mark.parametrize("depth", [1, 3, None])
def test_neighbourhood(spark, graph, depth):
    pairs, edges = graph
    seeds = spark.createDataFrame([("f", 7), ("f", 101), ("f", 7), ("f", 999)], "file string, id long")
    both = pairs | {(b, a) for a, b in pairs}
    got = {r.id: r.depth for r in T.neighbourhood(edges, seeds, depth).collect()}
    assert got == bfs(both, {7, 101, 999}, depth or 200)


def test_depth_only_adds_nodes(spark, graph):
    _, edges = graph
    seeds = spark.createDataFrame([("f", 70)], "file string, id long")
    sets = [{r.id for r in T.neighbourhood(edges, seeds, d).collect()} for d in (1, 2, 3)]
    assert sets[0] <= sets[1] <= sets[2]


def test_blocked_nodes_are_reached_but_not_passed(spark):
    edges = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 1, 4), ("f", 4, 5)], "file string, src long, dst long")
    seeds = spark.createDataFrame([("f", 1)], "file string, id long")
    blocked = spark.createDataFrame([("f", 2)], "file string, id long")
    assert {r.id: r.depth for r in T.reachable(edges, seeds, 9, blocked).collect()} == {1: 0, 2: 1, 4: 1, 5: 2}


def test_a_long_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([("f", i, i + 1) for i in range(40)], "file string, src long, dst long")
    seeds = spark.createDataFrame([("f", 0)], "file string, id long")
    assert {r.id: r.depth for r in T.reachable(edges, seeds).collect()} == {i: i for i in range(41)}


def test_negatives_are_never_the_positive(spark):
    rows = [(f"g{n}", f, a, b) for n in (1, 2, 3, 5) for f, (a, b) in enumerate([(0, 1), (1, 0), (1, 1), (2, 4)]) if max(a, b) < max(n, 2)]
    pos = spark.createDataFrame(rows, "file string, flow long, src_idx long, sink_idx long")
    sizes = spark.createDataFrame([(f"g{n}", n) for n in (1, 2, 3, 5)], "file string, n long")
    got = {}
    for seed in range(30):
        for r in FT.negative_pairs(pos, sizes, seed).collect():
            got.setdefault((r.file, r.flow), set()).add((r.u, r.v))
    for (file, flow), pairs in got.items():
        n = int(file[1:])
        own = next((a, b) for f, w, a, b in rows if (f, w) == (file, flow))
        assert all(u != v and 0 <= u < n and 0 <= v < n for u, v in pairs) and own not in pairs
    assert ("g1", 0) not in got and got[("g2", 0)] == {(1, 0)} and len(got[("g3", 0)]) == 5


def test_two_hop_and_complete_graph(spark):
    nodes = spark.createDataFrame([("f", n) for n in range(5)], "file string, id long")
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 2), ("f", 3, 1)], "file string, src long, dst long")
    got = {(r.src, r.dst) for r in T.two_hop(edges).collect()}
    one_way = {(0, 1), (1, 2), (3, 1), (0, 2), (3, 2)}
    assert got == one_way | {(b, a) for a, b in one_way}
    vals = nodes.withColumn("v", F.col("id") * 1.0)
    want = {n: (10 - n) / 4 for n in range(5)}
    assert {r.id: r.mean_of_others for r in T.mean_of_others(vals, "v").collect()} == want


def test_two_hop_shuffles_no_pairs_of_lone_ends(spark, monkeypatch):
    """Random graphs against plain sets, in small slices; the pairs of a star are not shuffled after their join."""
    monkeypatch.setattr(T, "SLICE", 2)
    r = random.Random(5)
    rows = {(f"g{g}", r.randrange(12), r.randrange(12)) for g in range(12) for _ in range(4 + 2 * g)}
    rows |= {("both", 0, k) for k in range(1, 6)} | {("both", k, 0) for k in range(2, 8)} | {(None, 1, 2), (None, 2, 3)}
    edges = [*rows, ("g0", None, 1), ("g0", 1, None), *list(rows)[:9]]
    e = {(f, a, b) for f, a, b in edges if a is not None and b is not None}
    far = {(f, a, d) for f, a, b in e for g, c, d in e if f is not None and f == g and b == c}
    want = {(f, a, b) for f, a, b in e | far if a != b}
    want |= {(f, b, a) for f, a, b in want}
    got = [tuple(x) for x in T.two_hop(spark.createDataFrame(edges, "file string, src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(T, "SLICE", 64)
    star = [("s", k, 0) for k in range(1, 201)] + [("s", 0, k) for k in range(1001, 1201)]
    df = T.two_hop(spark.createDataFrame(star, "file string, src long, dst long"))
    assert df.count() == 2 * (400 + 200 * 200)
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().children().last().toString()


def test_node_index_with_forced_buckets(spark):
    nodes = spark.createDataFrame([("f" if n % 3 else "g", n * 7) for n in range(100)], "file string, id long")
    want = {}
    for file in "fg":
        ids = sorted(n * 7 for n in range(100) if ("f" if n % 3 else "g") == file)
        want.update({(file, x): i for i, x in enumerate(ids)})
    for limits in ([], [100.0, 350.0, 351.0]):
        assert {(r.file, r.id): r.idx for r in T.node_index(nodes, limits).collect()} == want


@pytest.mark.parametrize("k", [1, 2, 4])
def test_top_pairs_lose_nothing(spark, k):
    r = random.Random(k)
    s = {n: round(r.random(), 3) for n in range(9)}
    t = {n: round(r.random(), 3) for n in range(4, 14)}
    every = sorted(((-(s[a] + t[b]), a, b) for a in s for b in t if a != b))[:k]
    sd = spark.createDataFrame([("f", n, p) for n, p in s.items()], "file string, id long, part double")
    td = spark.createDataFrame([("f", n, p) for n, p in t.items()], "file string, id long, part double")
    got = FT.top_pairs(sd, td, k).orderBy("rank").collect()
    assert [(r.source_id, r.sink_id) for r in got] == [(a, b) for _, a, b in every]
    assert FT.candidate_pair_counts(sd, td).first().pairs == 9 * 10 - 5


def test_augmentation_repeats(spark, graph):
    _, edges = graph
    one, two = FT.dropped_edges(edges).collect(), FT.dropped_edges(edges.repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and 0 < len(one) < edges.count()
    v = spark.createDataFrame([("f", n, [0.0] * 50) for n in range(60)], "file string, id long, vec array<double>")
    x = [y for r in FT.noisy_vectors(v, 1.0).collect() for y in r.vec]
    mean = sum(x) / len(x)
    assert abs(mean) < 0.08 and abs(sum((y - mean) ** 2 for y in x) / len(x) - 1) < 0.1


def directed(links, seeds):
    """Breadth-first search that looks at a node's links once."""
    out, seen, level = {}, {s: 0 for s in seeds}, sorted(seeds)
    for a, b in links:
        out.setdefault(a, []).append(b)
    while level:
        after = []
        for a in level:
            for b in out.get(a, ()):
                if b not in seen:
                    seen[b] = seen[a] + 1
                    after.append(b)
        level = after
    return seen


def frame(spark, links):
    return spark.createDataFrame([("f", a, b) for a, b in links], "file string, src long, dst long")


def test_a_chain_of_thousands_takes_few_rounds(spark, monkeypatch):
    from codeloom.operators import reach as R

    written = []
    monkeypatch.setattr(R, "cut_lineage", lambda df, f=R.cut_lineage: written.append(1) or f(df))
    links = [(i, i + 1) for i in range(5000)] + [(2500, 9000), (9000, 9001), (7000, 7001), (7001, 7002), (7002, 7000), (7002, 7003)]
    seeds = spark.createDataFrame([("f", 0)], "file string, id long")
    assert {r.id: r.depth for r in R.shortest(frame(spark, links), seeds).collect()} == directed(links, {0})
    assert len(written) < 30


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_chains_and_rings(spark, seed):
    r = random.Random(seed)
    links = {(r.randrange(90), r.randrange(90)) for _ in range(70)}
    for start in (200, 300, 400):
        chain = [r.randrange(90), *range(start, start + r.randrange(2, 40)), r.randrange(90)]
        links |= set(zip(chain, chain[1:]))
    links |= {(600, 601), (601, 602), (602, 600)} | {(r.randrange(90), 700), (700, 701), (701, 700)}
    seeds = {r.randrange(90), 210, 999}
    given = spark.createDataFrame([("f", s) for s in seeds], "file string, id long")
    want = directed({(a, b) for a, b in links if a != b}, seeds)
    assert {x.id: x.depth for x in T.reachable(frame(spark, links), given).collect()} == want
    assert {x.id: x.depth for x in T.reachable(frame(spark, links), given, 4).collect()} == {n: d for n, d in want.items() if d <= 4}
    both = links | {(b, a) for a, b in links}
    assert {x.id: x.depth for x in T.neighbourhood(frame(spark, links), given, None).collect()} == directed(both, seeds)


def test_witness_paths_are_shortest_and_of_the_smallest_nodes(spark):
    from codeloom.operators.reach import witness_paths

    r = random.Random(9)
    links = {(r.randrange(60), r.randrange(60)) for _ in range(110)} | {(i, i + 1) for i in range(100, 170)} | {(5, 100)}
    links = {(a, b) for a, b in links if a != b}
    seeds = spark.createDataFrame([("f", 5), ("f", 8)], "file string, id long")
    ends = spark.createDataFrame([("f", i) for i in [*range(60), 170, 5000]], "file string, id long")
    seen = directed(links, {5, 8})
    got = {x.id: x.path for x in witness_paths(frame(spark, links), seeds, ends).collect()}
    assert set(got) == {i for i in [*range(60), 170] if i in seen}
    for i, path in got.items():
        want = [i]
        while seen[want[0]]:
            want.insert(0, min(a for a, b in links if b == want[0] and seen.get(a) == seen[want[0]] - 1))
        assert path == want


def test_no_links_and_no_seeds(spark):
    none = frame(spark, [])
    seeds = spark.createDataFrame([("f", 5)], "file string, id long")
    assert [tuple(r) for r in T.reachable(none, seeds).collect()] == [("f", 5, 0)]
    assert T.reachable(frame(spark, [(1, 2)]), seeds.where("id < 0")).count() == 0
