"""Conversation prefix trie against a walk over plain sequences."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from codeloom.llm import prefix_trie as P
from codeloom.llm.scratch import Scratch

COLUMNS = "conv_id long, turn long, role string, text string, node long, depth long, length string, d string, top long, weight string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "l", "d", 3, "w") for r in rows], COLUMNS)


def rebuilt(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]
    return out


def brute(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[d, tuple(s[:d])].append(c)
    name = {k: (min(m), k[0]) for k, m in members.items()}
    out, below = {}, defaultdict(list)
    for d, s in members:
        if d:
            below[d - 1, s[:-1]].append((d, s))
    sums = {}
    for k in sorted(members, key=lambda k: -k[0]):
        own = (len(members[k]) - 1) * (len(k[1][-1][1]) if k[0] else 0)
        kids = below[k]
        sums[k] = (sum(sums[x][0] for x in kids) if kids else 1, own + sum(sums[x][1] for x in kids))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(sequences[c]) == k[0])))
        up = name[k[0] - 1, k[1][:-1]][0] if k[0] else None
        out[name[k]] = (up, len(members[k]), len(kids), *sums[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    names = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def run(spark, rows, part):
    scratch = Scratch(spark, "trie")
    turns = scratch.cut(P.numbered_turns(table(spark, rows)), "turns")
    return got(P.prefix_trie(*P.shared_beginnings(turns, scratch), part=part, scratch=scratch))


def conversations(n, seed, wide=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), f"é{r.randrange(wide)}") for c in range(n) for t in range(r.randrange(1, 9))]


@pytest.mark.parametrize("part", [12, 4096])
def test_trie_equals_brute_force(spark, part):
    rows = conversations(130, 3) + [(200 + i, t, "user", "same") for i in range(60) for t in range(5)]
    rows += [(-5, 1, "user", "x"), (-5, 0, None, None), (7_000_000_000, None, "user", "big"), (7_000_000_000, 2, "user", "big")]
    assert run(spark, rows, part) == brute(rebuilt(rows))


def test_odd_rows(spark):
    """Null ids take no part; null turns come first; repeated rows are turns of their own; ties go by role and text."""
    rows = [(None, 1, "user", "gone"), (1, None, "user", "n"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "user", "z"), (1, 0, "user", "z"), (2, None, None, "t")]
    rows += [(i, 0, "user", "first") for i in range(400, 420)] + [(i, 1, None, None) for i in range(400, 420, 2)]
    assert run(spark, rows, 4) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert run(spark, [], 4) == {}


@pytest.mark.parametrize("part", [40, 500])
def test_long_chain_and_stretches(spark, part, monkeypatch):
    """One conversation holds most rows, over many stretches; others part from it at many depths."""
    monkeypatch.setattr(P, "STRETCH", 8)
    long = [("user", f"t{i % 7}") for i in range(300)]
    sequences = {0: long} | {i: long[: i * 29] + [("assistant", f"x{i}")] * 3 for i in range(1, 10)} | {50: [], 51: long[:120]}
    rows = spark.createDataFrame([(c, d, *t, len(s)) for c, s in sequences.items() for d, t in enumerate(s, 1)], "conv_id long, d long, role string, text string, length long")
    convs = spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv_id long, length long")
    assert got(P.prefix_trie(rows, convs, part=part)) == brute(sequences)


def test_packed_ids_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(P, "PACK", 4)
    sequences = {c: [("user", "a")] for c in [*range(-9, 40), 10_000]}
    rows = spark.createDataFrame([(c, 1, "user", "a", 1) for c in sequences], "conv_id long, d long, role string, text string, length long")
    convs = spark.createDataFrame([(c, 1) for c in sequences], "conv_id long, length long")
    assert got(P.prefix_trie(rows, convs)) == brute(sequences)


def test_each_split_halves_the_weight():
    """The centroid's parts hold at most half of the weight, so a chain of n nodes takes about n log n steps."""
    n = 4000
    sums = [[0] * n, [0] * n]
    P._decompose([0] * n, list(range(n)), [0] * n, [n - i for i in range(n)], [[1] * n, list(range(n))], sums)
    assert sums[0] == [n - i for i in range(n)]
    assert sums[1] == [sum(range(i, n)) for i in range(n)]
    assert Counter(sums[0])[1] == 1
