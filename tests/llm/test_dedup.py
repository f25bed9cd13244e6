"""Substring, suffix and near-duplicate operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import arrays as A
from codeloom.llm import simhash as S
from codeloom.llm import substring_dedup as W
from codeloom.llm import suffix_dedup as X
from codeloom.llm.components import components
from codeloom.llm.scratch import Scratch
from codeloom.operators.similar_sets import in_cells, similar_pairs


def brute_words(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, 1 << 63), d if d is not None else (1 << 63) - 1)
    out = []
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d if d is not None else (1 << 63) - 1):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, window):
    seen = Counter()
    texts = [(t or "").encode() for _, t, *_ in rows]
    for b in texts:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for (d, *_), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_passages_equal_brute_force(odd, odd_texts):
    got = W.dedup_passages(odd).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_words(odd_texts, 50)
    assert sum(r.n_removed for r in got) > 500


def test_passages_in_periodic_and_nested_texts(spark):
    r = random.Random(3)
    a = [f"v{r.randrange(40)}" for _ in range(150)]
    rows = [(5, " ".join(a)), (3, " ".join(a[20:110] + ["x"] + a[:70])), (4, " ".join(["y"] * 120)), (9, " ".join(["y"] * 60)),
            (7, " ".join(a[40:120] + a[60:140])), (1, " ".join(a[90:140])), (2, " ".join(a[89:140]))]
    got = W.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == brute_words(rows, 50)


def test_bytes_equal_brute_force(odd, odd_texts):
    got = X.dedup_bytes(odd, ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_bytes(odd_texts, 400)


@pytest.mark.parametrize("parts", [1, 40])
def test_bytes_with_a_common_passage_over_many_tasks(spark, parts):
    """Left and right edges of a passage that most texts share, in one range of suffixes and in many."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, other = text(700), text(450)
    rows = [(i, text(r.randrange(300)) + passage[r.randrange(3) * 40 :] + text(r.randrange(300))) for i in range(60)]
    rows += [(100 + i, text(90) + other[: 380 + 7 * i] + text(90)) for i in range(9)]
    rows += [(200, "aaaa" * 600), (201, "aaaa" * 120), (202, "ab" * 300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = X.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
        got = got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert Counter(map(tuple, got)) == brute_bytes(rows, 400)


def test_cut_texts_hold_whole_characters(odd):
    got = {r.doc_id: r for r in X.without_repeats(odd).collect() if r.doc_id is not None}
    assert got[61].text.strip("é") == " x " and got[61].n_chars == len(got[61].text)
    assert got[43].text == "short é" and 30 not in got and 31 not in got
    assert X.without_repeats(odd).columns == odd.columns


def test_deep_shallow_order():
    r = random.Random(1)
    words = [bytes(r.choice(b"ab\x00") for _ in range(r.randrange(0, 90))) for _ in range(300)]
    words += [b"x" * 40 + bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12))) for _ in range(200)]
    order, common = X.deep_shallow(words)
    got = [words[i] for i in order]
    assert got == sorted(words) and sorted(order) == list(range(500))
    for a, b, n in zip(got, got[1:], common[1:]):
        full = X.shared(a, b)
        assert n == full or (n == 0 and full <= X.SHALLOW)


def test_minimizers_do_not_depend_on_what_is_around():
    r = np.random.default_rng(2)
    values = r.integers(0, 2**64, 3000, dtype=np.uint64)
    owner = np.repeat([0, 1, 2], 1000)
    got = A.minimizers(values, 20, owner)
    want = {o * 1000 + i + int(np.argmin(values[o * 1000 + i : o * 1000 + i + 20] >> np.uint64(24))) for o in range(3) for i in range(981)}
    assert set(got.tolist()) == want


def brute_prints(rows, k=4):
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return np.array(out, np.uint64)


def brute_groups(near):
    label = np.arange(len(near))
    while True:
        after = np.where(near, label[None, :], len(near)).min(axis=1)
        if (after == label).all():
            return label
        label = after


def test_simhash_equals_brute_force(odd, odd_texts):
    f = brute_prints(odd_texts)
    label = brute_groups(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    ids = [d for d, *_ in odd_texts]
    least = {g: min((ids[i] for i in range(len(ids)) if label[i] == g and ids[i] is not None), default=None) for g in set(label.tolist())}
    want = Counter((d, format(int(x), "016x"), least[g]) for d, x, g in zip(ids, f, label.tolist()))
    assert Counter(map(tuple, S.components_of(odd).collect())) == want


@pytest.mark.parametrize("cell", [4096, 8])
def test_no_link_is_lost_at_the_anchors(spark, cell):
    """Random prints, prints at 4 and 5 bits, and a tight family that fills some anchors; large and small cells."""
    r = np.random.default_rng(7)
    x = r.integers(0, 2**64, 150, dtype=np.uint64)
    flip = lambda v, n: v ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, replace=False).astype(np.uint64))
    f = np.unique(np.concatenate([x, [flip(v, 4) for v in x], [flip(v, 5) for v in x], [flip(x[0], 2) for _ in range(120)]]).astype(np.uint64))
    rows = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "f long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components(S.links(rows, scratch, cell=cell), scratch).collect()}
    label = brute_groups(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    signed = f.view(np.int64)
    least = {g: int(signed[label == g].min()) for g in set(label.tolist())}
    assert {int(v): got.get(int(v), int(v)) for v in signed} == {int(v): least[g] for v, g in zip(signed, label.tolist())}


def test_one_of_each_group_stays(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    rows, want = [], []
    for g in range(25):
        w = [word() for _ in range(r.choice([120, 200, 400]))]
        rows.append((g * 10, " ".join(w)))
        want.append(g * 10)
        for c in range(3):
            v = w[:]
            for _ in range(max(1, len(w) // 150)):
                v[r.randrange(len(v))] = word()
            rows.append((g * 10 + 1 + c, " ".join(v)))
        half = w[: len(w) // 2] + [word() for _ in range(len(w) // 2)]
        rows.append((g * 10 + 9, " ".join(half)))
        want.append(g * 10 + 9)
    rows += [(900, None), (901, ""), (None, "a lone text"), (902, "a lone text")]
    want += [900, 902]
    docs = spark.createDataFrame([(d, t, "s", "x") for d, t in rows], "doc_id long, text string, source string, samples string")
    got = S.keep_one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_a_star_of_variants_is_one_group(spark):
    """Variants that are similar to the base, which is neither first nor last of its buckets, and not to each other; short texts; equal fingerprints."""
    r = random.Random(31)
    base = [f"b{i}" for i in range(200)]
    texts = {1000: " ".join(base)}
    for c in range(300):
        v = base[:]
        at = r.randrange(0, 186)
        v[at : at + 14] = [f"x{c}y{i}" for i in range(14)]
        texts[c] = " ".join(v)
    for g in range(60):
        w = [f"s{g}t{i}" for i in range(r.randrange(9, 30))]
        texts[2000 + 10 * g] = " ".join(w)
        texts[2001 + 10 * g] = " ".join(w[:-1])
        texts[2002 + 10 * g] = " ".join(w + [f"end{g}"])
    rows = list(texts.items())
    sets = [set(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for _, t in rows)]
    close = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    prints = np.array([S.fingerprint(t.encode(), 5) for _, t in rows], np.uint64)
    label = brute_groups(close | (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4))
    want = {min(d for (d, _), x in zip(rows, label) if x == g) for g in set(label.tolist())}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in S.keep_one_of_each(docs).collect()} == want and len(want & set(range(1001))) == 1


@pytest.mark.parametrize("mass", [1 << 19, 300])
def test_all_pairs_of_a_bucket_meet(spark, mass):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = {i: np.unique(np.concatenate([r.choice(base, r.integers(30, 41), replace=False), r.integers(0, 2**63, r.integers(0, 5), dtype=np.uint64)])) for i in range(60)}
    members = spark.createDataFrame([(i, len(s), b) for i, s in sets.items() for b in (1, 2, 3) if b < 3 or i % 2], "node long, n long, bucket long")
    digests = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node long, digests binary")
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j): share(a, b) for i, a in sets.items() for j, b in sets.items() if i < j and share(a, b) >= 0.8}
    got = similar_pairs(in_cells(members, digests, mass), 0.8, every=True).distinct().collect()
    assert 100 < len(want) < 1700 and {(min(x.u, x.v), max(x.u, x.v)): x.similarity for x in got} == want
    links = similar_pairs(in_cells(members, digests, mass), 0.8, every=False).select("u", "v")
    roots = {x.node: x.root for x in components(links, Scratch(spark, "test")).collect()}
    label = brute_groups(np.array([[i == j or (min(i, j), max(i, j)) in want for j in sets] for i in sets]))
    assert [roots.get(i, i) for i in sets] == [int(np.flatnonzero(label == label[i])[0]) for i in sets]


def test_a_shared_passage_of_51_short_words_goes_in_the_pipeline(spark):
    import corpus_pipeline as P

    r = random.Random(17)
    passage = " ".join(f"{r.randrange(10000):04d}" for _ in range(51))
    prose = lambda: " ".join(f"w{r.randrange(4000)}" for _ in range(40))
    texts = [f"{prose()} {passage} {prose()}" for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert len(passage) < 260
    left = [x.text for x in P.repeat_dedup(spark, docs, "").collect()]
    assert len(left) == 3 and not any(passage in t or passage[5:-5] in t for t in left) and all(len(t) < 600 for t in left)
    assert sorted(x.n_removed for x in X.dedup_bytes(docs, ["doc_id"]).collect()) == [0, 0, 0]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}


def test_empty_tables(none):
    assert W.dedup_passages(none).count() == 0
    assert X.dedup_bytes(none, ["doc_id"]).count() == 0
    assert S.components_of(none).count() == 0
    assert S.keep_one_of_each(none).count() == 0
    assert X.without_repeats(none.withColumn("x", F.lit(1))).count() == 0
