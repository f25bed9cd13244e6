"""Spelling variants against plain counting and comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from codeloom.llm import spelling as S
from codeloom.llm.scratch import Scratch

LETTERS = "abcdexyzàé×ÿ"


def brute_counts(docs):
    total = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return total


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :]))


def brute_groups(counts):
    counts = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if counts[f] >= 2 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


def groups(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, "r", "f") for d, t in rows], "doc_id long, text string, word string, n int, root string, form string")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randrange(4, 11))) for _ in range(120)]
    out = []
    for d in range(1500):
        words = []
        for _ in range(r.randrange(0, 60)):
            w = list(base[min(r.randrange(120), r.randrange(120), r.randrange(120))])
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = r.choice([[], [r.choice(LETTERS)]])
            words.append("".join(w).replace("x", "X") if r.random() < 0.1 else "".join(w))
        out.append((d, r.choice([" ", "-", "1", "\n", "Ω"]).join(words)))
    out += [(None, "Letters letters ÀÉÎõü"), (None, None), (7, ""), (8, "12 34"), (300, "abcde" * 3 + " " + " ".join(["ébauche"] * 5000)), (300, "letters")]
    return out


def test_counts_and_groups_equal_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "HELD", 100)
    counts = S.word_counts(documents(spark, texts))
    want = brute_counts(texts)
    assert {r.word: r.n for r in counts.collect()} == want
    found = groups(S.spelling_groups(counts))
    assert found == brute_groups(want)
    assert sum(f is not None for _, f, *_ in found) > 50


def test_every_edit_of_a_word_is_found(spark):
    """All deletions, insertions and replacements of short and long words, ends included; two edits are not near."""
    rows = Counter()
    for word in ("abcde", "abcdef", "aabbaab", "zzzzz", "éabcéabcd", "abcdefghijk"):
        rows[word] += 100
        for i in range(len(word) + 1):
            for c in "azé":
                rows[word[:i] + c + word[i:]] += 3
                if i < len(word):
                    rows[word[:i] + c + word[i + 1 :]] += 3
            if i < len(word) > 5:
                rows[word[:i] + word[i + 1 :]] += 3
    found = S.spelling_groups(spark.createDataFrame(list(rows.items()), "word string, n long"))
    assert groups(found) == brute_groups(rows)


def test_long_chains_of_forms(spark):
    """Each word's form is the next one, over more steps than a few rounds of halving."""
    chain = ["abcdefghijklmnopqrst"[:i] + "z" * (20 - i) for i in range(20)]
    rows = {w: 3 * 2**i for i, w in enumerate(chain)}
    found = S.spelling_groups(spark.createDataFrame(list(rows.items()), "word string, n long"))
    assert groups(found) == brute_groups(rows)


def test_pairs_come_once(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaaaa", 3), ("aaaab", 9)], "word string, n long")
    pairs = S.near_words(words, Scratch(spark, "spelling")).collect()
    assert sorted(tuple(sorted((p.u, p.v))) for p in pairs) == [("aaaaa", "aaaaaa"), ("aaaaa", "aaaab")]


def test_no_words(spark):
    """Empty table, null texts, words that are too rare or null: no rows."""
    assert groups(S.spelling_groups(S.word_counts(documents(spark, [])))) == set()
    assert groups(S.spelling_groups(S.word_counts(documents(spark, [(1, None), (2, "once upon another")])))) == set()
    assert groups(S.spelling_groups(spark.createDataFrame([(None, 9)], "word string, n long"))) == set()
