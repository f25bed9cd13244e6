"""URL rules, chats, decontamination, mixing, token counts, WARC, quality rules and the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from check import compare, duck
from pyspark.sql import functions as F

from codeloom.llm import chat_format as C
from codeloom.llm import decontaminate as D
from codeloom.llm import mixing as M
from codeloom.llm import quality_rules as Q
from codeloom.llm import token_count as T
from codeloom.llm import url_filter as U
from codeloom.llm import warc as R
from codeloom.llm.queries import QUERIES, RULES


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_queries_with_sql(spark, sf, name):
    q = QUERIES[name]
    _, n, same, note = compare(spark, duck(sf), sf, name, q.plan, q.sql)
    assert same is True and n > 0, note


# -- 3


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])]
    path = rest[len(host) :]
    path = path[: min([len(path), *(path.find(c) for c in "?#" if c in path)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for rule, verdict in rules.items():
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(rule[len(h) :]):
            fits.append((-len(rule), rule, verdict))
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, default)


URLS = [
    None, "", "example.net/en/", "http://", "://a", "http://NET/", "http://net", "http://x.net/", "http://xnet/", "https://A.Example.NET/en/x?y#z",
    "https://example.net/en", "http://a.example.com/de/1", "http://example.com/de", "http://wiki.org/fr/?q=1", "http://org/fr/", "http://é.org/fr/ü",
    "http://..net/", "http://a.net:80/", "ftp://u@x.net/p#/q", "http://x.net?/en/", "http://" + "a." * 3000 + "net/" + "p/" * 5000, "a://b://c.net/",
]


@pytest.mark.parametrize("rules", [RULES, {}, {"net": "block", "x.net/p": "allow", "a.net/q": "block", "b.net/": "allow"}])
def test_urls_with_odd_forms(spark, rules):
    rows = [(i, u, "own", "host", i % 2 == 0) for i, u in enumerate(URLS * 2)] + [(None, "http://x.net/", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, host string, listed boolean")
    got = U.filter_urls(pages, rules)
    assert set(pages.columns) <= set(got.columns)
    want = Counter((i, *plain_verdict(u, rules)) for i, u, *_ in rows)
    assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == want
    assert U.filter_urls(pages.limit(0), rules).count() == 0


def test_many_rules_as_a_table_and_filters_that_do_not_fit(spark):
    """Rules in a table, with null ones; little room deals the keys over several cascades, which change nothing."""
    r = random.Random(3)
    hosts = [f"{r.choice(['', 'a.', 'b.c.'])}h{i % 400}.{r.choice(['net', 'org'])}" for i in range(1500)]
    urls = [f"http://{h}/{r.choice(['', 'x/', 'en/x', 'x?q'])}" for h in hosts]
    rules = {f"{h}/{r.choice(['', 'x/', 'en/'])}": r.choice(["allow", "block"]) for h in r.sample(hosts, 500)} | {"net/": "block"}
    pages = spark.createDataFrame(list(enumerate(urls)), "_found long, url string")
    listed = spark.createDataFrame([*rules.items(), *rules.items(), (None, "block"), ("org/", None), ("org/", "Block")], "rule string, verdict string")
    want = {(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)}
    for most in (64 << 20, 200):
        got = U.filter_urls(pages, listed, most_bytes=most)
        assert set(map(tuple, got.select("_found", "host", "path", "rule", "verdict").collect())) == want
    assert {v for *_, v in want} == {"allow", "block"}


def test_cascade_is_exact_in_its_universe(spark):
    listed = {f"k{i}" for i in range(0, 3000, 37)}
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")).withColumn("listed", F.col("key").isin(*listed))
    c = U.build_cascade(keys)
    got = {r.key for r in keys.filter(c.has(F.col("key"))).collect()}
    assert got == listed and len(c.levels) >= 2 and sum(len(x.filter) for x in c.levels) < 600
    large = U._level(keys, 3000, 2.0**-100, 1, 1 << 20)
    assert len(large.filter) == large.bits // 8 > 8 * U.PAGE_WORDS and keys.filter(large.has(F.col("key"), 1)).count() == 3000
    assert sum(x.bit_count() for x in large.filter) > large.bits // 3
    with pytest.raises(ValueError):
        U.build_cascade(keys, most_bytes=8)


# -- 4


def test_chats_read_back(spark):
    texts = ["", None, "plain", "<|end|>", "a\\<|start|>b\\\\", "\\", "<|message|><|end|", "[INST] x [/INST]</s><s>", "<\\s>", "é" * 50_000, "<", "x<"]
    rows = [(c, t, role, texts[(c * 5 + t) % len(texts)], "z") for c in range(6) for t, role in enumerate(["system", "user", "assistant", "assistant", None])]
    rows += rows[:3] + [(None, None, "assistant", "lost", "z"), (9, 1, "<|end|>", "role", "z")]
    kinds = "conv_id long, turn long, role string, text string, piece string"
    part = F.struct(F.lit("text").alias("kind"), "text", *[F.lit(None).alias(n) for n in ("uri", "width", "height", "seconds", "pages")])
    df = spark.createDataFrame(rows, kinds).withColumn("parts", F.array(part).cast(C.PARTS))
    out = C.format_chats(df).select("conv_id", "formatted", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id for r in out} == set(by)
    for r in out:
        turns = [(x.role, x.text) for x in r.turns]
        assert sorted(turns) == sorted((b, c) for _, b, c in by[r.conv_id])
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count("<|start|>") == len(turns) == r.formatted.count("<|end|>")
    assert C.format_chats(df.limit(0)).count() == 0


def test_typed_parts_become_placeholders(spark):
    p = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.5, None),
         ("video", None, "c", None, None, None, None), ("document", None, "d.pdf", None, None, None, 2), ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", p), (1, 1, "assistant", [p[0]]), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts {C.PARTS}")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert got[1].formatted == (
        "<|start|>user<|message|>see <\\|image|><|image|><|audio|><|document|><|image|><|end|><|start|>assistant<|message|>see <\\|image|><|end|>"
    )
    assert [(a.kind, a.uri, a.tokens) for a in got[1].attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "d.pdf", 2048), ("image", None, 0)]
    assert got[1].attached_tokens == 2090 and got[2].formatted == "<|start|>user<|message|><|end|>" and got[2].attached_tokens == 0


# -- 6


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("length", [3, 6, 8, 12, 40, 120, 500])
def test_leaks_of_items_of_every_length_equal_brute_force(spark, length):
    """Verbatim items, three quarters of the words, and 60 % of the words in order with the whole answer; documents of many words of the items."""
    r = random.Random(length)
    common = [f"c{i}" for i in range(60)]
    word = lambda: r.choice(common) if r.random() < 0.5 else f"w{r.randrange(2000)}"
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(length) for _ in range(24)] + [prose(30) for _ in range(4)]
    docs = []
    for item in items:
        at = lambda share: [w if n >= len(item) - 8 or n % 20 < share * 20 else word() for n, w in enumerate(item)]
        docs += [prose(r.randrange(400)) + x + prose(r.randrange(400)) for x in (item, at(0.8), at(0.6), at(0.4))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    coded = lambda w: [x.encode() for x in w]
    want = {(d, i) for d, w in enumerate(docs) for i, item in enumerate(items) if set(item) & set(w) and D.verdict(coded(item), coded(w), 0.75, 0.55)[2]}
    got = set(map(tuple, D.leaks(df, bench, ["doc_id"]).select("row.doc_id", "item_id").collect()))
    assert want <= got and {(4 * i, i) for i in range(len(items))} <= got
    whole = lambda rounds: {r.item_id for r in D.leaks(df, bench, ["doc_id"], **rounds).filter("latent and row.doc_id = 4 * item_id").collect()}
    if length in (12, 40):
        assert len(whole({})) >= 0.9 * len(items)
    assert all(D.verdict(coded(items[i]), coded(docs[d]), 0.7, 0.5)[0] >= 0.5 for d, i in got - want)


def test_lcs_against_the_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(0, 90))] for _ in range(2))
        assert D.lcs(a, b) == plain_lcs(a, b)


def test_leaks_and_paraphrases_are_found(spark, odd, none):
    r = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    word = lambda: r.choice(common) if r.random() < 0.5 else f"w{r.randrange(3000)}"
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, prose(r.randrange(14, 60))) for i in range(40)]
    docs, want = [], set()
    for i, item in items:
        docs.append((i, prose(r.randrange(0, 200)) + item + prose(r.randrange(0, 200))))
        want.add((i, i))
        changed = [word() if n % 7 == 3 and n < len(item) - 9 else w for n, w in enumerate(item)]
        docs.append((100 + i, prose(r.randrange(0, 200)) + changed + prose(r.randrange(0, 200))))
        want.add((100 + i, i))
        docs.append((200 + i, prose(300)))
    rows = [(d, " ".join(w).title() + ".", "x") for d, w in docs] + [(None, None, "x"), (900, "", "x"), (901, "?!", "x"), (902, " ".join(items[3][1]), "x"), (902, " ".join(items[3][1]), "x")]
    want |= {(902, 3)}
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, ""), (79, "!?"), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9")], "item_id long, text string")
    for block, most in ((256, 8192), (16, 8192), (8, 16)):
        got = D.leaks(df, bench, ["doc_id"], block_items=block, round_items=most).select("row.doc_id", "item_id").collect()
        assert set(map(tuple, got)) == want
    kept = D.clean_documents(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {200 + i for i in range(40)} | {None, 900, 901}
    assert D.leaks(none, bench, ["doc_id"]).count() == 0 and D.leaks(df, bench.limit(0), ["doc_id"]).count() == 0
    assert D.clean_documents(odd, bench).count() == odd.count()


def test_latent_space_spans_the_rows(spark):
    import numpy as np

    r = np.random.default_rng(3)
    texts = [" ".join(f"t{j}" for j in r.integers(0, 60, 30)) for _ in range(25)]
    vocabulary = {w: n for n, w in enumerate(sorted({w.encode() for t in texts for w in t.split()}))}
    idf = r.random(len(vocabulary)) + 0.5
    items = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(4)
    a = np.zeros((25, len(vocabulary)))
    for i, t in enumerate(texts):
        for w in t.split():
            a[i, vocabulary[w.encode()]] += idf[vocabulary[w.encode()]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    space = D.latent_space(items, vocabulary, idf, 10, rounds=8)
    _, s, _ = np.linalg.svd(a)
    assert np.allclose(space.T @ space, np.eye(10), atol=1e-6)
    assert np.linalg.norm(a @ space) ** 2 >= 0.99 * (s[:10] ** 2).sum()


# -- 7


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("spread", [1, 40])
def test_mix_meets_its_targets(spark, spread):
    r = random.Random(spread)
    rows = []
    for i in range(1500):
        s = r.choice(["a", "b", "c", "d", "é", None]) if i % 3 else "a"
        rows.append((i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 60) if s != "d" else r.randrange(0, spread)))or None, s, 5, "k"))
    rows += rows[:40] + [(None, "a b", "a", 5, "k"), (None, None, None, 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies string")
    got = M.mix(df).collect()
    size = lambda t: len((t or "").split())
    assert Counter((x.doc_id, x.size) for x in got) == Counter((d, size(t)) for d, t, *_ in rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes, (1, 2, 3), 3.0)
    by_target = {}
    for x in got:
        assert x.taken <= 3 * x.size and x.taken == x.copies * x.size
        by_target.setdefault((x.source_size, round(x.target, 6)), []).append(x.taken)
    assert {k: None for k in by_target} == {(sizes[s], round(target[s], 6)): None for s in sizes}
    for (_, goal), taken in by_target.items():
        assert abs(sum(taken) - goal) <= 60
    again = M.mix(df.repartition(9)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    full = M.mixed_documents(df)
    assert full.columns == df.columns and full.count() == sum(x.copies for x in got)


def test_longer_documents_have_larger_odds(spark):
    rows = [(i, "w " * (4 if i % 2 else 400), "a" if i < 2000 else "b") for i in range(2600)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).collect()
    mean = lambda n: sum(x.copies for x in got if x.size == n and x.doc_id < 2000) / 1000
    assert mean(400) > 2 * mean(4) > 0


def test_mix_of_nothing(spark, none):
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.taken) for r in M.mix(only).collect()} == {(1, 0, 0), (2, 0, 0)}


# -- 8

HARD = ["", " ", "\n\n  \n", "word", "it's we'll", "<|endoftext|>", "a<|endoftext|>b <|endof", " é ü 漢字 " * 50, "x" * 3000, "a" * 40 + " " * 700 + "b", "1234567890 " * 90,
        "tab\t\tnew\r\n line  \n " * 60, ("<|endoftext|>" * 30 + " ") * 9, "=====" * 300 + "  " * 200]


def test_chunks_count_like_the_whole_text():
    tok = T._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    texts = HARD + ["".join(r.choice(HARD)[: r.randrange(1, 60)] for _ in range(60)) for _ in range(60)]
    for t in texts:
        want = len(tok.encode(t, add_special_tokens=False).ids)
        for chunk, overlap in ((64, 32), (100, 27), (257, 64), (1000, 100)):
            assert T.count_by_chunks(tok, t, chunk, overlap, 13) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, odd, odd_texts, none, name):
    path = public_tokenizers.path(name)
    tok = T._tokenizer(path)
    count = (lambda t: len(tok.encode(t))) if name.endswith("model") else (lambda t: len(tok.encode(t, add_special_tokens=False).ids))
    want = Counter((d, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for d, t, _ in odd_texts)
    assert Counter(map(tuple, T.count_tokens(odd, path).collect())) == want
    assert T.count_tokens(none, path).count() == 0


# -- 9


def record(i, kind, url, at, status=200, etag=None, modified=None, digest=None, headers=None):
    return (i, kind, url, at, status, etag, modified, digest, headers or {}, 0, "mine")


def test_revisits(spark):
    rows = [
        record("a", "response", "http://www.X.org/p/?b=2&utm_source=f&a=1#f", 10, etag='"1"', modified="m", digest="d1", headers={"etag": '"1"', "content-type": "t", "date": "1"}),
        record("b", "revisit", "https://x.org/p?a=1&b=2", 20, 304, etag='W/"1"', headers={"date": "2", "content-type": "no", "etag": 'W/"1"'}),
        record("c", "response", "http://x.org/p?a=1&b=2", 20, etag='"2"', digest="d2"), record("c2", "response", "http://x.org/p?a=1&b=2", 20, 404, etag='"9"'),
        record("d", "revisit", "http://x.org/p?a=1&b=2", 20, 304, etag='"2"'), record("e", "revisit", "http://x.org/p?a=1&b=2", 500_000, 304, etag='"2"'),
        record("f", "revisit", "http://x.org/p?a=1&b=2", 500_001, 304), record("g", "revisit", "http://x.org/p?a=1&b=2", 500_002, 304, digest="d1"),
        record("h", "revisit", "http://x.org/other", 5, 304), record("i", "revisit", None, 30, 304), record("j", "revisit", "http://x.org/p", None, 304),
        record("k", "metadata", "http://x.org/p", 5), record(None, None, None, None, None), record("z", "response", "http://x.org/p?a=1&b=2", 20, etag='"2"', digest="d3"),
        record("e", "revisit", "http://x.org/p?a=1&b=2", 500_000, 304, etag='"2"'), record("m", "revisit", "http://x.org/p?a=1&b=2", 15, 304, etag='"1"', modified="n"),
    ]
    df = spark.createDataFrame(rows, R.RECORD + ", carried string")
    for bucket in (86_400, 7, 10**9):
        got = R.resolve_revisits(df, bucket).collect()
        assert Counter((x.record_id, x.verdict, x.resolved_id, x.resolved_digest) for x in got) == Counter(
            [("a", "full", "a", "d1"), ("b", "resolved", "a", "d1"), ("c", "full", "c", "d2"), ("c2", "other", None, None), ("d", "changed", None, None),
             ("e", "resolved", "z", "d3"), ("e", "resolved", "z", "d3"), ("f", "unverified", "z", "d3"), ("g", "changed", None, None), ("h", "orphan", None, None),
             ("i", "orphan", None, None), ("j", "orphan", None, None), ("k", "other", None, None), (None, "other", None, None), ("z", "full", "z", "d3"), ("m", "changed", None, None)]
        )
        assert next(x for x in got if x.record_id == "b").merged == {"etag": 'W/"1"', "content-type": "t", "date": "2"}
        assert all(x.carried == "mine" for x in got)
    assert R.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files_read_back(spark):
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:10Z\r\nContent-Length: 45\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"q\"\r\n\r\nbody WARC/1.1 \r\n\r\nx\r\n\r\n"
    files = spark.createDataFrame([(one + one,), (gzip.compress(one),), (b"",), (None,), (b"WARC/1.1\r\nbroken",), (one[:-20],)], "content binary")
    got = R.read_warc(files).collect()
    assert len(got) == 4 and all(r.status == 200 and r.etag == '"q"' and r.at == 1704067210 and r.headers == {"etag": '"q"'} for r in got)
    block = one.split(b"\r\n\r\n", 1)[1][:45]
    assert got[0].payload_digest == hashlib.md5(block.split(b"\r\n\r\n", 1)[1]).hexdigest()


# -- 10


def plain_features(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_quality_features(spark, odd, odd_texts, none):
    more = [(700, "a b c a b c\n" * 3 + "\u00a0x\u2028y", "s"), (701, "# a | b $$ <x>\n\n#\n#\n", "s"), (702, "x y z\x0bx y\x0cz", "s")]
    df = spark.createDataFrame([(d, t, s, 1, False) for d, t, s in odd_texts + more], "doc_id long, text string, source string, n_words int, kept boolean")
    got = Q.quality(df).collect()
    want = Counter((d, *plain_features(t)) for d, t, _ in odd_texts + more)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert Q.quality(none).count() == 0 and Q.keep_good(df).columns == df.columns


def plain_lines(text, unfinished=60, run_lines=4):
    """Kept lines and the number of lost ones, rule by rule over lists."""
    word = re.compile("[^\\x20\\x09-\\x0D]+")
    ends = tuple(".!?:;\"')]…”»。")
    lines = [x for x in (text or "").split("\n") if word.search(x)]
    done = [x.rstrip(" \t\r\v\f").endswith(ends) or ". " in x for x in lines]
    n = [len(word.findall(x)) for x in lines]
    small = [x.strip(" \t\r\v\f")[:1] in set("abcdefghijklmnopqrstuvwxyz") for x in lines]
    fails = []
    for i, x in enumerate(lines):
        marks = sum(x.count(c) for c in "#*$%&|<>")
        bars = len(re.findall(" (?:[|>/·•»›→]|::)(?= )", x))
        fails.append(
            x in lines[:i] or bars >= 3 or (bars == 2 and n[i] <= 12 and not done[i]) or marks * 10 > n[i] * 3 or x.count("!!") * 10 >= n[i] * 3
            or (n[i] <= 20 and (Q.BOILERPLATE.search(x.encode()) or (Q.FURNITURE.search(x.encode()) and not done[i]))) or (n[i] >= unfinished and not done[i])
        )
    rest = [i for i in range(len(lines)) if not fails[i]]
    wrapped = [n[i] >= 6 and (small[i] or (i + 1 < len(lines) and small[i + 1])) for i in range(len(lines))]
    kept = []
    for is_loose, members in itertools.groupby(rest, lambda i: not done[i] and not wrapped[i]):
        members = list(members)
        kept += [] if is_loose and len(members) >= run_lines else members
    return [lines[i] for i in kept], len(lines) - len(kept)


def test_line_verdicts_equal_the_plain_rules(spark, sf, odd_texts):
    r = random.Random(8)
    ends = [".", "", "", "!!", ":", " and", ","]
    parts = ["Home", "news", "a | b", "x > y", "word", "two words", "p / q", "back to top", "$$", "End. Next", "read more", "é", "a longer stretch of six words"]
    texts = ["\n".join(" ".join(r.choices(parts, k=r.randrange(0, 9))) + r.choice(ends) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    texts += [t for _, t, _ in odd_texts] + [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = Q.judged(df, ["doc_id"], with_text=True).select("row.doc_id", "kept", "base_failed", "n_words", "kept_words", "cleaned", "lost_lines").collect()
    assert len(rows) == len(texts)
    for x in rows:
        lines, lost = plain_lines(texts[x.doc_id])
        words = len(re.findall("[^\\x20\\x09-\\x0D]+", "\n".join(lines)))
        assert (x.cleaned, x.lost_lines, x.kept_words) == ("\n".join(lines), lost, words), texts[x.doc_id]
        assert x.kept == (not x.base_failed and 2 * words >= x.n_words)


def test_menus_crumbs_and_fragments_go_and_wrapped_prose_stays(spark):
    menu = "".join(f"Item{i} Shop{i}\n" for i in range(60))
    crumbs = "".join(f"Home{i} > Shop{i} > Shoes{i}\n" for i in range(30))
    slashes = "".join(f"Home{i} / Shop{i} / Shoes{i}\n" for i in range(30))
    fragments = "".join("Frag" + " ".join(f"w{i}x{j}" for j in range(20)) + "\n" for i in range(10))
    prose = "\n".join(("Some " if i == 0 else "") + " ".join(f"t{i}k{j}" for j in range(12)) for i in range(12)) + "."
    df = spark.createDataFrame(list(enumerate([menu, crumbs, slashes, fragments, prose, prose + "\n" + menu[:90]])), "doc_id long, text string")
    assert {x.doc_id: x.kept for x in Q.quality(df).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}


def test_line_rules(spark, sf):
    prose = "".join(f"Line{i} says{i} what{i} it{i} has{i} to{i} say{i}.\n" for i in range(20))
    cases = {
        1: (prose, True), 2: ("".join(f"HOME{i} | NEWS | MORE | SHOP | HELP\n" for i in range(30)), False),
        3: ("".join(f"AB{i}!! CD{i}!! EF!! GH!! IJ!!\n" for i in range(30)), False), 4: ("".join(f"a{i}$$ b{i}### c&&& d{i}***\n" for i in range(30)), False),
        5: (prose + "Accept cookies\nAll rights reserved\n", True),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.judged(df, ["doc_id"], with_text=True).select("row.doc_id", "kept", "cleaned", "lost_lines").collect()}
    assert {k: r.kept for k, r in got.items()} == {k: w for k, (_, w) in cases.items()}
    assert "cookies" not in got[5].cleaned and got[5].lost_lines == 2
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = Q.quality(docs).join(labels, "doc_id").filter("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in judged}
    assert share[1] >= 0.99 and share[0] <= 0.1


# -- pipeline


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline as P

    odd.select("doc_id", "text", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words in any text here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "repeat_dedup", "decontamination", "source_mix"]
    for docs in (odd, none):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "source", "n_chars"] and got.count() > 0


def test_no_control_string_comes_together_at_a_seam(spark):
    """Every split of every control string over two text parts, also with nothing or an unknown kind between them, reads back."""
    from codeloom.llm import chat_format as C

    names = ["start", "message", "end", "image", "audio", "document", "im_start", "im_end", "endoftext"]
    control = [f"<|{n}|>" for n in names] + ["<s>", "</s>", "[INST]", "[/INST]"]
    splits = [("a " + c[:i], c[i:] + " b") for c in control for i in range(1, len(c))] + [("\\", "<|end|>"), ("<", "|end|>\\"), ("a\\", "\\b")]
    rows, want = [], {}
    for i, (a, b) in enumerate(splits):
        text = lambda t: ("text", t, None, None, None, None, None)
        for k, between in enumerate(([], [text("")], [("video", "x", None, None, None, None, None)], [text(None)])):
            rows.append((i * 10 + k, 0, "user", [text(a), *between, text(b)]))
            want[i * 10 + k] = a + b
    out = C.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {C.PARTS}"))
    got = out.select("conv_id", "formatted", C.read_turns(F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in got} == {c: [t] for c, t in want.items()}
    for r in got:
        body = r.formatted.removeprefix("<|start|>user<|message|>").removesuffix("<|end|>")
        assert not any(c in body for c in control)


def test_broken_warc_files_end_where_they_break(spark):
    """Cut-off and damaged gzip members, lengths in other digits, records longer than the file, odd statuses and times."""
    import gzip

    from codeloom.llm.warc import read_warc

    def record(n, status="200", length=None, date="2024-01-01T00:00:00Z"):
        block = f"HTTP/1.1 {status} OK\r\nETag: e\r\n\r\nbody".encode()
        size = len(block) if length is None else length
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{n}>\r\nWARC-Target-URI: http://h/{n}\r\nWARC-Date: {date}\r\nContent-Length: {size}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    one, two = gzip.compress(record(1)), gzip.compress(record(2) * 50)
    damaged = bytearray(two)
    damaged[-6] ^= 1  # the checksum
    files = [one + two, one + two[:-20], one + bytes(damaged), one + b"junk", two[:5], record(1) + record(2, length="²") + record(3),
             record(1) + record(2, length=10**30), record(1) + record(2, length=500), record(1, status="99999999999"), record(1, date="no"), record(1, date="2024-01-01T00:00:00"), b"", None]
    df = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "n int, content binary")
    got = {i: [(r.record_id, r.status, r.at) for r in read_warc(df.where(F.col("n") == i)).collect()] for i in range(len(files))}
    r1, r2 = ("r1", 200, 1704067200), ("r2", 200, 1704067200)
    assert got[0] == [r1] + [r2] * 50 and got[1][0] == r1 and got[2][:1] == [r1] and len(got[2]) >= 1
    assert got[3] == got[5] == got[6] == [r1] and got[7] == [r1, r2] and got[4] == []
    assert got[8] == [("r1", None, 1704067200)] and got[9] == [("r1", 200, None)] and got[10] == [r1] and got[11] == got[12] == []
