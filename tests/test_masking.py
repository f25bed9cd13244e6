"""Masking against the standard library."""

import hashlib
import hmac
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import masking as K
from codeloom.functions import report_text as R
from codeloom.functions import text as X


def plain_mask(text):
    for pattern, label in K.SECRET_PATTERNS:
        text = re.sub(pattern, f"<REDACTED_{label}>", text, flags=re.IGNORECASE)
    text = re.sub(K.URL_PATTERN, "<REDACTED_URL>", text, flags=re.IGNORECASE)
    return re.sub(K.TOKEN_PATTERN, lambda m: f"<REDACTED_TOKEN_{len(m[0])}>", text)


TEXTS = [
    "api_key = 'abcdefghijklmnopqrstuvwx'", 'API-KEY: "ABCDEFGHIJKLMNOPQRSTUVWX" x', "apikey=short",
    "secret_key=" + "s" * 25, "Password : hunter2222 next", "password='a b'", "token=" + "t" * 40, "bearer " + "b." * 15,
    "Bearer " + "b" * 24, "jwt: " + "j.k-" * 14, "-----BEGIN RSA PRIVATE KEY-----", "-----begin  private   key-----",
    "-----BEGIN EC PRIVATE KEY-----", "ssh-rsa AAAA+/b9== me", "AKIA" + "A1" * 8, "akia" + "a" * 16, hashlib.md5(b"x").hexdigest(),
    hashlib.sha1(b"x").hexdigest(), "see HTTPS://x.test/a?b#c 'http://y.z' end", "x" * 31, "x" * 32, "-" + "y-" * 30, "é" + "z" * 40,
    "z" * 40 + "é", "z" * 40 + "-é", "a" * 40 + " " + "a" * 33 + "$" + "a" * 40, "", "größe = 'straße'", "token = \"" + "q" * 20 + "\"\n" + "w" * 50,
]


def test_mask_equals_plain_regex(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.m for r in df.select("i", K.mask_text(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == plain_mask(t), t


def test_masking_again_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("m", K.mask_text(F.col("t")))
    assert df.where(K.mask_text(F.col("m")) != F.col("m")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab-_9é .:='\"\n", min_size=0, max_size=120), min_size=20, max_size=20))
def test_tokens_of_random_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.m for r in df.select("i", K.redact_tokens(F.col("t")).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == re.sub(K.TOKEN_PATTERN, lambda m: f"<REDACTED_TOKEN_{len(m[0])}>", t)


@pytest.mark.parametrize("salt", ["s", "k" * 64, "long" * 40, "schlüssel"])
def test_identifiers_are_hmac(spark, salt):
    names = ["x", "größe", "self", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(K.mask_identifier(F.col("n"), salt)).collect()]
    assert got == ["VAR_" + hmac.new(salt.encode(), n.encode(), hashlib.sha256).hexdigest()[:8] for n in names]


def test_identifier_masking_needs_a_salt():
    with pytest.raises(ValueError):
        K.mask_identifier(F.lit("x"), "")


def test_fingerprint_and_snippet(spark):
    code = "\n".join(f"line {i}" for i in range(1, 21))
    row = spark.range(1).select(
        K.fingerprint(F.lit("o/r"), F.lit("R"), F.lit("f.py"), F.lit("g"), F.lit(7)).alias("fp"),
        *[X.line_window(F.lit(code), F.lit(n), F.lit(n), 5).alias(f"w{n}") for n in (1, 10, 19, 40)],
    ).first()
    assert row.fp == hashlib.sha256(b"o/r:R:f.py:g:7").hexdigest()
    lines = code.split("\n")
    for n in (1, 10, 19, 40):
        assert row[f"w{n}"] == lines[max(0, n - 6) : min(20, n + 5)]


def test_percent_like_python(spark):
    values = [i / 1000 for i in range(0, 1001, 5)] + [0.2865, 0.28649, 0.0005, 0.9995, 1.0, 0.12345]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.p for r in df.select("i", R.percent(F.col("v")).alias("p")).collect()}
    assert got == {i: f"{v:.1%}" for i, v in enumerate(values)}


def test_line_counts_like_python(spark):
    texts = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\n", "a b", "\n", "a\x0bb\x0cc\x1d", "x\x85y", "a\n\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", X.line_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(t.splitlines()) for i, t in enumerate(texts)}


def test_types_and_identifiers_of_messages(spark):
    cases = {
        "Fix ReDoS in parser": "DoS", "use prepared statement": "SQL Injection", "bump md5 lib, code injection": "Cryptographic Weakness",
        "nothing here": None, "XSS and CSRF": "XSS", "..\\ in path": "Path Traversal", "EVAL() removed": "Code Injection",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", X.vulnerability_type(F.col("t")).alias("v")).collect()} == cases
    r = spark.range(1).select(
        X.cve_id(F.lit("see cve-2021-12345 and CVE-2020-1")).alias("a"), X.cwe_id(F.lit("cwe79, CWE-80")).alias("b"),
        X.cve_id(F.lit("none")).alias("c"),
    ).first()
    assert tuple(r) == ("CVE-2021-12345", "CWE79", None)


def test_reclassification_keeps_the_original_only_when_it_changes(spark):
    df = spark.createDataFrame([("XSS", "sql injection"), ("XSS", "xss"), ("XSS", "none"), (None, "xss")], "t string, d string")
    new, old = X.reclassified_type(F.col("t"), F.col("d"))
    assert [tuple(r) for r in df.select(new, old).collect()] == [("SQL Injection", "XSS"), ("XSS", None), ("XSS", None), ("XSS", None)]


def test_repository_and_subject_forms(spark):
    urls = {
        "https://github.com/o/r": ("o", "r"), "https://www.github.com/o/r/tree/x?y": ("o", "r"), "http://github.com/o": None,
        "https://gitlab.com/o/r": None, "not a url": None, "https://github.com/o/r/": ("o", "r"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = {r.u: tuple(r.o) if r.o else None for r in df.select("u", X.owner_and_repo(F.col("u")).alias("o")).collect()}
    assert got == urls
    subjects = {"repo:o/r:ref:x": ("o", "r"), "repo:o/r": ("o", "r"), "repo:o": None, "user:o/r": None, "repo": None, "repo:a/b/c": None}
    df = spark.createDataFrame([(u,) for u in subjects], "u string")
    got = {r.u: tuple(r.o) if r.o else None for r in df.select("u", X.subject_repo(F.col("u")).alias("o")).collect()}
    assert got == subjects
