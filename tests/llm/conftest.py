import random

import pytest

COLUMNS = "doc_id long, text string, source string, n_chars long, row string, size int, keys string, f string, d string, t string, kept boolean"


def made(spark, texts):
    """Documents with columns whose names clash with what the operators use inside."""
    rows = [(i, t, s, None if t is None else len(t), "r", 1, "k", "f", "d", "t", False) for i, t, s in texts]
    return spark.createDataFrame(rows, COLUMNS)


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """Copies, near copies, shared passages, empty and null texts, null ids, repeated rows, one long text."""
    r = random.Random(11)
    passage = words(r, 70)
    base = words(r, 400)
    near = base[:]
    near[200] = "changed"
    out = [(i, " ".join(words(r, r.randrange(60, 300))) + ".", f"s{i % 3}") for i in range(20)]
    out += [(20 + i, " ".join(words(r, 40) + passage + words(r, 30)), "s0") for i in range(5)]
    out += [(30, " ".join(base), "s1"), (31, " ".join(base), "s1"), (32, " ".join(near), None), (33, " ".join(base).upper(), "s1")]
    out += [(40, None, "s0"), (41, "", None), (42, "  \n\t ", "s2"), (43, "short é", "s2"), (44, "ab " * 400, "s2")]
    out += [(50, " ".join(base[:120]), "s1"), (50, " ".join(base[:120]), "s1"), (None, " ".join(passage), None), (None, None, None)]
    out += [(60, " ".join(words(r, 9000)) + " " + " ".join(passage), "s0"), (61, "é" * 900 + " x " + "é" * 900, "s1")]
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return made(spark, odd_texts)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
