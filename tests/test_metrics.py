"""Metrics against closed forms and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import metrics as ME


def plain_localisation(pred, true, tolerance):
    matched = 0
    for file in {f for f, _, _ in pred}:
        free = [t for f, _, t in sorted(true, key=lambda r: r[1]) if f == file]
        for f, _, p in sorted(pred, key=lambda r: r[1]):
            if f != file:
                continue
            for t in free:
                if any(abs(a - b) <= tolerance for a in p for b in t):
                    free.remove(t)
                    matched += 1
                    break
    return matched


@pytest.mark.parametrize("seed", range(40))
def test_greedy_equals_a_plain_loop(seed):
    r = random.Random(seed)
    pred, true = ([[r.randrange(80) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(40))] for _ in "pt")
    for tolerance in (0, 3, 90):
        want = plain_localisation([("f", i, x) for i, x in enumerate(pred)], [("f", i, x) for i, x in enumerate(true)], tolerance)
        assert ME._greedy(pred, true, tolerance) == want


def test_greedy_of_a_dense_part_ends():
    """All of 100,000 locations are near each other."""
    r = random.Random(3)
    pred, true = ([[r.randrange(6)] for _ in range(n)] for n in (100_000, 90_000))
    assert ME._greedy(pred, true, 5) == 90_000


@pytest.mark.parametrize("limits", [None, [20.0, 40.0, 41.0, 120.0]])
@pytest.mark.parametrize("seed", [1, 2])
def test_localisation_equals_a_plain_loop(spark, seed, limits):
    r = random.Random(seed)

    def rows(n):
        return [
            ("hot" if r.random() < 0.5 else f"f{r.randrange(4)}", i, [r.randrange(160) for _ in range(r.randrange(1, 4))])
            for i in range(n)
        ]

    pred, true = rows(60), rows(50)
    # spans are what the locations are in practice: a run of lines
    pred = [(f, i, list(range(min(x), min(x) + len(x)))) for f, i, x in pred]
    schema = "file string, ord int, lines array<int>"
    got = ME.localisation(spark.createDataFrame(pred, schema), spark.createDataFrame(true, schema), 2, limits).first()
    n = plain_localisation(pred, true, 2)
    assert got.matched_predictions == n and got.total_predictions == 60 and got.total_ground_truth == 50
    assert got.precision == pytest.approx(n / 60) and got.recall == pytest.approx(n / 50)
    assert got.localization_accuracy == pytest.approx((n / 60 + n / 50) / 2)


def test_localisation_of_empty_sides(spark):
    schema = "file string, ord int, lines array<int>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([("f", 0, [3])], schema)
    for a, b, want in ((none, none, 1.0), (one, none, 0.0), (none, one, 0.0), (one, one, 1.0)):
        r = ME.localisation(a, b, 5, []).first()
        assert (r.precision, r.recall, r.f1, r.localization_accuracy) == (want,) * 4


@pytest.fixture(scope="module")
def pred(spark):
    r = random.Random(9)
    rows = [(r.randrange(2), round(r.random(), 1), "hot" if r.random() < 0.5 else "b") for _ in range(200)]
    rows += [(1, 0.5, "only")] * 3
    return rows, spark.createDataFrame(rows, "y_true int, score double, fw string")


def curve(rows):
    pos = sum(y for y, _ in rows)
    out = []
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y)
        fp = sum(1 for y, s in rows if s >= t and not y)
        out.append((tp / (tp + fp), tp / pos if pos else 0.0))
    return out


@pytest.mark.parametrize("limits", [None, [], [0.25, 0.5, 0.55]])
def test_curve_metrics(pred, limits):
    rows, df = pred
    for fw in ("hot", "b", "only"):
        part = [(y, s) for y, s, f in rows if f == fw]
        points = [(1.0, 0.0)] + curve(part)
        area = sum((r1 - r0) * (p1 + p0) / 2 for (p0, r0), (p1, r1) in zip(points, points[1:]))
        ap = sum((r1 - r0) * p1 for (_, r0), (p1, r1) in zip(points, points[1:]))
        wins = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in part if y for z, b in part if not z]
        roc = sum(wins) / len(wins) if wins else 0.0
        one = df.where(F.col("fw") == fw)
        assert ME.pr_auc(one, None, limits).first().pr_auc == pytest.approx(area)
        assert ME.average_precision(one, None, limits).first().auprc == pytest.approx(ap if wins else 0.0)
        assert ME.auroc(one, None, limits).first().auroc == pytest.approx(roc)
    by = {r.fw: r.pr_auc for r in ME.pr_auc(df, ["fw"], limits).collect()}
    assert set(by) == {"hot", "b", "only"} and by["only"] == pytest.approx(1.0)


def test_undefined_ratios_are_zero(spark):
    p = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = ME.confusion(p).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_ranking_loss_without_pairs_is_squared_error(spark):
    rows = [(0, i, i / 10, 0.5, False, False, False, 0.3) for i in range(4)]
    s = spark.createDataFrame(
        rows, "batch int, pos int, score double, target double, patched boolean, post_patch boolean, synthetic boolean, bandit double"
    )
    r = ME.batch_ranking_loss(s).first()
    assert r.pairs == 0 and r.loss == pytest.approx(sum((i / 10 - 0.5) ** 2 for i in range(4)) / 4)


def test_framework_key(spark):
    rows = [(None, ["flask", "x"]), ("django", ["flask"]), (None, []), (None, None)]
    df = spark.createDataFrame(rows, "a string, b array<string>")
    assert [r[0] for r in df.select(ME.framework_of(F.col("a"), F.col("b"))).collect()] == ["flask", "django", "unknown", "unknown"]
