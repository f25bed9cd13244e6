"""Bucketed windows give what plain windows give, whatever the buckets, also with one hot key."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(("hot" if r.random() < 0.4 else f"k{r.randrange(6)}"), i, float(r.randrange(200)), r.randrange(9)) for i in range(600)]
    return spark.createDataFrame(data, "k string, i int, x double, v int")


LIMITS = [[], [50.0], [10.0, 11.0, 40.0, 90.0, 150.0], [-5.0, 300.0]]


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums(rows, limits, keys):
    w = W.partitionBy(*(keys or [F.lit(1)])).orderBy("x", "i").rowsBetween(W.unboundedPreceding, 0)
    want = collected(rows.withColumn("s", F.sum("v").over(w)), "i", "s")
    b, bucket = O.by_value(rows, "x", limits=limits)
    assert collected(O.running_sums(b, ["x", "i"], bucket, {"s": F.col("v")}, keys), "i", "s") == want
    down = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("x"), "i")
    want = collected(rows.withColumn("n", F.row_number().over(down)), "i", "n")
    got = O.number_rows(b, [F.desc("x"), F.col("i")], bucket, keys, "n", descending_buckets=True)
    assert collected(got, "i", "n") == want


@pytest.mark.parametrize("limits", LIMITS)
def test_previous_row_and_running_max(rows, limits):
    w = W.partitionBy("k").orderBy("x", "i")
    b, bucket = O.by_value(rows, "x", limits=limits)
    want = collected(rows.withColumn("p", F.coalesce(F.lag("i").over(w), F.lit(-1))), "i", "p")
    got = O.previous_row(b, ["k"], ["x", "i"], bucket, {"p": F.col("i")}).withColumn("p", F.coalesce("p", F.lit(-1)))
    assert collected(got, "i", "p") == want
    want = collected(
        rows.withColumn("m", F.coalesce(F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))), "i", "m"
    )
    got = O.running_max(b, ["k"], ["x", "i"], bucket, F.col("v"), "m").withColumn("m", F.coalesce("m", F.lit(-1)))
    assert collected(got, "i", "m") == want


@pytest.mark.parametrize("limits", LIMITS)
def test_latest_before(rows, limits):
    marked = rows.withColumn("d", F.when(F.col("v") == 0, F.col("i")))
    w = W.partitionBy("k").orderBy("x", "i").rowsBetween(W.unboundedPreceding, 0)
    want = collected(marked.withColumn("l", F.coalesce(F.last("d", True).over(w), F.lit(-1))), "i", "l")
    b, bucket = O.by_value(marked, "x", limits=limits)
    got = O.latest_before(b, ["k"], ["x", "i"], "d", bucket, "l").withColumn("l", F.coalesce("l", F.lit(-1)))
    assert collected(got, "i", "l") == want


def test_limits_from_the_data(rows):
    limits = O.quantile_limits(rows, "x", 8)
    assert 3 <= len(limits) <= 7 and limits == sorted(set(limits))
    assert O.by_value(rows, "x")[1] == "_bucket"
    assert O.quantile_limits(rows.where("i < 0"), "x", 8) == []


def test_null_and_hot_keys_are_keys(spark):
    """Every operator against a plain window, with a null key that holds most rows."""
    data = [(None if i % 3 else f"k{i % 2}", i, float(i * 7 % 40), i % 5) for i in range(120)]
    rows = spark.createDataFrame(data, "k string, i int, x double, v int")
    w = W.partitionBy("k").orderBy("x", "i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("d", F.when(F.col("v") == 0, F.col("i")))
    for limits in ([], [5.0, 20.0]):
        b, bucket = O.by_value(marked, "x", limits=limits)
        got = O.number_rows(b, ["x", "i"], bucket, ["k"], "n")
        got = O.running_sums(got, ["x", "i"], bucket, {"s": F.col("v")}, ["k"])
        got = O.previous_row(got, ["k"], ["x", "i"], bucket, {"p": F.col("i")})
        got = O.running_max(got, ["k"], ["x", "i"], bucket, F.col("v"), "m")
        got = O.latest_before(got, ["k"], ["x", "i"], "d", bucket, "l")
        want = marked.select(
            "i", F.row_number().over(w).alias("n"), F.sum("v").over(upto).alias("s"), F.lag("i").over(w).alias("p"),
            F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"), F.last("d", True).over(upto).alias("l"),
        )
        names = ["i", "n", "s", "p", "m", "l"]
        key = lambda df: sorted(map(repr, df.select(*names).collect()))
        assert key(got) == key(want)


def test_a_hot_value_is_cut_by_its_tie(spark):
    data = [(f"sample-{i:05d}", 5.0 if i % 4 else float(i % 9)) for i in range(400)]
    rows = spark.createDataFrame(data, "name string, x double")
    b, bucket = O.by_value(rows, "x", tie="name")
    want = collected(rows.withColumn("n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("x", "name"))), "name", "n")
    assert collected(O.number_rows(b, ["x", "name"], bucket, None, "n"), "name", "n") == want
    assert b.where("x = 5").select(bucket).distinct().count() > 1


def test_missing_values_keep_their_place(spark):
    data = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 20)) for i in range(60)]
    rows = spark.createDataFrame(data, "i int, x double")
    b, bucket = O.by_value(rows, "x", limits=[3.0, 11.0])
    for order, down in (([F.col("x"), F.col("i")], False), ([F.desc("x"), F.col("i")], True)):
        want = collected(rows.withColumn("n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))), "i", "n")
        assert collected(O.number_rows(b, order, bucket, None, "n", descending_buckets=down), "i", "n") == want


def test_digest_buckets(rows):
    h = rows.withColumn("h", F.sha2(F.col("i").cast("string"), 256))
    w = W.partitionBy(F.lit(1)).orderBy("h")
    want = collected(h.withColumn("n", F.row_number().over(w)), "i", "n")
    b, bucket = O.by_digest(h, "h", digits=2)
    assert bucket and collected(O.number_rows(b, ["h"], bucket, None, "n"), "i", "n") == want


def test_seconds_keep_order_in_a_zone_with_summer_time(spark):
    rows = spark.sql(
        "SELECT i, TIMESTAMP_NTZ '2024-10-27 00:30:00' + make_dt_interval(0, 0, i * 10, 0.5) AS ts FROM (SELECT explode(sequence(0, 30)) AS i)"
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = [r.s for r in rows.select("i", O.seconds(rows, "ts").alias("s")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(abs(b - a - 600) < 1e-6 for a, b in zip(got, got[1:]))
