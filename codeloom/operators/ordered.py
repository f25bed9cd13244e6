"""Ordered computations that stay distributed when a key, or the whole table, is one group.

A plain ``Window.partitionBy(key).orderBy(x)`` sends a key to one task, and a window without a
key sends the table to one task.  Here the order column is cut into buckets at fixed values, the
window runs inside (key, bucket), and a small table with one row per (key, bucket) carries what
the earlier buckets contribute.  Bucket limits are literals, so every branch of a plan agrees on
them and no result depends on where they fall.  Tables of every size take this one path, and a
null key is a key like any other.
"""

import os
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quantile_limits(df: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """At most ``buckets - 1`` increasing values that cut ``col`` into parts of similar size."""
    return _limits(df, col, buckets)[0]


def _limits(df: DataFrame, col: str, buckets: int | None = None, more: tuple[Column, ...] = ()) -> tuple:
    """The limits, and ``more`` aggregates of the same scan: tasks keep a sketch each, which are merged."""
    n = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(n, 2000)
    sketch = F.kll_sketch_agg_double(F.col(col).cast("double"), max(200, 8 * n))
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, at))
    row = df.agg(found.alias("at"), *more).first()
    return sorted(set(row["at"] or ())), *row[1:]


def by_value(
    df: DataFrame, col: str, name: str = "_bucket", limits: list[float] | None = None, tie: str | None = None,
) -> tuple[DataFrame, str]:
    """The rows with a bucket of a DOUBLE column, and the bucket's name.

    Limits come from the data unless given, by one aggregate of the columns that order.  With a ``tie`` column, for the order (col, tie), a value that is a
    limit - every value that holds a bucket's share of the rows is one - is cut again by the tie.
    """
    ends = None
    if limits is None:
        text = tie is not None and isinstance(df.schema[tie].dataType, T.StringType)
        limits, *ends = _limits(df, col, more=(F.min(tie), F.max(tie)) if text else ())
    columns = df.columns
    df = _placed(df, col, name, limits)
    if tie is not None and limits:
        at, cut = f"{name}_t", f"{name}_p"
        df = df.withColumn(at, _tie_value(df, tie, ends))
        df = _placed(df, at, cut, _limits(df, at)[0])
        above = ~F.coalesce(F.col(col).isin(limits), F.lit(True))
        part = F.when(above, F.lit(0)).otherwise(F.col(cut))
        df = df.withColumn(name, F.struct(F.col(name).alias("bucket"), above.alias("above"), part.alias("part")))
        df = df.select(*columns, name)
    return df, name


def _placed(df: DataFrame, col: str, name: str, limits: list[float]) -> DataFrame:
    if not limits:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(
        splits=[float("-inf"), *limits, float("inf")], inputCol=col, outputCol=f"{name}_d", handleInvalid="keep"
    )
    # as in an ascending order nulls come first and NaN comes last
    place = F.when(F.col(col).isNull(), -1).otherwise(F.col(f"{name}_d").cast("int"))
    return cut.transform(df).withColumn(name, place).drop(f"{name}_d")


def _tie_value(df: DataFrame, tie: str, ends: list | None) -> Column:
    """A DOUBLE that keeps the order of a number or a text: a text's next six bytes after what all texts begin with."""
    if not isinstance(df.schema[tie].dataType, T.StringType):
        return F.col(tie).cast("double")
    ends = ends or df.agg(F.min(tie), F.max(tie)).first()
    same = len(os.path.commonprefix([(end or "").encode() for end in ends]))
    six = F.rpad(F.hex(F.substring(F.encode(tie, "UTF-8"), same + 1, 6)), 12, "0")
    return F.conv(six, 16, 10).cast("double")


def by_digest(df: DataFrame, hex_col: str, name: str = "_bucket", digits: int = 3) -> tuple[DataFrame, str]:
    """Buckets of a hex digest: its first ``digits`` digits fill evenly and keep its order.

    A bucket holds a share of 16^-digits of the rows; each group has up to 16^digits rows in the carrying table.
    """
    return df.withColumn(name, F.substring(hex_col, 1, digits)), name


def seconds(df: DataFrame, name: str) -> Column:
    """A time or number column as DOUBLE (seconds since the epoch) that keeps its order.

    Timestamps without a zone are read field by field: a session zone with summer time must not
    reorder them.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * F.lit(86400)
        return day + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
    return c.cast("double")


def _earlier(keys: list[str], bucket: str):
    return _whole(keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)


def _rejoin(local: DataFrame, per_bucket: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    names = [*keys, bucket]
    side = per_bucket.select(
        *[F.col(n).alias(f"_k_{n}") for n in names], *[c for c in per_bucket.columns if c not in names]
    )
    # Without keys there is one row per bucket (a few thousand at most), so a broadcast is bounded.
    side = side if keys else F.broadcast(side)
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names])
    return local.join(side, same, "left").drop(*[f"_k_{n}" for n in names])


def _whole(keys: list[str]):
    return W.partitionBy(*(keys if keys else [F.lit(0)]))


def number_rows(
    df: DataFrame, order: list, bucket: str, keys: list[str] | None = None, name: str = "rn",
    descending_buckets: bool = False,
) -> DataFrame:
    """row_number() over (partition by keys order by order); ``bucket`` must follow the order."""
    return running_sums(df, order, bucket, {name: F.lit(1)}, keys, descending_buckets)


def running_sums(
    df: DataFrame, order: list, bucket: str, sums: dict[str, Column],
    keys: list[str] | None = None, descending_buckets: bool = False,
) -> DataFrame:
    """Inclusive running sums per key.  Rows that tie in ``order`` are summed one by one."""
    keys = list(keys or [])
    rank = f"{bucket}_o"
    df = df.withColumn(rank, -F.col(bucket) if descending_buckets else F.col(bucket))
    inside = W.partitionBy(*keys, rank).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    totals = df.groupBy(*keys, rank).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    w = _earlier(keys, rank)
    before = totals.select(
        *keys, rank, *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    out = _rejoin(local, before, keys, rank)
    kept = [c for c in df.columns if c != rank]
    return out.select(*kept, *[(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def previous_row(
    df: DataFrame, keys: list[str], order: list, bucket: str, take: dict[str, Column]
) -> DataFrame:
    """The values of the row before, per key: lag(1) that survives a key holding most rows.

    ``order`` has to be ascending columns.
    """
    keys, columns = list(keys), df.columns
    df = df.withColumn("_now", F.struct(*[c.alias(n) for n, c in take.items()]))
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn("_lag", F.lag("_now").over(inside))
    tails = df.groupBy(*keys, bucket).agg(
        F.max_by("_now", F.struct(*[F.col(o) for o in order])).alias("_tail")
    )
    carried = tails.select(*keys, bucket, F.lag("_tail").over(_whole(keys).orderBy(bucket)).alias("_carry"))
    out = _rejoin(local, carried, keys, bucket)
    prev = F.coalesce(F.col("_lag"), F.col("_carry"))
    return out.select(*columns, *[prev[n].alias(n) for n in take])


def running_max(
    df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column, name: str
) -> DataFrame:
    """max(value) over the rows before this one, per key; null for the first row."""
    keys = list(keys)
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_in_max", F.max(value).over(inside))
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
    carried = tops.select(*keys, bucket, F.max("_top").over(_earlier(keys, bucket)).alias("_before"))
    out = _rejoin(local, carried, keys, bucket)
    return out.select(*df.columns, F.greatest("_in_max", "_before").alias(name))


def latest_before(
    marked: DataFrame, keys: list[str], order: list[str], value: str, bucket: str, name: str
) -> DataFrame:
    """As-of lookup in one pass: the last non-null ``value`` at or before each row, per key.

    ``marked`` holds definitions (value set) and uses (value null) together; a use that may not
    see a definition at the same place must sort before it.  Linear in the rows: no pairs.
    """
    keys = list(keys)
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_in_last", F.last(value, ignorenulls=True).over(inside))
    # one row per key and bucket; the value is null where a bucket holds no definition
    place = F.when(F.col(value).isNotNull(), F.struct(*[F.col(o) for o in order]))
    tails = marked.groupBy(*keys, bucket).agg(F.max_by(value, place).alias("_tail"))
    carried = tails.select(
        *keys, bucket, F.last("_tail", ignorenulls=True).over(_earlier(keys, bucket)).alias("_carry")
    )
    out = _rejoin(local, carried, keys, bucket)
    return out.select(*marked.columns, F.coalesce("_in_last", "_carry").alias(name))
