"""Dashboard numbers kept as partial states that changed rows are added to.

A changed row is a row with ``sign``: 1 for a new row or the new version of one, -1 for a removed row or the old version.  States are
sums per key, so the states of any batches of changes add up to those of the whole table, in any order.  A batch has a
folder of its own and is written whole, so a batch that is tried again replaces itself and nothing is counted twice.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.tenancy import SEVERITIES

DAY = ["project_id", "date"]
SUMS = ["scans", "findings", "open", "fixed", "fixed_on_day", *SEVERITIES]


def signed(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The rows of both tables with their sign; an update is its old version in ``removed`` and its new one in ``added``."""
    rows = added.withColumn("sign", F.lit(1).cast("bigint"))
    return rows if removed is None else rows.unionByName(removed.withColumn("sign", F.lit(-1).cast("bigint")))


def day_states(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Sums per project and day of signed scans and findings, with the day's last scan that came and the last that went.

    A finding counts on the day it was made, and in ``fixed_on_day`` on the day it was fixed.  Null projects and days are keys.
    """
    zero, no_time = F.lit(0).cast("bigint"), F.lit(None).cast(scans.schema["created_at"].dataType)

    def rows(df: DataFrame, time: str, sums: dict[str, Column], came: Column = no_time, went: Column = no_time) -> DataFrame:
        counts = [F.coalesce(sums.get(n, zero), zero).alias(n) for n in SUMS]
        return df.select("project_id", F.to_date(time).alias("date"), *counts, came.alias("came"), went.alias("went"))

    sign, at = F.col("sign"), F.col("created_at")
    when = lambda test: F.when(test, sign)
    made = {"findings": sign, "open": when(F.col("status") == "open"), "fixed": when(F.col("status") == "fixed")}
    made |= {s: when(F.col("severity") == s) for s in SEVERITIES}
    every = rows(scans, "created_at", {"scans": sign}, F.when(sign > 0, at), F.when(sign < 0, at))
    every = every.unionByName(rows(findings, "created_at", made))
    every = every.unionByName(rows(findings.where("fixed_at IS NOT NULL"), "fixed_at", {"fixed_on_day": sign}))
    return merged(every)


def merged(*states: DataFrame) -> DataFrame:
    """One row per project and day; tasks add up their own rows before the shuffle."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*DAY).agg(*[F.sum(n).alias(n) for n in SUMS], F.max("came").alias("came"), F.max("went").alias("went"))


def value_states(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: how many signed rows hold a value, so that distinct counts stay exact when rows go."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")
    return rows.select(each, "sign").groupBy("v.column", "v.value").agg(F.sum("sign").alias("n"))


def merged_values(*states: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy("column", "value").agg(F.sum("n").alias("n"))


def cardinalities(values: DataFrame) -> DataFrame:
    """column, distinct: values that some row still holds; null is none."""
    held = F.count_if((F.col("n") > 0) & F.col("value").isNotNull())
    return values.groupBy("column").agg(held.alias("distinct"))


def store_batch(states: DataFrame, folder: str, batch: int) -> None:
    """Writes the states of one batch of changes; the same batch again replaces what it wrote."""
    states.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The states of all batches, not yet merged."""
    return spark.read.parquet(folder).drop("batch")


def last_scans(states: DataFrame, scans: DataFrame) -> DataFrame:
    """project_id, last_scan_at from merged states; days that may have lost their last scan are looked up in ``scans``.

    Only a day whose last removed scan is not older than its last scan is looked up, and only if no later day of the project is certain.
    """
    held = states.where("scans > 0")
    lost = F.col("went") >= F.col("came")
    sure = held.where(~F.coalesce(lost, F.lit(False))).groupBy("project_id").agg(F.max("came").alias("sure"))
    days = held.where(lost).select(F.col("project_id").alias("p"), F.col("date").alias("d"))
    known = sure.select(F.col("project_id").alias("k"), "sure")
    days = days.join(known, F.col("p").eqNullSafe(F.col("k")), "left").where(F.col("sure").isNull() | (F.col("d") >= F.to_date("sure"))).select("p", "d")
    again = scans.join(days, F.col("project_id").eqNullSafe(F.col("p")) & (F.to_date("created_at") == F.col("d")), "left_semi")
    found = again.groupBy("project_id").agg(F.max("created_at").alias("sure"))
    return sure.unionByName(found).groupBy("project_id").agg(F.max("sure").alias("last_scan_at"))


def project_stats(projects: DataFrame, states: DataFrame, scans: DataFrame) -> DataFrame:
    """What ``tenancy.project_stats`` gives, from merged states; ``scans`` is the current table, read for days that lost a scan."""
    totals = states.groupBy("project_id").agg(*[F.sum(n).alias(n) for n in ("scans", "findings", "open", "fixed")])
    zero = F.lit(0).cast("bigint")
    return projects.select("project_id").join(totals, "project_id", "left").join(last_scans(states, scans), "project_id", "left").select(
        "project_id", F.coalesce("scans", zero).alias("total_scans"), F.coalesce("findings", zero).alias("total_findings"),
        F.coalesce("open", zero).alias("open_findings"), F.coalesce("fixed", zero).alias("fixed_findings"), "last_scan_at",
    )


def totals(states: DataFrame) -> DataFrame:
    """One row: the counts of the dashboard over all projects and days."""
    zero = F.lit(0).cast("bigint")
    return states.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in SUMS if n != "fixed_on_day"])


def daily_trend(states: DataFrame, first: Column, last: Column) -> DataFrame:
    """date, scans, findings, fixed for every day of the range, from merged states."""
    counts = states.groupBy("date").agg(F.sum("scans").alias("s"), F.sum("findings").alias("f"), F.sum("fixed_on_day").alias("x"))
    days = states.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    zero = F.lit(0).cast("bigint")
    return days.join(counts, "date", "left").select(
        "date", F.coalesce("s", zero).alias("scans"), F.coalesce("f", zero).alias("findings"), F.coalesce("x", zero).alias("fixed")
    )
