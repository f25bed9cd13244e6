"""Connected components of a link table by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the links (u, v): root is the smallest node that can be reached.

    Each round points the larger neighbours of a node to its smallest one, then a node and its smaller
    neighbours.  No round makes more links than nodes and links before; neighbours are never gathered.  Smallest neighbours are written before they
    are joined, as a hub is a hot join key that adaptive execution splits only between plain exchanges.  Each round is a written table; it
    ends when a round changes nothing.
    """
    cur = scratch.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large, "large")
        smallest = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.withColumnRenamed("m", "v"))
        after = scratch.cut(small.filter("u <> v").distinct(), "links")
        scratch.drop(cur, least, large, smallest)
        cur, before, state = after, state, _state(after)
        if state == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
