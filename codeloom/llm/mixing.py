"""Mixing sources to target weights: whole copies first, then Pareto order sampling for the rest."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.scratch import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
BITS = 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float, rounds: int | None = None) -> DataFrame:
    """Target of each (source, source_size): weighted shares of the sum, none above ``most`` times its size.

    Sources in order of their code points, null last, take the weights in turn.  The excess of a source that
    reaches its limit is shared by weight among the others, which has a closed form: with sources ordered by
    limit over weight, those up to a place are at their limits and the others share what is left.
    The table has one row per source; its windows are over sources, never over documents.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "weight", F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    t = (
        t.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("limits_before")) / F.col("weights_from"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
        # The first source in this order that stays below its limit sets the level of all after it.
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("limits_before", "level"))).over(whole).getField("level"))
    )
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def _running(df: DataFrame, *order: Column) -> Column:
    w = Window.partitionBy("source_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("words").over(w), F.lit(0))


def shares(
    docs: DataFrame, carry: list[str], weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, class_power: float = 0.25, scratch: Scratch | None = None,
) -> DataFrame:
    """The words each document gives to the mix, next to the ``carry`` columns in the struct ``row``.

    A document's expected number of copies grows with its length class (2^(class_power * class), classes by
    powers of two, at most ``most``), at the level per source that meets the source's target.  Its whole copies are
    certain.  The rest is a fixed-size sample in Pareto order: documents are ranked by u/(1-u) over
    p/(1-p), with u a digest of the row and ``seed`` and p the rest of its copies, and taken in this order until the
    words reach the target; the document at the edge is in if that comes nearer.

    Prefix sums go by three levels of 12 bits of the rank, so only rows within 2^-36 of a source's edge meet in one task,
    whatever the size of the source.  Null texts and texts without words have size 0 and take 0; a null source
    is a source of its own; repeated rows count as often as they occur; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "source",
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key"),
        size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("draw"), F.col("doc_id").alias("tie"),
    )
    rows = scratch.cut(rows, "sizes")
    of_class = F.floor(F.log2(F.col("size") + 1)).cast("int")
    rows = rows.withColumn("class", of_class)
    classes = scratch.cut(rows.groupBy("source", "source_key", "class").agg(F.sum("size").alias("class_size")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, most)

    # Copies per class: min(most, level * 2^(power * class)); at most 64 classes in a source, the longest ones fill first.
    pull = F.pow(F.lit(2.0), F.lit(class_power) * F.col("class"))
    same = classes["source"].eqNullSafe(targets["source"])
    t = classes.join(targets, same).drop(targets["source"]).withColumn("pull", pull)
    down = Window.partitionBy("source_key").orderBy(F.desc("class"))
    t = (
        t.withColumn("filled", F.lit(float(most)) * F.coalesce(F.sum("class_size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weighted", F.sum(F.col("pull") * F.col("class_size")).over(down.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.try_divide(F.col("target") - F.col("filled"), F.col("weighted")))
        .withColumn("free", F.col("level") * F.col("pull") < most)
        .withColumn("level", F.max(F.when(F.col("free"), F.struct("class", "level"))).over(Window.partitionBy("source_key")).getField("level"))
        .withColumn("copies", F.coalesce(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("level") * F.col("pull"))), F.lit(float(most))))
        .withColumn("sure", F.floor(F.col("copies") + 1e-9))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("sure")))
        .withColumn("rest", F.col("target") - F.sum(F.col("sure") * F.col("class_size")).over(Window.partitionBy("source_key")))
    )
    plan = scratch.cut(t.select("source_key", "class", "source_size", "target", "sure", "p", "rest"), "plan")

    unit = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    odds = F.try_divide(unit / (1 - unit), F.try_divide(F.col("p"), 1 - F.col("p")))
    rank = F.floor(odds / (1 + odds) * float(1 << (3 * BITS)))
    # A class without a fractional part has no place in the random order.
    rank = F.when(F.col("p") > 0, F.least(rank, F.lit((1 << (3 * BITS)) - 1)))
    ranked = rows.join(plan, ["source_key", "class"]).withColumn("rank", rank.cast("long"))
    ranked = scratch.cut(ranked.drop("class", "p", "draw"), "ranked")

    edges = plan.groupBy("source_key").agg(F.max("rest").alias("rest")).withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, 4):
        shift = BITS * (3 - level)
        inside = ranked.filter("rank is not null and size > 0").select("source_key", "size", F.shiftright("rank", shift).alias("cell"), F.shiftright("rank", shift + BITS).alias("outer"))
        cells = (
            inside.join(edges.select("source_key", F.col("prefix").alias("outer")), ["source_key", "outer"])
            .groupBy("source_key", "cell").agg(F.sum("size").alias("words"))
        )
        cells = cells.withColumn("running", _running(cells, F.col("cell"))).join(edges.drop("prefix"), "source_key")
        hit = F.col("before") + F.col("running") <= F.col("rest")
        edges = scratch.cut(
            cells.filter(hit).groupBy("source_key").agg(F.max(F.struct("cell", (F.col("before") + F.col("running")).alias("before"))).alias("at"), F.first("rest").alias("rest"))
            .select("source_key", "rest", F.col("at.before").alias("before"), F.col("at.cell").alias("prefix")),
            f"edge{level}",
        )
    edge = edges.select("source_key", F.col("prefix").alias("edge"), "before")
    ranked = ranked.join(edge, "source_key", "left")
    at_edge = ranked.filter("rank = edge and size > 0").withColumn("words", F.col("size"))
    at_edge = at_edge.withColumn("running", F.col("before") + _running(at_edge, F.col("tie").asc_nulls_last(), F.col("size")))
    others = ranked.filter("not (rank <=> edge and edge is not null and size > 0)").withColumn("running", F.lit(None).cast("double"))
    extra = F.when(F.col("rank") < F.col("edge"), 1).when(F.col("running") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    both = others.select("row", "size", "source_size", "target", "sure", "rank", "edge", "rest", "running").unionByName(
        at_edge.select("row", "size", "source_size", "target", "sure", "rank", "edge", "rest", "running")
    )
    copies = F.when(F.col("size") > 0, F.col("sure") + extra).otherwise(0).cast("long")
    return both.select("row", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Size, target and taken words by doc_id; see ``shares``."""
    out = shares(docs, ["doc_id"], **parameters)
    return out.select("row.doc_id", *out.columns[1:])


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns as they came."""
    rows = shares(docs, docs.columns, **parameters).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
