"""Classification, ranking and localisation metrics on prediction tables."""

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from codeloom.operators.ordered import (
    by_value, previous_row, running_max, running_sums,
)


PAIR_BLOCK = 256  # places of a batch whose pairs are added up in one row


def ratio(a: Column, b: Column, undefined: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(undefined))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(precision * recall * 2, precision + recall)


def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with accuracy, precision, recall and F1 of the positive class."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    c = pred.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"))


def per_class(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per true class with precision, recall, F1 and support."""
    by = by or []
    sides = F.array(
        F.struct(F.col("y_true").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")),
    )
    c = pred.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits")
    )
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    return c.where(F.col("support") > 0).select(
        *by, "cls", "support", precision.alias("precision"), recall.alias("recall"),
        f1_of(precision, recall).alias("f1"),
    )


def macro(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted means of the per-class metrics."""
    return per_class(pred, by).groupBy(*(by or [])).agg(
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    )


def framework_of(framework: Column, frameworks: Column) -> Column:
    return F.coalesce(framework, F.try_element_at(frameworks, F.lit(1)), F.lit("unknown"))


def result_scores(results: DataFrame) -> DataFrame:
    """Predictions from inference results: the score is the probability of the vulnerable class."""
    pred = F.coalesce("predicted_vulnerable", "is_vulnerable")
    conf = F.coalesce("confidence", F.lit(0.0))
    return results.select(
        "*", F.col("is_vulnerable").cast("int").alias("y_true"), pred.cast("int").alias("y_pred"),
        F.when(pred, conf).otherwise(1 - conf).alias("score"),
    )


def score_steps(pred: DataFrame, by: list[str] | None = None, limits: list[float] | None = None) -> DataFrame:
    """by, score, tp, fp, pos, neg, all_pos: counts at each threshold, from the highest score down.

    Equal scores are added up first; the running sums then go over distinct scores only and are cut
    into score buckets, so neither one framework nor the whole table ends up in one task.
    """
    by = by or []
    per = pred.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )
    b, bucket = by_value(per, "score", limits=limits)
    run = running_sums(
        b, [F.desc("score")], bucket, {"tp": F.col("pos"), "fp": F.col("neg")}, by, descending_buckets=True
    )
    total = pred.groupBy(*by).agg(
        F.count_if(F.col("y_true") == 1).alias("all_pos"), F.count_if(F.col("y_true") != 1).alias("all_neg")
    )
    if not by:
        return run.crossJoin(F.broadcast(total))  # one row of totals
    total = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], "all_pos", "all_neg")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return run.join(total, same).drop(*[f"_by_{c}" for c in by])


def pr_curve(pred: DataFrame, by: list[str] | None = None, limits: list[float] | None = None) -> DataFrame:
    s = score_steps(pred, by, limits)
    return s.select(
        *(by or []), "score", "pos", "neg", "tp", "fp", "all_pos", "all_neg", "_bucket",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
    )


def pr_auc(pred: DataFrame, by: list[str] | None = None, limits: list[float] | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall curve, started at recall 0 with precision 1."""
    by = by or []
    c = pr_curve(pred, by, limits).withColumn("_down", -F.col("score")).withColumn("_slot", -F.col("_bucket"))
    prev = previous_row(c, by, ["_down"], "_slot", {"p0": F.col("precision"), "r0": F.col("recall")})
    p0, r0 = F.coalesce("p0", F.lit(1.0)), F.coalesce("r0", F.lit(0.0))
    area = (F.col("recall") - r0) * (F.col("precision") + p0) / 2
    return prev.groupBy(*by).agg(F.sum(area).alias("pr_auc"))


def average_precision(pred: DataFrame, by: list[str] | None = None, limits: list[float] | None = None) -> DataFrame:
    """Sum of recall gains times precision; 0 when a class is missing."""
    by = by or []
    c = pr_curve(pred, by, limits)
    gain = ratio(F.col("pos"), F.col("all_pos")) * F.col("precision")
    both = (F.min("all_pos") > 0) & (F.min("all_neg") > 0)
    return c.groupBy(*by).agg(F.when(both, F.sum(gain)).otherwise(0.0).alias("auprc"))


def auroc(pred: DataFrame, by: list[str] | None = None, limits: list[float] | None = None) -> DataFrame:
    """Area under the ROC curve with ties at half weight; 0 when a class is missing."""
    by = by or []
    s = score_steps(pred, by, limits)
    # negatives at a score lose to the positives above it and tie with the positives at it
    won = F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * F.lit(0.5)
    return s.groupBy(*by).agg(
        ratio(F.sum(won), F.max("all_pos") * F.max("all_neg")).alias("auroc")
    )


def ranking_at_k(pred: DataFrame, ks: tuple[int, ...] = (5, 10, 20), order: list | None = None) -> DataFrame:
    """k, recall_at_k, precision_at_k; high risk is target > 0.5 and precision divides by k.

    Only the largest k rows are ordered; the number of high-risk rows is a plain sum.
    """
    order = order or [F.desc("score")]
    high = (F.col("target") > 0.5).cast("int")
    top = pred.withColumn("high", high).orderBy(*order).limit(max(ks))
    # at most max(ks) rows are left, so one window over all of them is bounded
    ranked = top.withColumn("rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
    at = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col("high"))), F.lit(0)).alias(f"h{k}") for k in ks])
    all_high = pred.agg(F.coalesce(F.sum(high), F.lit(0)).alias("total"))
    one = at.crossJoin(all_high)  # one row each
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return one.select("total", F.inline(rows)).select(
        "k",
        F.when(F.col("total") > 0, F.col("hits") / F.col("total")).alias("recall_at_k"),
        (F.col("hits") / F.col("k")).alias("precision_at_k"),
    )


def batch_ranking_loss(samples: DataFrame, margin: float = 1.0) -> DataFrame:
    """batch, pairs, loss: hinge loss over the ordered pairs of each training batch, MSE without pairs.

    ``samples`` holds (batch, pos, score, target, patched, post_patch, synthetic, bandit).  A pair i < j is
    ordered by pre-patch over post-patch, synthetic over original, and analyser scores more than 0.1
    apart.  A batch is never gathered: its rows are cut into blocks of places, and a block of first rows meets a
    block of second rows, with the pairs added up inside the row of the two blocks.
    """
    item = F.struct("pos", "score", "patched", "post_patch", "synthetic", "bandit")
    s = samples.withColumn("_block", F.floor(F.col("pos") / PAIR_BLOCK))
    blocks = s.groupBy("batch", "_block").agg(F.collect_list(item).alias("items"))
    first = blocks.select("batch", F.col("_block").alias("_i"), F.col("items").alias("a"))
    second = blocks.select(F.col("batch").alias("_batch"), F.col("_block").alias("_j"), F.col("items").alias("b"))
    met = first.join(second, F.col("batch").eqNullSafe(F.col("_batch")) & (F.col("_i") <= F.col("_j")))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"))

    def add(acc, test, high, low):
        value = F.greatest(F.lit(0.0), F.lit(margin) - (high["score"] - low["score"]))
        test = F.coalesce(test, F.lit(False))
        return F.struct(
            (acc["n"] + test.cast("bigint")).alias("n"), (acc["s"] + F.when(test, value).otherwise(0.0)).alias("s")
        )

    def pair(acc, i, j):
        acc = add(acc, i["patched"] & ~i["post_patch"] & j["patched"] & j["post_patch"], i, j)
        acc = add(acc, i["synthetic"] & ~j["synthetic"], i, j)
        acc = add(acc, (i["bandit"] - j["bandit"]) > 0.1, i, j)
        return add(acc, (j["bandit"] - i["bandit"]) > 0.1, j, i)

    def later(acc, i):
        return F.aggregate(F.filter("b", lambda j: j["pos"] > i["pos"]), acc, lambda a, j: pair(a, i, j))

    pairs = met.select("batch", F.aggregate("a", zero, later).alias("t"))
    pairs = pairs.groupBy("batch").agg(F.sum("t.n").alias("n"), F.sum("t.s").alias("s"))
    error = (F.col("score") - F.col("target")) * (F.col("score") - F.col("target"))
    mse = samples.groupBy(F.col("batch").alias("_batch")).agg(F.avg(error).alias("mse"))
    both = pairs.join(mse, F.col("batch").eqNullSafe(F.col("_batch")))
    return both.select(
        "batch", F.col("n").alias("pairs"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.col("mse")).alias("loss")
    )


def span_lines(lines: Column, span: Column, line_range: Column) -> Column:
    """Line numbers of a location given as lines, as a span or as a line range."""
    return F.coalesce(
        lines, F.when(span.isNotNull(), F.sequence(span["sl"], span["el"])),
        F.when(line_range.isNotNull(), F.sequence(line_range["start_line"], line_range["end_line"])),
        F.array().cast("array<int>"),
    )


def localisation_matches(
    predicted: DataFrame, actual: DataFrame, tolerance: int = 5, limits: list[float] | None = None
) -> DataFrame:
    """file, part, matched: greedy one-to-one matches of predicted and true locations (parts with any).

    Both sides hold (file, ord, lines).  Locations further apart than the tolerance never meet, so a
    file falls into independent parts at such gaps, and the order-dependent greedy step runs per part.
    The gaps are found with bucketed running maxima, so a file with most rows is split like any other.
    """
    def side(df, name):
        return df.where(F.size("lines") > 0).select(
            "file", F.lit(name).alias("side"), F.col("ord").cast("long").alias("ord"), "lines",
            F.array_min("lines").alias("lo"), F.array_max("lines").alias("hi"),
        )

    both = side(predicted, "pred").unionByName(side(actual, "true"))
    both, slot = by_value(both.withColumn("_x", F.col("lo").cast("double")), "_x", "_slot", limits)
    order = ["lo", "side", "ord"]
    reach = running_max(both, ["file"], order, slot, F.col("hi"), "reach")
    opens = F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + tolerance), 1).otherwise(0)
    parts = running_sums(reach.withColumn("opens", opens), order, slot, {"part": F.col("opens")}, ["file"])
    rows = parts.select("file", "part", "side", "ord", "lines")
    # parts are kept together and in order; each task then reads them one after the other
    rows = rows.repartition("file", "part").sortWithinPartitions("file", "part", "ord")

    def greedy(batches):
        import pandas as pd

        key, pred, true, out = None, [], [], []
        for pdf in batches:
            for file, part, side, lines in zip(pdf["file"], pdf["part"], pdf["side"], pdf["lines"]):
                if (file, part) != key:
                    out.append((key, _greedy(pred, true, tolerance)))
                    key, pred, true = (file, part), [], []
                (pred if side == "pred" else true).append(lines)
            found = [(*k, n) for k, n in out if n]
            out = []
            if found:
                yield pd.DataFrame(found, columns=["file", "part", "matched"])
        n = _greedy(pred, true, tolerance)
        if n:
            yield pd.DataFrame([(*key, n)], columns=["file", "part", "matched"])

    return rows.mapInPandas(greedy, "file string, part bigint, matched bigint")


def _greedy(pred: list, true: list, tolerance: int) -> int:
    """How many of ``pred``, in order, find a true location within the tolerance that is still free and take the first such one.

    Each line knows the first free location on it, and a tree over the lines the smallest of any run of lines, so a
    location costs the logarithm of the part and a dense part is not compared pair by pair.
    """
    if not pred or not true:
        return 0
    at: dict[int, list[int]] = {}
    for i in reversed(range(len(true))):
        for line in set(true[i]):
            at.setdefault(int(line), []).append(i)  # the first location is the last of its list
    lines, none = sorted(at), len(true)
    size = len(lines)
    tree = [none] * size + [at[line][-1] for line in lines]
    for i in reversed(range(1, size)):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    taken, n = bytearray(none), 0
    for location in pred:
        best = none
        for line in location:
            a, b = bisect_left(lines, line - tolerance) + size, bisect_right(lines, line + tolerance) + size
            while a < b:
                if a & 1:
                    best, a = min(best, tree[a]), a + 1
                if b & 1:
                    b -= 1
                    best = min(best, tree[b])
                a, b = a >> 1, b >> 1
        if best == none:
            continue
        taken[best] = 1
        n += 1
        for line in set(true[best]):
            free = at[int(line)]
            while free and taken[free[-1]]:
                free.pop()
            i = bisect_left(lines, line) + size
            tree[i] = free[-1] if free else none
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
    return n


def localisation(
    predicted: DataFrame, actual: DataFrame, tolerance: int = 5, limits: list[float] | None = None
) -> DataFrame:
    """One row: precision, recall, f1, accuracy and counts; 1.0 when both sides are empty."""
    m = localisation_matches(predicted, actual, tolerance, limits).agg(
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched")
    )
    p = predicted.agg(F.count(F.lit(1)).alias("total_predictions"))
    t = actual.agg(F.count(F.lit(1)).alias("total_ground_truth"))
    one = m.crossJoin(p).crossJoin(t)  # one row each
    np, nt = F.col("total_predictions"), F.col("total_ground_truth")
    empty = (np == 0) & (nt == 0)
    precision = F.when(empty, 1.0).otherwise(ratio(F.col("matched"), np))
    recall = F.when(empty, 1.0).otherwise(ratio(F.col("matched"), nt))
    return one.select(
        precision.alias("precision"), recall.alias("recall"),
        F.when(empty, 1.0).otherwise(f1_of(precision, recall)).alias("f1"),
        ((precision + recall) / 2).alias("localization_accuracy"),
        F.col("matched").alias("matched_predictions"), "total_predictions",
        F.col("matched").alias("matched_ground_truth"), "total_ground_truth",
    )
