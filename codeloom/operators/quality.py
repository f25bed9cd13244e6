"""Corpus statistics, validation reports and recommendations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import line_count
from codeloom.operators.metrics import ratio

BALANCED_BELOW = 3.0


def label_distribution(labels: DataFrame) -> DataFrame:
    """label, n, percentage; rows without a label do not count."""
    c = labels.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(  # one row of totals
        "label", "n", (F.col("n") * 100.0 / F.col("total")).alias("percentage")
    )


def label_balance(labels: DataFrame) -> DataFrame:
    """One row: total, classes, imbalance (infinite with one class) and whether that is balanced."""
    c = labels.where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a = c.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"),
        F.max("n").alias("most"), F.min("n").alias("least"),
    )
    imbalance = F.when(F.col("classes") > 1, F.col("most") / F.col("least")).otherwise(F.lit(float("inf")))
    return a.select(
        "total", "classes", imbalance.alias("imbalance_ratio"), (imbalance < BALANCED_BELOW).alias("is_balanced")
    )


def pattern_distribution(labels: DataFrame) -> DataFrame:
    """pattern, n, vulnerable, safe; the pattern id or else the type, rows without both left out."""
    key = F.coalesce(F.nullif("pattern_id", F.lit("")), F.nullif("vulnerability_type", F.lit("")), F.lit("unknown"))
    hit = F.coalesce("label", F.lit(0)) == 1
    return labels.withColumn("pattern", key).where("pattern <> 'unknown'").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("vulnerable"), F.count_if(~hit).alias("safe")
    )


def framework_from_path(frameworks: Column, file: Column) -> Column:
    low = F.lower(F.coalesce(file, F.lit("")))
    guess = F.lit("unknown")
    for name in ("fastapi", "django", "flask"):
        guess = F.when(F.contains(low, F.lit(name)), name).otherwise(guess)
    return F.coalesce(F.try_element_at(frameworks, F.lit(1)), guess)


def framework_distribution(graphs: DataFrame) -> DataFrame:
    """framework, n, vulnerable, safe of (file, frameworks, label); label null = not labelled."""
    return graphs.withColumn("framework", framework_from_path(F.col("frameworks"), F.col("file"))).groupBy(
        "framework"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("vulnerable"),
        F.count_if(F.col("label") != 1).alias("safe"),
    )


def rule_hits(nodes: DataFrame) -> DataFrame:
    """what ('source', 'sink', 'sink_kind'), value, n, with a total per what under value null."""
    a = F.col("attrs")
    rows = F.array_compact(
        F.array(
            F.when(a["is_source"] == "true", F.struct(F.lit("source").alias("what"), F.coalesce(a["source_id"], F.lit("unknown")).alias("value"))),
            F.when(a["is_sink"] == "true", F.struct(F.lit("sink").alias("what"), F.coalesce(a["sink_id"], F.lit("unknown")).alias("value"))),
            F.when(a["is_sink"] == "true", F.struct(F.lit("sink_kind").alias("what"), F.coalesce(a["sink_kind"], F.lit("unknown")).alias("value"))),
        )
    )
    hits = nodes.select(F.inline(rows))
    sets = [[F.col("what"), F.col("value")], [F.col("what")]]
    return hits.groupingSets(sets, "what", "value").agg(F.count(F.lit(1)).alias("n"))


def data_origin(labels: DataFrame) -> DataFrame:
    """synthetic, real, unknown counts with shares and the [0.2, 0.8] balance test.

    ``meta_text`` is the label's metadata as text; naming 'synthetic' anywhere makes a row synthetic.
    """
    synthetic = F.contains(F.lower(F.concat_ws(" ", "sample_type", "meta_text")), F.lit("synthetic"))
    named = has_text("repo_url") | has_text("cve_id") | has_text("commit")
    c = labels.agg(
        F.count_if(synthetic).alias("synthetic"), F.count_if(~synthetic & named).alias("real"),
        F.count_if(~synthetic & ~named).alias("unknown"), F.count(F.lit(1)).alias("total"),
    )
    share = ratio(F.col("synthetic"), F.col("total"))
    return c.select(
        "*", (share * 100).alias("synthetic_percentage"),
        (ratio(F.col("real"), F.col("total")) * 100).alias("real_percentage"),
        ((F.col("total") > 0) & share.between(0.2, 0.8)).alias("is_balanced"),
    )


def has_text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _every_graph(per_file: DataFrame, graphs: DataFrame | None) -> DataFrame:
    """One row per graph: those of ``per_file`` and, with nulls, the empty ones of ``graphs`` (file)."""
    if graphs is None:
        return per_file
    names = graphs.select(F.col("file").alias("_file")).distinct()
    return per_file.join(names, F.col("file").eqNullSafe(F.col("_file")), "full").withColumn("file", F.coalesce("file", "_file")).drop("_file")


def graph_sizes(nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """file, nodes, edges; graphs without nodes or edges count 0.

    ``graphs`` (file) names all graphs; a graph without nodes is in no other table.
    """
    n = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("file").agg(F.count(F.lit(1)).alias("edges"))
    sizes = _every_graph(n.join(e, "file", "left" if graphs is None else "full"), graphs)
    return sizes.select("file", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def size_statistics(sizes: DataFrame, columns: tuple[str, ...] = ("nodes", "edges")) -> DataFrame:
    """One row: mean, median, population deviation, minimum and maximum per column.

    The exact median keeps a count per distinct size, and sizes of graphs repeat.
    """
    stats = []
    for c in columns:
        stats += [
            F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.stddev_pop(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
        ]
    return sizes.agg(F.count(F.lit(1)).alias("graphs"), *stats)


def rule_coverage(nodes: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Share of graphs with a source, a sink and a sanitizer, in percent; empty ``graphs`` (file) have none."""
    a = F.col("attrs")

    def has(test):
        return F.max(F.coalesce(test, F.lit(False)).cast("int"))

    per = nodes.groupBy("file").agg(
        has(a["is_source"] == "true").alias("s"), has(a["is_sink"] == "true").alias("t"),
        has(F.coalesce(a["sanitizer_kind"], F.lit("")) != "").alias("z"),
    )
    names = {"s": "source", "t": "sink", "z": "sanitizer"}
    per = _every_graph(per, graphs).fillna(0, list(names))
    return per.agg(
        F.count(F.lit(1)).alias("graphs"),
        *[F.sum(k).alias(f"with_{v}") for k, v in names.items()],
        *[(F.avg(k) * 100).alias(f"{v}_coverage") for k, v in names.items()],
    )


def corpus_cardinalities(records: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return records.agg(
        F.count(F.lit(1)).alias("total_records"), distinct(F.nullif("cve_id", F.lit(""))).alias("unique_cves"),
        distinct(F.coalesce("repo_url", F.lit("\0"))).alias("unique_repos"),
        distinct(F.coalesce("file_path", F.lit("\0"))).alias("unique_files"),
    )


def top_counts(records: DataFrame, key: Column, name: str, k: int | None) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    c = records.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return c if k is None else c.orderBy(F.desc("n"), name).limit(k)


def code_quality(records: DataFrame) -> DataFrame:
    """Records with both texts, and whole-number averages of their lengths and lines."""
    both = (F.coalesce(F.length("code_before"), F.lit(0)) > 0) & (F.coalesce(F.length("code_after"), F.lit(0)) > 0)

    def average(x):
        return F.coalesce(F.floor(F.avg(F.when(both, x))), F.lit(0)).cast("bigint")

    return records.agg(
        F.count_if(both).alias("records_with_code"), F.count_if(~both).alias("records_without_code"),
        average(F.length("code_before")).alias("avg_code_length_before"),
        average(F.length("code_after")).alias("avg_code_length_after"),
        average(line_count(F.col("code_before"))).alias("avg_lines_before"),
        average(line_count(F.col("code_after"))).alias("avg_lines_after"),
    )


def graph_quality(sizes: DataFrame, sample: int | None = None) -> DataFrame:
    """Totals and whole-number averages over non-empty graphs; ``sample`` looks at the first n files."""
    seen = sizes if sample is None else sizes.orderBy("file").limit(sample)
    a = seen.where("nodes > 0").agg(
        F.count(F.lit(1)).alias("valid_graphs"),
        F.coalesce(F.floor(F.avg("nodes")), F.lit(0)).cast("bigint").alias("avg_nodes"),
        F.coalesce(F.floor(F.avg("edges")), F.lit(0)).cast("bigint").alias("avg_edges"),
    )
    return sizes.agg(F.count(F.lit(1)).alias("total_graphs")).crossJoin(a)  # one row each


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """split, label, n with subtotals (null = all)."""
    return samples.rollup("split", "label").agg(F.count(F.lit(1)).alias("n"))


def class_ratios(samples: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return samples.agg(
        n.alias("total_samples"), F.count_if(F.col("label") == 1).alias("vulnerable"),
        F.count_if(F.col("label") == 0).alias("safe"),
        ratio(F.count_if(F.col("label") == 1), n).alias("vulnerable_ratio"),
        ratio(F.count_if(F.col("label") == 0), n).alias("safe_ratio"),
    )


def vulnerable_by(samples: DataFrame, column: str) -> DataFrame:
    """Counts of a column over vulnerable samples."""
    return samples.where(F.col("label") == 1).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merge_report(records: DataFrame) -> DataFrame:
    """type, n with a total row (null) and the synthetic share of each."""
    s = F.count_if(F.coalesce("synthetic", F.lit(False)))
    kind = F.coalesce("vulnerability_type", F.lit("Unknown"))
    return records.select("synthetic", kind.alias("vulnerability_type")).rollup("vulnerability_type").agg(
        F.count(F.lit(1)).alias("n"), s.alias("synthetic"), (s * 100.0 / F.count(F.lit(1))).alias("synthetic_percentage")
    )


def needed_samples(targets: DataFrame, records: DataFrame) -> DataFrame:
    """vulnerability_type, target, current, needed."""
    have = records.where(has_text("vulnerability_type")).groupBy("vulnerability_type").agg(
        F.count(F.lit(1)).alias("current")
    )
    now = F.coalesce("current", F.lit(0))
    return targets.join(have, "vulnerability_type", "left").select(
        "vulnerability_type", "target", now.alias("current"), F.greatest(F.lit(0), F.col("target") - now).alias("needed")
    )


def signal_statistics(signals: DataFrame, first: int | None = None) -> DataFrame:
    """Mean, deviation, extremes of risk and analyser scores; ``first`` keeps that many by sample id."""
    s = signals if first is None else signals.orderBy("sample_id").limit(first)
    stats = []
    for c in ("risk_score", "bandit_score"):
        stats += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return s.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("patched").alias("patched"),
        F.count_if("synthetic").alias("synthetic"), *stats,
    )


def quality_score(summary: DataFrame) -> DataFrame:
    """score, issues, band from (total_records, unique_cves, records_without_code, valid_graphs)."""
    checks = [
        (F.col("total_records") < 10, 30, F.lit("Very few records (< 10)")),
        (F.col("unique_cves") < 3, 20, F.lit("Low CVE diversity (< 3 unique CVEs)")),
        (
            F.col("records_without_code") > F.col("total_records") * 0.1, 15,
            F.format_string("Many records without code (%d/%d)", "records_without_code", "total_records"),
        ),
        (F.col("valid_graphs") == 0, 25, F.lit("No valid graphs found")),
    ]
    lost = sum((F.when(test, points).otherwise(0) for test, points, _ in checks), F.lit(0))
    issues = F.array_compact(F.array(*[F.when(test, text) for test, _, text in checks]))
    score = F.greatest(F.lit(0), 100 - lost)
    band = F.when(score >= 80, "good").when(score >= 60, "acceptable").otherwise("needs improvement")
    return summary.select("*", score.alias("quality_score"), issues.alias("quality_issues"), band.alias("band"))


def diagnosis(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: alignment, imbalance and the recommendations that follow."""
    g = graphs.agg(F.count(F.lit(1)).alias("graph_count"))
    n = labels.agg(F.count(F.lit(1)).alias("label_count"))
    one = g.crossJoin(n).crossJoin(label_balance(labels))  # one row each
    aligned = F.col("graph_count") == F.col("label_count")
    advice = F.array_compact(
        F.array(
            F.when(~aligned, "Fix graph-label alignment"),
            F.when(F.col("imbalance_ratio") > 2, "Use weighted loss function"),
            F.when(F.col("classes") < 2, "Add samples from the missing class"),
        )
    )
    return one.select(
        "graph_count", "label_count", aligned.alias("aligned"),
        F.abs(F.col("graph_count") - F.col("label_count")).alias("difference"), "total", "classes",
        "imbalance_ratio", advice.alias("recommendations"),
    )


def alignment(graphs: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: matched keys and the keys only one side has."""
    g = graphs.select(key, F.lit(1).alias("g"), F.lit(0).alias("l"))
    n = labels.select(key, F.lit(0).alias("g"), F.lit(1).alias("l"))
    per = g.unionByName(n).groupBy(key).agg(F.max("g").alias("g"), F.max("l").alias("l"))
    return per.agg(
        F.count_if((F.col("g") == 1) & (F.col("l") == 1)).alias("matched"),
        F.count_if((F.col("g") == 1) & (F.col("l") == 0)).alias("graphs_only"),
        F.count_if((F.col("g") == 0) & (F.col("l") == 1)).alias("labels_only"),
    )
