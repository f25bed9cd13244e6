"""Classification, ranking and localisation metrics: A16-A19, W1-W4, J9, J15, U4, K5."""

from pyspark.sql import functions as F

from codeloom.operators import metrics as ME
from codeloom.plans.registry import query
from codeloom.plans.views import sql, table, view

_CONF = (
    "SELECT {by}count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp, "
    "count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn, count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions {group}"
)
_RATIOS = (
    "round(accuracy, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, "
    "round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"
)


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(
    "confusion_metrics", "A16",
    sql("predictions") + ", c AS (" + _CONF.format(by="", group="") + f") SELECT tp, fp, fn, tn, {_RATIOS} FROM c",
)
def confusion_metrics(spark, sf):
    return _rounded(ME.confusion(view(spark, sf, "predictions")), "accuracy", "precision", "recall", "f1")


@query(
    "framework_metrics", "A18 A16",
    sql("predictions") + ", c AS (" + _CONF.format(by="framework, ", group="GROUP BY framework") + f") SELECT framework, tp, fp, fn, tn, {_RATIOS} FROM c",
)
def framework_metrics(spark, sf):
    p = view(spark, sf, "predictions")
    p = p.withColumn("framework", ME.framework_of(F.col("framework"), F.array(F.lit("other"))))
    return _rounded(ME.confusion(p, ["framework"]), "accuracy", "precision", "recall", "f1")


_PER_CLASS = (
    ", t AS (SELECT y_true AS cls, count(*) AS support, count(*) FILTER (WHERE y_pred = y_true) AS hits FROM predictions GROUP BY 1), "
    "p AS (SELECT y_pred AS cls, count(*) AS predicted FROM predictions GROUP BY 1), "
    "c AS (SELECT t.cls, support, hits / support AS recall, CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE hits / predicted END AS precision FROM t LEFT JOIN p USING (cls)), "
    "f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c) "
)


@query(
    "per_class_metrics", "A17",
    sql("predictions") + _PER_CLASS + "SELECT cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f",
)
def per_class_metrics(spark, sf):
    return _rounded(ME.per_class(view(spark, sf, "predictions")), "precision", "recall", "f1")


@query(
    "macro_metrics", "A17",
    sql("predictions") + _PER_CLASS + "SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM f",
)
def macro_metrics(spark, sf):
    return _rounded(ME.macro(view(spark, sf, "predictions")), "precision_macro", "recall_macro", "f1_macro")


_STEPS = (
    ", s AS (SELECT score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM predictions GROUP BY score), "
    "r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN all_pos = 0 THEN 0.0 ELSE tp / all_pos END AS recall FROM r) "
)


@query(
    "pr_curve", "W1",
    sql("predictions") + _STEPS + "SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c",
)
def pr_curve(spark, sf):
    c = ME.pr_curve(view(spark, sf, "predictions"))
    return _rounded(c.select("score", "tp", "fp", "precision", "recall"), "precision", "recall")


@query(
    "pr_auc", "W1",
    sql("predictions") + _STEPS
    + "SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(precision) OVER (ORDER BY score DESC), 1) AS p0 FROM c)",
)
def pr_auc(spark, sf):
    return _rounded(ME.pr_auc(view(spark, sf, "predictions")), "pr_auc")


_BY = (
    ", s AS (SELECT framework, score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg FROM predictions GROUP BY 1, 2), "
    "r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY framework) AS all_pos, sum(neg) OVER (PARTITION BY framework) AS all_neg FROM s WINDOW w AS (PARTITION BY framework ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT *, tp / (tp + fp) AS precision, CASE WHEN all_pos = 0 THEN 0.0 ELSE tp / all_pos END AS recall FROM r) "
)


@query(
    "pr_auc_by_framework", "W1 A18",
    sql("predictions") + _BY
    + "SELECT framework, round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY framework ORDER BY score DESC), 0) AS r0, coalesce(lag(precision) OVER (PARTITION BY framework ORDER BY score DESC), 1) AS p0 FROM c) GROUP BY framework",
)
def pr_auc_by_framework(spark, sf):
    return _rounded(ME.pr_auc(view(spark, sf, "predictions"), ["framework"]), "pr_auc")


@query(
    "auroc", "W3",
    sql("predictions") + _STEPS
    + "SELECT round(CASE WHEN max(all_pos) * max(all_neg) = 0 THEN 0.0 ELSE sum(neg * (tp - pos) + neg * pos * 0.5) / (max(all_pos) * max(all_neg)) END, 6) AS auroc FROM r",
)
def auroc(spark, sf):
    return _rounded(ME.auroc(view(spark, sf, "predictions")), "auroc")


@query(
    "auprc", "W4",
    sql("predictions") + _STEPS + "SELECT round(sum(pos / all_pos * precision), 6) AS auprc FROM c",
)
def auprc(spark, sf):
    return _rounded(ME.average_precision(view(spark, sf, "predictions")), "auprc")


@query(
    "ranking_at_k", "W2",
    sql("predictions")
    + ", o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, target > 0.5 AS high FROM predictions) "
    "SELECT k, round(count(*) FILTER (WHERE high AND rn <= k) / count(*) FILTER (WHERE high), 6) AS recall_at_k, round(count(*) FILTER (WHERE high AND rn <= k) / k, 6) AS precision_at_k "
    "FROM o, (VALUES (5), (10), (20)) v(k) GROUP BY k",
)
def ranking_at_k(spark, sf):
    r = ME.ranking_at_k(view(spark, sf, "predictions"), order=[F.desc("score"), F.col("doc_id")])
    return _rounded(r, "recall_at_k", "precision_at_k")


_BATCHES = (
    sql("signals")
    + ", b AS (SELECT sample_id // 16 AS batch, sample_id AS pos, bandit_score AS bandit, patched, post_patch, synthetic, CAST(sample_id % 13 AS DOUBLE) / 13 AS score, CAST(sample_id % 5 AS DOUBLE) / 5 AS target FROM signals), "
    "ij AS (SELECT i.batch, i.score AS si, j.score AS sj, i.patched AND NOT i.post_patch AND j.patched AND j.post_patch AS a, i.synthetic AND NOT j.synthetic AS s, i.bandit - j.bandit AS d FROM b i JOIN b j ON i.batch = j.batch AND i.pos < j.pos), "
    "p AS (SELECT batch, greatest(0, 1 - (si - sj)) AS l FROM ij WHERE a UNION ALL SELECT batch, greatest(0, 1 - (si - sj)) FROM ij WHERE s UNION ALL SELECT batch, greatest(0, 1 - (si - sj)) FROM ij WHERE d > 0.1 UNION ALL SELECT batch, greatest(0, 1 - (sj - si)) FROM ij WHERE d < -0.1), "
    "g AS (SELECT batch, count(*) AS pairs, avg(l) AS loss FROM p GROUP BY batch), m AS (SELECT batch, avg((score - target) * (score - target)) AS mse FROM b GROUP BY batch) "
)


@query(
    "batch_ranking_loss", "J9 K5",
    _BATCHES + "SELECT m.batch, coalesce(pairs, 0) AS pairs, round(coalesce(loss, mse), 6) AS loss FROM m LEFT JOIN g USING (batch)",
)
def batch_ranking_loss(spark, sf):
    s = view(spark, sf, "signals").select(
        F.expr("sample_id div 16").alias("batch"), F.col("sample_id").alias("pos"), F.col("bandit_score").alias("bandit"),
        "patched", "post_patch", "synthetic", F.expr("CAST(sample_id % 13 AS DOUBLE) / 13").alias("score"),
        F.expr("CAST(sample_id % 5 AS DOUBLE) / 5").alias("target"),
    )
    return _rounded(ME.batch_ranking_loss(s), "loss")


_SPANS = (
    "WITH e AS (SELECT 'u' || CAST(user_id AS STRING) AS file, event_id AS ord, event_type, CAST(extract(day FROM ts) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS line FROM events), "
    "p AS (SELECT file, ord, line FROM e WHERE event_type = 'click'), t AS (SELECT file, ord, line FROM e WHERE event_type = 'view'), "
)


def _spans(spark, sf):
    e = table(spark, sf, "events").select(
        F.expr("'u' || CAST(user_id AS STRING)").alias("file"), F.col("event_id").alias("ord"), "event_type",
        F.expr("CAST(extract(day FROM ts) * 1440 + extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT)").alias("line"),
    )
    e = e.withColumn("lines", F.array("line", F.col("line") + 1))
    return e.where("event_type = 'click'"), e.where("event_type = 'view'")


@query(
    "localisation_files", "U4",
    _SPANS + "f AS (SELECT file FROM p UNION SELECT file FROM t) SELECT count(*) AS files FROM f",
)
def localisation_files(spark, sf):
    p, t = _spans(spark, sf)
    return p.select("file").union(t.select("file")).distinct().agg(F.count(F.lit(1)).alias("files"))


@query(
    "localisation", "J15 A19",
    _SPANS.replace("WITH e", "WITH RECURSIVE e")
    + "q AS (SELECT file, ord, line, row_number() OVER (PARTITION BY file ORDER BY ord) AS k FROM p), "
    "near AS (SELECT q.file, q.k, list(t.ord ORDER BY t.ord) AS ords FROM q JOIN t ON t.file = q.file AND t.line BETWEEN q.line - 6 AND q.line + 6 GROUP BY ALL), "
    "turn AS (SELECT file, k, row_number() OVER (PARTITION BY file ORDER BY k) AS step, ords FROM near), "
    "g AS (SELECT file, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT file FROM turn) UNION ALL "
    "SELECT g.file, turn.step, list_concat(taken, list_filter(ords, lambda x: NOT list_contains(taken, x))[1:1]) FROM g JOIN turn ON turn.file = g.file AND turn.step = g.step + 1), "
    "m AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS m FROM (SELECT max(len(taken)) AS n FROM g GROUP BY file)), "
    "c AS (SELECT m, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt FROM m), "
    "r AS (SELECT *, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 THEN 0.0 ELSE m / np END AS p, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE m / nt END AS r FROM c) "
    "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, "
    "round((p + r) / 2, 6) AS localization_accuracy, m AS matched_predictions, np AS total_predictions, m AS matched_ground_truth, nt AS total_ground_truth FROM r",
)
def localisation(spark, sf):
    """Each click, in order, takes the first free view of its user within five minutes; a location is two minutes long."""
    p, t = _spans(spark, sf)
    return _rounded(ME.localisation(p, t, 5), "precision", "recall", "f1", "localization_accuracy")


@query(
    "localisation_totals", "A19",
    _SPANS
    + "n AS (SELECT DISTINCT p.file, p.ord FROM p JOIN t ON p.file = t.file AND abs(p.line - t.line) <= 1) "
    "SELECT (SELECT count(*) FROM p) AS total_predictions, (SELECT count(*) FROM t) AS total_ground_truth, (SELECT count(*) FROM n) > 0 AS any_near",
)
def localisation_totals(spark, sf):
    p, t = _spans(spark, sf)
    m = ME.localisation(p, t, 0)
    return m.select("total_predictions", "total_ground_truth", (F.col("matched_predictions") > 0).alias("any_near"))


@query(
    "single_span_matches", "J15",
    "WITH e AS (SELECT 'd' || CAST(doc_id AS STRING) AS file, CAST(n_chars % 50 AS INTEGER) AS line, CAST(quality * 4 + n_chars % 46 AS INTEGER) AS truth FROM documents JOIN labels USING (doc_id)) "
    "SELECT file, CAST(1 AS BIGINT) AS matched FROM e WHERE abs(line - truth) <= 5",
)
def single_span_matches(spark, sf):
    """One prediction and one true line per file: a match is then a plain distance."""
    e = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.expr("'d' || CAST(doc_id AS STRING)").alias("file"), F.lit(0).alias("ord"),
        F.expr("CAST(n_chars % 50 AS INT)").alias("line"), F.expr("CAST(quality * 4 + n_chars % 46 AS INT)").alias("truth"),
    )
    p = e.select("file", "ord", F.array("line").alias("lines"))
    t = e.select("file", "ord", F.array("truth").alias("lines"))
    return ME.localisation_matches(p, t, 5).where("matched > 0").select("file", "matched")


@query(
    "result_scores", "A16",
    sql("results")
    + "SELECT file_path, CAST(is_vulnerable AS INTEGER) AS y_true, CAST(turn % 2 = 0 AS INTEGER) AS y_pred, round(CASE WHEN turn % 2 = 0 THEN coalesce(confidence, 0.0) ELSE 1 - coalesce(confidence, 0.0) END, 6) AS score FROM results",
)
def result_scores(spark, sf):
    r = view(spark, sf, "results").withColumn("predicted_vulnerable", F.col("turn") % 2 == 0)
    return ME.result_scores(r).select("file_path", "y_true", "y_pred", F.round("score", 6).alias("score"))
