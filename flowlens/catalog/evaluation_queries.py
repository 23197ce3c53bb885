"""Measures on a rule predictor, so that every result is exact before any model exists."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import WITH_CLEAN, flows, vectors
from flowlens.functions.labels import benign_flag, code_by_list, one_hot
from flowlens.operators import curves, evaluation as e
from flowlens.operators.align import align_scores, align_truth
from flowlens.operators.cleaning import clean_flows
from flowlens.operators.ensemble import ensemble_argmax
from flowlens.operators.reconstruction import class_mean_error, mean_arrays, mean_squared_difference

# A rule that is right often but not always, per class; both engines evaluate it.
_RULE = """CASE WHEN f_value < 90 THEN 'BENIGN' WHEN f_value < 160 THEN 'DoS Hulk' WHEN f_value < 190 THEN 'PortScan'
    WHEN f_value < 240 THEN 'Web Attack - XSS' ELSE 'Bot' END"""
_CLASSES = ["BENIGN", "Bot", "DoS Hulk", "PortScan", "Web Attack - Brute Force", "Web Attack - XSS"]


def _clean(spark, sf_dir) -> DataFrame:
    return clean_flows(flows(spark, sf_dir), ["f_dirty"])


def _ruled(spark, sf_dir) -> DataFrame:
    return _clean(spark, sf_dir).withColumn("prediction", F.expr(_RULE))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_RULED = f"{WITH_CLEAN}, ruled AS (SELECT *, {_RULE} AS prediction FROM clean)"
_CLASSES_SQL = f"""{_RULED}, classes AS (SELECT label AS class FROM ruled UNION SELECT prediction FROM ruled),
    sums AS (SELECT class, (SELECT count(*) FROM ruled WHERE label = class) AS support,
        (SELECT count(*) FROM ruled WHERE prediction = class) AS predicted,
        (SELECT count(*) FROM ruled WHERE prediction = class AND label = class) AS hits FROM classes),
    per_class AS (SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
        CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0.0 END AS f1, support FROM sums),
    total AS (SELECT 'avg / total' AS class, sum(precision * support) / sum(support) AS precision,
        sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1,
        CAST(sum(support) AS BIGINT) AS support FROM per_class)"""
_SCORES = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("classification_report", f"""{_CLASSES_SQL} SELECT class, {_SCORES}, support FROM
    (SELECT * FROM per_class UNION ALL SELECT * FROM total)""")
def classification_report(spark, sf_dir):
    return _rounded(e.report(_ruled(spark, sf_dir)), "precision", "recall", "f1")


@query(
    "prf_macro",
    f"""{_CLASSES_SQL} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
    round(avg(f1), 6) AS f1 FROM per_class""",
)
def prf_macro(spark, sf_dir):
    return _rounded(e.macro(e.per_class(e.confusion(_ruled(spark, sf_dir)))), "precision", "recall", "f1")


@query("prf_weighted", f"{_CLASSES_SQL} SELECT {_SCORES}, support FROM total")
def prf_weighted(spark, sf_dir):
    return _rounded(e.weighted(e.per_class(e.confusion(_ruled(spark, sf_dir)))), "precision", "recall", "f1")


_CELLS = " UNION ALL ".join(
    f"SELECT CAST(label = '{c}' AS INT) AS t, CAST(prediction = '{c}' AS INT) AS p FROM ruled WHERE f_k >= 10" for c in _CLASSES
) + "".join(f" UNION ALL SELECT CAST(label = '{c}' AS INT), 0 FROM ruled WHERE f_k < 10" for c in _CLASSES)


@query(
    "prf_micro",
    f"""{_RULED}, cells AS ({_CELLS}), s AS (SELECT sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM cells)
    SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
        round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
)
def prf_micro(spark, sf_dir):
    # Rows with a small f_k have no class above one half: none of their cells is predicted.
    df = _ruled(spark, sf_dir).withColumn("prediction", F.when(F.col("f_k") >= 10, F.col("prediction")))
    hot = one_hot(one_hot(df, "label", _CLASSES, "t_"), "prediction", _CLASSES, "p_")
    micro = e.micro(hot, [f"t_{c}" for c in _CLASSES], [f"p_{c}" for c in _CLASSES])
    return _rounded(micro, "precision", "recall", "f1")


@query(
    "accuracy",
    f"""{_RULED} SELECT round(avg(CAST(label = prediction AS INT)), 6) AS accuracy,
    round(1 - avg(CAST(label = prediction AS INT)), 6) AS error FROM ruled""",
)
def accuracy(spark, sf_dir):
    return _rounded(e.accuracy(_ruled(spark, sf_dir)), "accuracy", "error")


@query("rmse", f"{WITH_CLEAN} SELECT round(sqrt(avg((f_value - f_k) * (f_value - f_k))), 6) AS rmse FROM clean")
def rmse(spark, sf_dir):
    return _rounded(e.rmse(_clean(spark, sf_dir), "f_value", "f_k"), "rmse")


@query("rmse_evaluator", f"{WITH_CLEAN} SELECT round(sqrt(avg((f_value - f_k) * (f_value - f_k))), 6) AS rmse FROM clean")
def rmse_evaluator(spark, sf_dir):
    """The same figure from the ML evaluator."""
    value = RegressionEvaluator(labelCol="f_value", predictionCol="f_k", metricName="rmse").evaluate(_clean(spark, sf_dir))
    return spark.createDataFrame([(round(value, 6),)], "rmse double")


# Binary problem with an informative, noisy score: benign flows have small f_value.
_SCORE = "f_k - f_value"
_BINARY = f"{WITH_CLEAN}, b AS (SELECT flow_id, CASE WHEN label = 'BENIGN' THEN 1 ELSE 0 END AS flag, {_SCORE} AS score FROM clean)"
_CURVE = f"""{_BINARY}, g AS (SELECT score, sum(flag) AS pos, count(*) - sum(flag) AS neg FROM b GROUP BY score),
    c AS (SELECT score AS threshold, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
        (SELECT sum(flag) FROM b) AS positives FROM g),
    curve AS (SELECT threshold, pos, tp, fp, tp / (tp + fp) AS precision, tp / positives AS recall,
        2 * tp / (tp + fp + positives) AS f1 FROM c)"""


def _binary(spark, sf_dir) -> DataFrame:
    return _clean(spark, sf_dir).select("flow_id", benign_flag(F.col("label")).alias("flag"), F.expr(_SCORE).alias("score"))


@query(
    "auc_roc",
    f"""{_BINARY}, g AS (SELECT score, CAST(sum(flag) AS DOUBLE) AS pos, CAST(count(*) - sum(flag) AS DOUBLE) AS neg
        FROM b GROUP BY score),
    r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r""",
)
def auc_roc(spark, sf_dir):
    return _rounded(curves.auc_roc(_binary(spark, sf_dir), "flag", "score"), "auc")


@query(
    "pr_curve",
    f"""{_CURVE} SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve""",
)
def pr_curve(spark, sf_dir):
    curve = curves.pr_curve(_binary(spark, sf_dir), "flag", "score")
    return _rounded(curve, "threshold", "precision", "recall").select("threshold", "tp", "fp", "precision", "recall")


@query("average_precision", f"{_CURVE} SELECT round(sum(precision * pos) / sum(pos), 6) AS average_precision FROM curve")
def average_precision(spark, sf_dir):
    return _rounded(curves.average_precision(_binary(spark, sf_dir), "flag", "score"), "average_precision")


_MICRO_CELLS = " UNION ALL ".join(
    f"SELECT CAST(label = '{c}' AS INT) AS flag, CASE WHEN prediction = '{c}' THEN f_k ELSE 99.5 - f_k END AS score FROM ruled"
    for c in _CLASSES
)


@query(
    "average_precision_micro",
    f"""{_RULED}, b AS ({_MICRO_CELLS}), g AS (SELECT score, sum(flag) AS pos, count(*) AS n FROM b GROUP BY score),
    c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS precision FROM g)
    SELECT round(sum(precision * pos) / sum(pos), 6) AS average_precision FROM c""",
)
def average_precision_micro(spark, sf_dir):
    df = one_hot(_ruled(spark, sf_dir), "label", _CLASSES, "t_")
    scores = {f"s_{c}": F.when(F.col("prediction") == c, F.col("f_k")).otherwise(99.5 - F.col("f_k")) for c in _CLASSES}
    cells = curves.cells(df.withColumns(scores), [f"t_{c}" for c in _CLASSES], list(scores))
    return _rounded(curves.average_precision(cells, "flag", "score"), "average_precision")


@query(
    "log_loss",
    f"""{_RULED} SELECT round(-avg(ln(CASE WHEN label = prediction THEN 0.5 + f_k / 250
        ELSE (0.5 - f_k / 250) / 5 END)), 6) AS log_loss FROM ruled""",
)
def log_loss(spark, sf_dir):
    """The rule's class gets most of the probability, the other five share the rest."""
    top = 0.5 + F.col("f_k") / 250
    shares = F.array(*[F.when(F.col("prediction") == c, top).otherwise((0.5 - F.col("f_k") / 250) / 5) for c in _CLASSES])
    df = _ruled(spark, sf_dir).select(code_by_list(F.col("label"), _CLASSES).alias("code"), shares.alias("p"))
    return _rounded(e.log_loss(df, "code", "p"), "log_loss")


@query(
    "log_loss_binary",
    f"""{WITH_CLEAN} SELECT round(-avg(ln(CASE WHEN label = 'BENIGN' THEN (f_k + 1) / 101 ELSE 1 - (f_k + 1) / 101 END)), 6)
    AS log_loss FROM clean""",
)
def log_loss_binary(spark, sf_dir):
    df = _clean(spark, sf_dir).select(benign_flag(F.col("label")).alias("flag"), ((F.col("f_k") + 1) / 101).alias("p"))
    return _rounded(e.binary_log_loss(df, "flag", "p"), "log_loss")


# Three rule scores per flow; many flows tie.
_RULE_SCORES = {"DoS Hulk": "floor(f_value / 50) % 4", "PortScan": "floor(f_k / 20) % 4", "Bot": "flow_id % 4"}
_SCORES_SQL = ", ".join(f"""CAST({e} AS DOUBLE) AS "{n}\"""" for n, e in _RULE_SCORES.items())


def _model_tables(spark, sf_dir) -> dict[str, DataFrame]:
    df = _clean(spark, sf_dir)
    return {n: df.select("flow_id", F.expr(x).cast("double").alias("p")) for n, x in _RULE_SCORES.items()}


@query("align_scores", f"{WITH_CLEAN} SELECT flow_id, {_SCORES_SQL} FROM clean")
def align_scores_query(spark, sf_dir):
    return align_scores(_model_tables(spark, sf_dir), "flow_id", "p")


@query(
    "ensemble_argmax",
    f"""{WITH_CLEAN}, s AS (SELECT flow_id, {_SCORES_SQL} FROM clean)
    SELECT flow_id, CASE WHEN "DoS Hulk" >= "PortScan" AND "DoS Hulk" >= "Bot" THEN 'DoS Hulk'
        WHEN "PortScan" >= "Bot" THEN 'PortScan' ELSE 'Bot' END AS prediction FROM s""",
)
def ensemble_argmax_query(spark, sf_dir):
    scores = {n: F.expr(x).cast("double") for n, x in _RULE_SCORES.items()}
    df = _clean(spark, sf_dir).withColumns(scores)
    return ensemble_argmax(df, list(_RULE_SCORES)).select("flow_id", "prediction")


@query("align_truth", f"{_RULED} SELECT flow_id, prediction, label FROM ruled")
def align_truth_query(spark, sf_dir):
    predictions = _ruled(spark, sf_dir).select("flow_id", "prediction")
    return align_truth(predictions, _clean(spark, sf_dir).select("flow_id", "label"), "flow_id")


_ENTRIES = "SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS pos FROM embeddings"
_ERRORS = f"""WITH x AS ({_ENTRIES}), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY label, pos),
    err AS (SELECT vec_id, label, avg((v - m) * (v - m)) AS error FROM x JOIN m USING (label, pos) GROUP BY vec_id, label)"""


@query("reconstruction_error", f"{_ERRORS} SELECT vec_id, label, round(error, 8) AS error FROM err")
def reconstruction_error(spark, sf_dir):
    return class_mean_error(vectors(spark, sf_dir), "embedding").select("vec_id", "label", F.round("error", 8).alias("error"))


@query(
    "anomaly_threshold",
    f"""WITH x AS ({_ENTRIES}), m AS (SELECT pos, avg(v) AS m FROM x WHERE label <> 0 GROUP BY pos),
    b AS (SELECT vec_id, CASE WHEN any_value(label) = 0 THEN 1 ELSE 0 END AS flag, round(avg((v - m) * (v - m)), 8) AS score
        FROM x JOIN m USING (pos) GROUP BY vec_id),
    g AS (SELECT score, sum(flag) AS pos, count(*) - sum(flag) AS neg FROM b GROUP BY score),
    c AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
        (SELECT sum(flag) FROM b) AS positives FROM g)
    SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / positives, 6) AS recall,
        round(2 * tp / (tp + fp + positives), 6) AS f1 FROM c ORDER BY 2 * tp / (tp + fp + positives) DESC, threshold LIMIT 1""",
)
def anomaly_threshold(spark, sf_dir):
    """Class 0 plays the anomaly: rows are rebuilt by the mean of all other classes."""
    df = vectors(spark, sf_dir)
    rest = mean_arrays(df.where("label <> 0").withColumn("all", F.lit(1)), "embedding", "all").first()["mean_x"]
    x = F.transform("embedding", lambda v: v.cast("double"))
    error = F.round(mean_squared_difference(x, F.array(*[F.lit(v) for v in rest])), 8)
    scored = df.select((F.col("label") == 0).cast("int").alias("flag"), error.alias("score"))
    best = curves.best_threshold(scored, "flag", "score")
    return best.withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1")})
