"""Quality of predictions. Only counts per pair of classes are ever shuffled."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column

TOTAL_ROW = "avg / total"


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", *by: str) -> DataFrame:
    """``label, prediction, n`` (per group of ``by``)."""
    return df.groupBy(*[column(b) for b in by], column(label).alias("label"), column(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(counts: DataFrame, *by: str) -> DataFrame:
    """``class, precision, recall, f1, support`` for every class seen as label or prediction."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
        )
    )
    sums = (
        counts.select(*by, sides.alias("s"))
        .groupBy(*by, F.col("s.class").alias("class"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
    )
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        *by,
        "class",
        _ratio(hits, predicted).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(2 * hits, support + predicted).alias("f1"),
        "support",
    )


def macro(classes: DataFrame, *by: str) -> DataFrame:
    """Plain mean over classes."""
    return classes.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def weighted(classes: DataFrame, *by: str) -> DataFrame:
    """Mean over classes weighted by support."""
    total = F.sum("support")
    scores = [(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")]
    return classes.groupBy(*by).agg(*scores, total.alias("support"))


def report(df: DataFrame, label: str = "label", prediction: str = "prediction", *by: str) -> DataFrame:
    """One row per class and a support-weighted ``avg / total`` row (per group of ``by``)."""
    classes = per_class(confusion(df, label, prediction, *by), *by)
    classes = classes.withColumn("class", F.col("class").cast("string"))
    total = weighted(classes, *by).withColumn("class", F.lit(TOTAL_ROW))
    return classes.unionByName(total)


def micro(df: DataFrame, truths: list[str], predictions: list[str]) -> DataFrame:
    """Precision, recall and F1 over all cells of one-hot truth and 0/1 prediction columns."""
    pairs = [(column(t) == 1, column(p) == 1) for t, p in zip(truths, predictions)]

    def cells(f) -> Column:
        return F.sum(sum((f(t, p).cast("bigint") for t, p in pairs), F.lit(0).cast("bigint")))

    sums = df.agg(
        cells(lambda t, p: t & p).alias("tp"), cells(lambda t, p: ~t & p).alias("fp"), cells(lambda t, p: t & ~p).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of equal labels and its complement."""
    hit = F.avg((column(label) == column(prediction)).cast("int"))
    return df.agg(hit.alias("accuracy")).withColumn("error", 1 - F.col("accuracy"))


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    gap = column(label) - column(prediction)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def log_loss(df: DataFrame, code: str, probabilities: str, eps: float = 1e-15) -> DataFrame:
    """Cross-entropy of the true class's entry in an array of class probabilities."""
    p = F.get(column(probabilities), column(code).cast("int"))
    return df.agg((-F.avg(F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))))).alias("log_loss"))


def binary_log_loss(df: DataFrame, flag: str, probability: str, eps: float = 1e-15) -> DataFrame:
    """Cross-entropy of a 0/1 label and the probability of 1."""
    p = F.when(column(flag) == 1, column(probability)).otherwise(1 - column(probability))
    return df.agg((-F.avg(F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))))).alias("log_loss"))


def one_hot_report(df: DataFrame, truths: dict[str, str], predictions: dict[str, str]) -> DataFrame:
    """Per class, the scores of its 0/1 prediction column against its 0/1 truth column."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("class"), column(truths[c]).cast("int").alias("t"), column(predictions[c]).cast("int").alias("p"))
                for c in truths
            ]
        )
    )
    both = (F.col("t") == 1) & (F.col("p") == 1)
    sums = df.select(cells.alias("c")).select("c.*").groupBy("class").agg(
        F.count_if(both).alias("hits"), F.count_if(F.col("p") == 1).alias("predicted"), F.count_if(F.col("t") == 1).alias("support")
    )
    hits, predicted, support = F.col("hits"), F.col("predicted"), F.col("support")
    return sums.select(
        "class",
        _ratio(hits, predicted).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(2 * hits, support + predicted).alias("f1"),
        "support",
    )


def auc_of(scored: DataFrame, flag: str = "flag") -> float:
    """Area under the ROC curve of a fitted classifier's raw scores, over all distinct scores."""
    return BinaryClassificationEvaluator(labelCol=flag, rawPredictionCol="rawPrediction", numBins=0).evaluate(scored)
