"""ROC and precision-recall measures over all distinct scores, exactly.

Rows are first counted per distinct score. The running sums over scores are taken inside
score ranges and shifted by the totals of earlier ranges, so no task sees all scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.runtime import column, materialise, small_side


def score_counts(df: DataFrame, flag: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``score, pos, neg`` per distinct score (of each group); rows without a score are left out."""
    s = column(score).cast("double")
    return (
        df.where(s.isNotNull())
        .groupBy(*[column(c) for c in by], s.alias("score"))
        .agg(F.count_if(column(flag) == 1).alias("pos"), F.count_if(column(flag) == 0).alias("neg"))
    )


def cells(df: DataFrame, flags: list[str], scores: list[str]) -> DataFrame:
    """``flag, score`` over all classes: the micro-averaged view of one-hot truth and scores."""
    pair = F.explode(
        F.array(*[F.struct(column(f).cast("int").alias("flag"), column(s).cast("double").alias("score")) for f, s in zip(flags, scores)])
    )
    return df.select(pair.alias("c")).select("c.flag", "c.score")


#: Distinct scores in a range: what one task sorts.
_RANGE_ROWS = 200_000


#: Rows of score ranges and groups that may be broadcast.
_RANGE_SUMS = 200_000


def running_totals(counts: DataFrame, sums: list[str], descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_before``, the total of earlier rows in score order (one row per score), and ``<name>_all``.

    With ``by``, inside each group. ``counts`` is computed and written once; the number of score ranges follows from its
    size. Ranges are the same in all groups, and hold about as many rows of all groups together, so a group
    of most rows is cut like a whole table.
    """
    counts = materialise(counts, "scores")
    ranges = 1 + counts.count() // _RANGE_ROWS
    grid = [i / ranges for i in range(1, ranges)] or [0.5]
    borders = counts.agg(F.percentile_approx("score", grid, 10_000).alias("b")).first()["b"] or []
    inner = sorted({float(b) for b in borders if math.isfinite(b)}) or [0.0]
    splits = [-math.inf, *inner, math.inf]
    ranged = Bucketizer(splits=splits, inputCol="score", outputCol="range", handleInvalid="keep").transform(counts)
    order, group = F.desc if descending else F.asc, [column(c) for c in by]
    earlier = Window.partitionBy(*group).orderBy(order("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "range").agg(*[F.sum(s).alias(s) for s in sums])  # at most len(splits) rows in a group
    shifts = totals.select(
        *[column(c).alias(f"_{i}") for i, c in enumerate(by)],
        F.col("range").alias("_range"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_shift") for s in sums],
        *[F.sum(s).over(Window.partitionBy(*group)).alias(f"{s}_all") for s in sums],
    )
    same = F.col("range").eqNullSafe(F.col("_range"))
    for i, c in enumerate(by):
        same = same & column(c).eqNullSafe(F.col(f"_{i}"))
    within = Window.partitionBy(*group, "range").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(small_side(shifts, _RANGE_SUMS), same)
    before = [(F.col(f"{s}_shift") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"{s}_before") for s in sums]
    return joined.select(*[column(c) for c in counts.columns], *before, *[f"{s}_all" for s in sums])


def auc_roc(df: DataFrame, flag: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outscores a negative (of its group), ties counting half; 0.5 for one class only."""
    ranked = running_totals(score_counts(df, flag, score, by), ["neg"], by=by)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    sums = ranked.groupBy(*[column(c) for c in by]).agg(F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    return sums.select(*[column(c) for c in by], F.when(pairs > 0, F.col("wins") / pairs).otherwise(F.lit(0.5)).alias("auc"))


def pr_curve(df: DataFrame, flag: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, pos, tp, fp, precision, recall, f1`` for predicting 1 at or above each score (of each group)."""
    counts = score_counts(df, flag, score, by)
    ranked = running_totals(counts, ["pos", "neg"], descending=True, by=by)
    group = [column(c) for c in by]
    curve = ranked.select(
        *group,
        F.col("score").alias("threshold"),
        "pos",
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_all").cast("double").alias("all_pos"),
    )
    tp, fp, all_pos = F.col("tp"), F.col("fp"), F.col("all_pos")
    return curve.select(
        *group,
        "threshold",
        "pos",
        "tp",
        "fp",
        (tp / (tp + fp)).alias("precision"),
        F.when(all_pos > 0, tp / all_pos).otherwise(0.0).alias("recall"),
        (2 * tp / (tp + fp + all_pos)).alias("f1"),
    )


def average_precision(df: DataFrame, flag: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at each threshold weighted by the recall gained there (in each group); 0 without a positive."""
    curve = pr_curve(df, flag, score, by)
    sums = curve.groupBy(*[column(c) for c in by]).agg(F.sum(F.col("precision") * F.col("pos")).alias("s"), F.sum("pos").alias("p"))
    return sums.select(*[column(c) for c in by], F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0).alias("average_precision"))


def best_threshold(df: DataFrame, flag: str, score: str) -> DataFrame:
    """The threshold of the best F1 (the lowest one on ties) with its precision, recall and F1."""
    curve = pr_curve(df, flag, score)
    key = F.struct("f1", (-F.col("threshold")).alias("low"), "threshold", "precision", "recall")
    return curve.agg(F.max(key).alias("b")).select("b.threshold", "b.precision", "b.recall", "b.f1")
