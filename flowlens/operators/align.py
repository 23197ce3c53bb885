"""Bring columns of the same rows together by key instead of by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column


def append_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables of the same rows side by side: one equi-join on the unique key."""
    return left.join(right, key)


def align_scores(tables: dict[str, DataFrame], key: str, score: str) -> DataFrame:
    """One row per key with one score column per model, for keys every model scored.

    All tables are stacked and grouped once: one shuffle for any number of models, where a
    chain of joins would shuffle the growing row again for each of them.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [t.select(column(key), F.lit(name).alias("model"), column(score).alias("score")) for name, t in tables.items()],
    )
    scores = [F.max(F.when(F.col("model") == F.lit(name), F.col("score"))).alias(name) for name in tables]
    present = F.count_distinct("model") == len(tables)
    return stacked.groupBy(column(key)).agg(*scores, present.alias("_all")).where("_all").drop("_all")


def align_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions beside true labels by key."""
    return append_columns(predictions, truth, key)
