"""Counts, shapes, duplicates and class weights. Each is one partial-and-final aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.fixed_values import CLASS_WEIGHT_MU
from flowlens.runtime import column, small_side


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(column(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(column(first), column(second)).agg(F.count(F.lit(1)).alias("n"))


def table_shape(df: DataFrame, split: str) -> DataFrame:
    """Rows and columns of every split from one aggregate, not one action per split."""
    width = len(df.columns)
    return df.groupBy(column(split)).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(width))


def dedupe_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct combinations of the named columns; copies collapse before the shuffle."""
    return df.select(*[column(c) for c in names]).distinct()


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(column(name)).distinct()


def describe_column(df: DataFrame, name: str) -> DataFrame:
    """Count, distinct values, most frequent value (first by name on ties) and its frequency."""
    counts = df.where(column(name).isNotNull()).groupBy(column(name).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    top = F.min(F.struct((-F.col("c")).alias("rank"), F.col("v").alias("v")))
    return counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"), top.alias("t")).select(
        "n", "n_unique", F.col("t.v").alias("top"), (-F.col("t.rank")).alias("freq")
    )


def log_weights(counts: DataFrame, mu: float = CLASS_WEIGHT_MU) -> DataFrame:
    """``max(1, ln(mu * total / n))`` beside each row of a class-count table."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("weight", F.greatest(F.lit(1.0), F.log(F.lit(mu) * total / F.col("n"))))


def balanced_weights(counts: DataFrame) -> DataFrame:
    """``total / (classes * n)`` beside each row of a class-count table."""
    whole = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """The class weight beside each row; the weight table is one row per class."""
    side = small_side(weights.select(column(label), "weight"))
    return df.join(side, label, "left")
