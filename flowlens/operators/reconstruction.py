"""Reconstruction error of rows and its comparison with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column, small_side


def mean_squared_difference(x: Column, rebuilt: Column) -> Column:
    """Mean over the entries of two arrays of equal length."""
    squares = F.zip_with(x, rebuilt, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def mean_arrays(df: DataFrame, values: str, *by: str) -> DataFrame:
    """``by..., mean_x``: the entry-wise mean of an array column, summed before the shuffle."""
    entries = df.select(*[column(b) for b in by], F.posexplode(column(values)).alias("pos", "v"))
    means = entries.groupBy(*[column(b) for b in by], "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(*[column(b) for b in by]).agg(ordered.alias("mean_x"))


def class_mean_error(df: DataFrame, values: str, label: str = "label") -> DataFrame:
    """Adds ``error``: how far each row is from the mean of its class."""
    means = small_side(mean_arrays(df, values, label))
    x = F.transform(column(values), lambda v: v.cast("double"))
    return df.join(means, label, "left").withColumn("error", mean_squared_difference(x, F.col("mean_x"))).drop("mean_x")
