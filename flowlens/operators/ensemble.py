"""Choosing one label from the scores of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import column


def scores_array(models: list[str]) -> Column:
    """The models' scores as an array in list order; NaN counts as no score."""
    return F.array(*[F.when(~F.isnan(column(m)), column(m)) for m in models])


def ensemble_argmax(df: DataFrame, models: list[str], output: str = "prediction") -> DataFrame:
    """Name of the model with the largest score, the first in the list on ties; null without scores."""
    scores = scores_array(models)
    place = F.array_position(scores, F.array_max(scores))
    names = F.array(*[F.lit(m) for m in models])
    return df.withColumn(output, F.when(place > 0, F.element_at(names, place.cast("int"))))
