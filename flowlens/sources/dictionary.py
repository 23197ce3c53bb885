"""Small dictionaries as tables: attack to feature list, feature to score, class to weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.fixed_values import ATTACK_FEATURES
from flowlens.runtime import bounded_rows

MAX_ENTRIES = 10_000


def attack_features(spark: SparkSession) -> DataFrame:
    """The fixed attack dictionary as ``attack, features``."""
    return spark.createDataFrame(list(ATTACK_FEATURES.items()), "attack string, features array<string>")


def feature_union(dictionary: DataFrame, features: str = "features") -> DataFrame:
    """Every feature named in any list, once."""
    return dictionary.select(F.explode(features).alias("feature")).distinct()


def save_dictionary(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_dict(dictionary: DataFrame) -> dict:
    """First column to second column, for a table known to be small."""
    return {r[0]: r[1] for r in bounded_rows(dictionary, MAX_ENTRIES, "dictionary entries")}
