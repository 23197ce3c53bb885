"""Label encodings as column expressions (and fitted indexers where codes come from the data)."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.fixed_values import BENIGN, WEB_ATTACK
from flowlens.runtime import bounded_rows, column

MAX_CLASSES = 1000


def normalise_dash(label: Column) -> Column:
    """Web attack names come with a dash, a broken byte or none; give all one spelling."""
    return F.regexp_replace(label, r"^Web Attack\s*[^A-Za-z0-9]+\s*", "Web Attack - ")


def merge_web_attacks(label: Column) -> Column:
    """Brute force, SQL injection and XSS become one class; other labels stay."""
    return F.when(label.startswith("Web Attack"), F.lit(WEB_ATTACK)).otherwise(label)


def one_vs_rest(label: Column, attack: str) -> Column:
    """1 for the named attack, 0 for anything else (benign is always rest)."""
    return (label == F.lit(attack)).cast("int")


def benign_flag(label: Column) -> Column:
    """1 for benign, 0 for an attack; null stays null."""
    return F.when(label.isNull(), F.lit(None)).when(label == F.lit(BENIGN), 1).otherwise(0).cast("int")


def code_by_list(label: Column, names: list[str]) -> Column:
    """Position in ``names``; null for a label outside the list."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), label)
    return F.when(position > 0, position - 1).cast("int")


def round_to_class(prediction: Column) -> Column:
    """Nearest class of a regression output, halves to the even class."""
    return F.bround(prediction, 0).cast("int")


def round_probability(probability: Column) -> Column:
    """0/1 by rounding; exactly one half rounds to the even number, 0."""
    return (probability > 0.5).cast("int")


def argmax(scores: Column) -> Column:
    """Position of the largest entry of an array column, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def class_names(df: DataFrame, label: str) -> list[str]:
    """The distinct non-null labels in alphabetical order; bounded by the number of classes."""
    names = df.select(column(label).alias("name")).where("name is not null").distinct()
    return sorted(r["name"] for r in bounded_rows(names, MAX_CLASSES, "classes"))


def one_hot(df: DataFrame, label: str, names: list[str] | None = None, prefix: str = "is_") -> DataFrame:
    """One 0/1 column per class beside the existing columns."""
    names = names if names is not None else class_names(df, label)
    flags = [F.coalesce((column(label) == F.lit(n)).cast("int"), F.lit(0)).alias(prefix + n) for n in names]
    return df.select("*", *flags)


def one_hot_array(label: Column, names: list[str]) -> Column:
    """The one-hot row as an array, in the order of ``names``."""
    return F.array(*[F.coalesce((label == F.lit(n)).cast("double"), F.lit(0.0)) for n in names])


def fit_codes(df: DataFrame, label: str, output: str, order: str = "alphabetAsc") -> StringIndexerModel:
    """Codes by name (``alphabetAsc``) or by falling frequency (``frequencyDesc``, ties by name)."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType=order, handleInvalid="error").fit(df)


def decode(df: DataFrame, code: str, output: str, names: list[str]) -> DataFrame:
    """Code back to name."""
    return IndexToString(inputCol=code, outputCol=output, labels=names).transform(df)
