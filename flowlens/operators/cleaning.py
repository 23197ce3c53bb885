"""Projection, filtering and repair of flow tables. All lazy, all narrow unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.fixed_values import BENIGN, HEADER_LABEL
from flowlens.runtime import column, quoted

_FLOATING = ("double", "float")


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (``' Label'`` becomes ``Label``)."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name; a missing name is no error."""
    return df.drop(*names)


def with_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that have a label."""
    return df.where(column(label).isNotNull())


def without_header_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop header lines repeated inside the data; a null label goes too, as in SQL."""
    return df.where(column(label) != F.lit(HEADER_LABEL))


def without_benign(df: DataFrame, label: str = "label", include_benign: bool = False) -> DataFrame:
    """Attack rows only, or every labelled row with ``include_benign``."""
    kept = with_label(df, label)
    return kept if include_benign else kept.where(column(label) != F.lit(BENIGN))


def only_labels(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Rows whose label is in the list."""
    return df.where(column(label).isin(labels))


def project_features(df: DataFrame, features: list[str], *others: str) -> DataFrame:
    """The listed features in table order, each once, then the other columns asked for."""
    wanted = set(features)
    return df.select(*[column(c) for c in df.columns if c in wanted], *[column(c) for c in others])


def project_through(df: DataFrame, last: str) -> DataFrame:
    """The columns from the first to ``last``, both included."""
    return df.select(*[column(c) for c in df.columns[: df.columns.index(last) + 1]])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Type name to column names, in table order."""
    groups: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        groups.setdefault(kind, []).append(name)
    return groups


def drop_non_numeric(df: DataFrame, *keep: str) -> DataFrame:
    """Drop every column that is not a number, but for those in ``keep``."""
    numeric = set(numeric_columns(df)) | set(keep)
    return df.select(*[column(c) for c in df.columns if c in numeric])


def cast_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as doubles; text that is no number becomes null, never an error."""
    wanted = set(names)
    return df.select(*[column(c).try_cast("double").alias(c) if c in wanted else column(c) for c in df.columns])


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = column(name)
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in _FLOATING else c.isNull()


def fill_missing(
    df: DataFrame, names: list[str] | None = None, value: float = 0.0, infinite_is_missing: bool = True
) -> DataFrame:
    """Null and NaN become ``value``; by default so do the infinities.

    Without ``names`` every numeric column is treated.
    """
    wanted = set(names if names is not None else numeric_columns(df))
    floating = {n for n, kind in df.dtypes if kind in _FLOATING}

    def filled(c: str) -> Column:
        if c not in wanted:
            return column(c)
        if c not in floating:
            return F.coalesce(column(c), F.lit(value).cast(dict(df.dtypes)[c])).alias(c)
        bad = column(c).isNull() | F.isnan(column(c))
        if infinite_is_missing:
            bad = bad | (F.abs(column(c)) == F.lit(float("inf")))
        return F.when(bad, F.lit(value)).otherwise(column(c)).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def drop_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in the named columns (all columns by default)."""
    return df.na.drop(subset=names)


def missing_report(df: DataFrame) -> DataFrame:
    """``column_name, n_missing`` per column, from one aggregate over one scan."""
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    pairs = ", ".join("'{}', {}".format(c.replace("'", "\\'"), quoted(c)) for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, n_missing)")


def rows_with_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows with a missing value in any of the named columns."""
    names = names if names is not None else df.columns
    return df.where(reduce(lambda a, b: a | b, [is_missing(df, c) for c in names]))


def head_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by key: a top-n per partition, merged, never a full sort."""
    return df.orderBy(column(key)).limit(n)


def clean_flows(df: DataFrame, numeric: list[str], label: str = "label") -> DataFrame:
    """The usual preparation: labelled rows, no header lines, numbers, nothing missing.

    Filters come before any cast so that a row without a label can never turn into a class.
    """
    return fill_missing(cast_numeric(without_header_rows(with_label(df, label), label), numeric), numeric)
