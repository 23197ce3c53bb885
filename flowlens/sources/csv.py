"""CSV flow tables: one file, or the directory of part files a Spark write leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowlens.operators.cleaning import trim_headers


def read_csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Every column as text, headers trimmed. Only the header line is read up front.

    Repeated header lines stay in as rows (``without_header_rows`` drops them) and a repeated
    column name gets its position as a suffix.
    """
    return trim_headers(spark.read.csv(path, header=True, encoding=encoding))


def read_csv_typed(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Typed columns. Give the schema for large tables; without one Spark reads the data twice."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return trim_headers(reader.csv(path))


def write_csv(df: DataFrame, path: str, header: bool = True, by: str | None = None, encoding: str = "UTF-8") -> str:
    """One directory of part files, written in parallel; ``by`` gives a sub-directory per value."""
    writer = df.write.option("header", header).option("encoding", encoding)
    if by is not None:
        writer = writer.partitionBy(by)
    writer.csv(path)
    return path
