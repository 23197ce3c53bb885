"""Dense matrices: rows with a key and an array of numbers instead of bare positions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import one_hot_array
from flowlens.runtime import column


def read_matrix(spark: SparkSession, path: str, values: str, vector: str = "features") -> DataFrame:
    """A Parquet table whose ``values`` array becomes an ML vector column."""
    return spark.read.parquet(path).withColumn(vector, array_to_vector(column(values).cast("array<double>")))


def write_matrix(
    df: DataFrame, path: str, key: str, features: list[str], label: str, classes: list[str], split: str = "split"
) -> str:
    """``key, x, y`` with the one-hot label in ``y``, one directory per split."""
    df.select(
        column(key),
        F.array(*[column(f).cast("double") for f in features]).alias("x"),
        one_hot_array(column(label), classes).alias("y"),
        column(split),
    ).write.partitionBy(split).parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a written matrix; the other directories are not listed for reading."""
    return spark.read.parquet(path).where(F.col("split") == F.lit(split))


def write_text_matrix(df: DataFrame, path: str, key: str, features: list[str], separator: str = " ") -> str:
    """The named columns as lines of numbers, in the order of ``key``, in text files in the order of their names."""
    ordered = df.repartitionByRange(column(key)).sortWithinPartitions(column(key))
    numbers = [F.coalesce(column(f).cast("double").cast("string"), F.lit("NaN")) for f in features]
    ordered.select(F.concat_ws(separator, *numbers).alias("value")).write.text(path)
    return path


def read_text_matrix(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """``row_id, x`` from a text file of numbers or a folder of them, ``row_id`` being the line's place in it.

    Files count in the order of their names. A line's place is the number of lines in earlier files and file blocks
    plus its place in its own block, so X and y files that belong together by line order can be joined by
    ``row_id``. Blocks are read by as many tasks as there are.
    """
    lines = spark.read.text(path).select(
        F.struct("_metadata.file_name", "_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    blocks = lines.groupBy("block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbers = F.transform(F.split(F.trim("value"), separator), lambda v: v.cast("double"))
    return lines.join(offsets, "block").select(
        (F.col("offset") + F.col("place") - F.col("first")).alias("row_id"), numbers.alias("x")
    )
