"""Information of continuous features about a class, without bins: by distances to neighbours of the same class.

For each row, r is the distance to its k-th nearest row of the same class (of its n - 1 others in a class of n <= k rows) along
the feature, and m the number of rows of any class nearer than r, the row itself and rows at its place included. With N rows the
information is psi(N) + mean(psi(k)) - mean(psi(n)) - mean(psi(m)), psi being the digamma function, and not below 0.
Classes of one row and values that are missing or infinite take no part.

Equal values of a class are counted first and stay one row. Each feature is cut at the same borders for all classes into
ranges of about ``RANGE_ROWS`` different values. A range gets the k nearest values of each class from the ranges before and
behind it, so distances across borders are right and nothing but k values a class and border is handed over.
Rows nearer than r are counted by running sums inside ranges, shifted by the totals of earlier ranges. No task sees
more than a range, however many rows a class or a value has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.runtime import column, materialise, small_side

#: Different values of a feature and class in a range.
RANGE_ROWS = 200_000
#: Rows of ranges, features and classes that may be broadcast.
MAX_RANGE_SUMS = 200_000
#: A row counts as nearer than r if its distance is below r by more than this share, whatever sums round to.
NEARER = 1e-10
_SERIES = 10


def digamma(x: Column) -> Column:
    """The digamma function of whole numbers from 1 on, by its series at x + 10."""
    x = x.cast("double")
    y = x + F.lit(float(_SERIES))
    y2 = y * y
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y2) + 1 / (120 * y2 * y2) - 1 / (252 * y2 * y2 * y2)
    for i in range(_SERIES):
        series = series - 1 / (x + F.lit(float(i)))
    return series


def neighbour_information(df: DataFrame, features: list[str], label: str = "label", k: int = 3) -> DataFrame:
    """``feature, score`` in nats, 0 for a feature without a class of two usable values."""
    named_rows = df.select(column(label).cast("string").alias("label"), *[column(f).cast("double").alias(f) for f in features])
    long = named_rows.unpivot(["label"], [column(f) for f in features], "feature", "x")
    long = long.where(F.col("label").isNotNull() & (F.abs("x") < float("inf"))).withColumn("x", F.col("x") + F.lit(0.0))
    points = long.groupBy("feature", "label", "x").agg(F.count(F.lit(1)).alias("n"))
    points = materialise(points, "points")
    totals = points.groupBy("feature", "label").agg(F.sum("n").alias("size")).where("size > 1")
    points = points.join(small_side(totals, MAX_RANGE_SUMS), ["feature", "label"])
    ranged = materialise(_ranged(points, "x"), "ranged")

    reach = materialise(_reach(ranged, k), "reach")
    counted = _nearer(ranged, reach)
    psi = digamma(F.least(F.lit(k), F.col("size") - 1)) - digamma(F.col("size")) - digamma(F.col("m"))
    sums = counted.groupBy("feature").agg(F.sum("n").alias("all"), F.sum(F.col("n") * psi).alias("psi"))
    score = F.greatest(F.lit(0.0), digamma(F.col("all")) + F.col("psi") / F.col("all"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(sums.select("feature", score.alias("score")), "feature", "left").fillna(0.0, ["score"])


def _ranged(points: DataFrame, value: str) -> DataFrame:
    """Adds the range of each value: the number of its feature's borders at or below it, whatever its class."""
    most = points.groupBy("feature").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    ranges = 1 + most // RANGE_ROWS
    if ranges == 1:
        return points.withColumn("range", F.lit(0))
    grid = [i / ranges for i in range(1, ranges)]
    found = points.groupBy("feature").agg(F.percentile_approx(value, grid, 10_000).alias("b")).collect()
    borders = {r["feature"]: np.unique(np.array(r["b"])) for r in found}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(batch.schema.get_field_index("feature")).to_pylist(), dtype=object)
            values = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            found = np.zeros(len(names), dtype=np.int32)
            for name in set(names):
                here = np.flatnonzero(names == name)
                found[here] = np.searchsorted(borders[name], values[here], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "range"])

    return points.mapInArrow(work, points.select("*", F.lit(0).alias("range")).schema)


def _handed_over(ranged: DataFrame, k: int) -> DataFrame:
    """``feature, label, range, size, before, behind``: the k nearest values of a class outside each of its ranges."""
    at = ["feature", "label", "range"]
    value = F.struct("x", "n")

    def ends(order: Column, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*at).orderBy(order))
        few = ranged.withColumn("place", place).where(F.col("place") <= k)
        return few.groupBy(*at).agg(F.sort_array(F.collect_list(value)).alias(name), F.max("size").alias("size"))

    both = ends(F.asc("x"), "lows").join(ends(F.desc("x"), "highs").drop("size"), at)
    # every range of a class has a value, so k ranges have k
    along = Window.partitionBy("feature", "label").orderBy("range")
    earlier = F.flatten(F.collect_list("highs").over(along.rowsBetween(-k, -1)))
    later = F.flatten(F.collect_list("lows").over(along.rowsBetween(1, k)))
    return both.select(*at, "size", earlier.alias("before"), later.alias("behind"))


def kth_distance(x: np.ndarray, n: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """For each own value its distance to the k-th nearest of the others; values rise, ``n`` says how often each is there."""
    copies = np.minimum(n, k + 1)
    line = np.concatenate([np.full(k, -np.inf), np.repeat(x, copies), np.full(k, np.inf)])
    first = (k + np.cumsum(copies) - copies)[own]
    here = line[first]
    return np.min([np.maximum(here - line[first - j], line[first + k - j] - here) for j in range(k + 1)], axis=0)


def _reach(ranged: DataFrame, k: int) -> DataFrame:
    """The points with ``r``."""
    at = ["feature", "label", "range"]

    def reach(points: pa.Table, handed: pa.Table) -> pa.Table:
        points = points.sort_by("x")
        x, n, size = points["x"].to_numpy(), points["n"].to_numpy(), points["size"][0].as_py()
        before, behind = (sorted((v["x"], v["n"]) for v in handed[c][0].as_py()) for c in ("before", "behind"))
        every = np.concatenate([[v for v, _ in before], x, [v for v, _ in behind]])
        counts = np.concatenate([np.array([c for _, c in before], dtype=np.int64), n, np.array([c for _, c in behind], dtype=np.int64)])
        own = np.arange(len(before), len(before) + len(x))
        r = kth_distance(every, counts, own, min(k, size - 1))
        return pa.table({c: points[c] for c in ("feature", "label", "x", "n", "size")} | {"r": r})

    schema = "feature string, label string, x double, n bigint, size bigint, r double"
    points = ranged.select("feature", "label", "range", "x", "n", "size")
    handed = materialise(_handed_over(ranged, k), "handed")  # a table of its own: both sides have the same columns
    return points.groupBy(*at).cogroup(handed.groupBy(*at)).applyInArrow(reach, schema)


def _nearer(ranged: DataFrame, reach: DataFrame) -> DataFrame:
    """The points with ``m``, the rows of all classes nearer than ``r``."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("x", "double"))]
    weights = ranged.groupBy("feature", F.col("x").alias("v")).agg(F.sum("n").alias("w"))
    # at one value, what asks for rows below it comes before its rows, what asks for rows up to it behind them
    events = weights.select("feature", "v", F.lit(1).alias("kind"), "w", *none)
    step = F.col("r") * F.lit(1 - NEARER)
    for kind, v in ((0, F.col("x") - step), (2, F.col("x") + step)):
        asked = reach.select("feature", v.alias("v"), F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("w"), "label", "x")
        events = events.unionByName(asked)
    events = materialise(_ranged(events, "v"), "events")
    along = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = events.groupBy("feature", "range").agg(F.sum("w").alias("w"))
    shifts = sums.select("feature", "range", F.coalesce(F.sum("w").over(along), F.lit(0)).alias("shift"))
    upto = F.sum("w").over(Window.partitionBy("feature", "range").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ranked = events.withColumn("upto", upto).where("kind <> 1").join(small_side(shifts, MAX_RANGE_SUMS), ["feature", "range"])
    signed = F.when(F.col("kind") == 2, F.col("upto") + F.col("shift")).otherwise(-F.col("upto") - F.col("shift"))
    m = ranked.groupBy("feature", "label", "x").agg(F.sum(signed).alias("m"))
    return reach.join(m, ["feature", "label", "x"])
