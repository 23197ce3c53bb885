"""Splits and class thinning that depend on row keys and a seed, not on partitions."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.fixed_values import BENIGN, BENIGN_KEEP_FRACTION
from flowlens.functions.draws import draw_key, drawn_below
from flowlens.runtime import column, small_side

# Draw keys are counted by three hex digits at a time: 4,096 buckets per class, and as many in each bucket that is counted again.
_PREFIX = 3
# Hex digits of a draw key.
_DIGITS = 32
#: Rows of one class that are put in order in one task; larger buckets are counted by further digits first.
MOST_RANKED = 100_000


def _shares(weights: dict[str, float]) -> list[tuple[str, float]]:
    """Names with the running share up to and including each."""
    total = sum(weights.values())
    return list(zip(weights, [round(s / total, 12) for s in accumulate(weights.values())]))


def random_split(df: DataFrame, keys: list[str], weights: dict[str, float], seed: int) -> DataFrame:
    """Add a ``split`` column; a row's part follows from its key alone. No shuffle."""
    drawn = draw_key(seed, *[column(k) for k in keys])
    return split_by(df.withColumn("_drawn", drawn), "_drawn", weights)


def split_by(df: DataFrame, drawn: str, weights: dict[str, float]) -> DataFrame:
    """Add a ``split`` column by the draw keys in the column ``drawn``, which goes."""
    *parts, (last, _) = _shares(weights)
    if not parts:
        return df.withColumn("split", F.lit(last)).drop(drawn)
    chosen = reduce(
        lambda c, part: (F if c is None else c).when(drawn_below(F.col(drawn), part[1]), F.lit(part[0])), parts, None
    )
    return df.withColumn("split", chosen.otherwise(F.lit(last))).drop(drawn)


def _within(keyed: DataFrame, edges: DataFrame, digits: int) -> DataFrame:
    """(class, n, i, nth, h): the rows of ``keyed`` that lie in the buckets of ``edges``."""
    same = F.col("k.class").eqNullSafe(F.col("e.class")) & (F.substring("k.h", 1, digits) == F.col("e.bucket"))
    return keyed.alias("k").join(edges.alias("e"), same).select("e.class", "e.n", "e.i", "e.nth", "k.h")


def _edges(keyed: DataFrame, quotas: list[Column]) -> tuple[DataFrame, int]:
    """For each class and quota the bucket of draw keys that holds its last row, and how many digits name a bucket.

    ``nth`` is the row's place in the bucket of ``rows`` rows. Digits are added until no bucket has more than MOST_RANKED.
    """
    digits = _PREFIX
    counts = keyed.groupBy("class", F.substring("h", 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("class")
    below = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    numbered = F.array(*[F.struct(F.lit(i).alias("i"), q.cast("bigint").alias("q")) for i, q in enumerate(quotas)])
    placed = (
        counts.withColumn("n", F.sum("rows").over(whole))
        .withColumn("before", F.coalesce(F.sum("rows").over(below), F.lit(0)))
        .withColumn("quota", F.explode(numbered))
        .where((F.col("quota.q") > F.col("before")) & (F.col("quota.q") <= F.col("before") + F.col("rows")))
        .select("class", "n", "quota.i", "bucket", (F.col("quota.q") - F.col("before")).alias("nth"), "rows")
    )
    edges = small_side(placed)
    while digits < _DIGITS and (edges.agg(F.max("rows")).first()[0] or 0) > MOST_RANKED:
        inside = _within(keyed, edges, digits)
        digits = min(digits + _PREFIX, _DIGITS)
        counts = inside.groupBy("class", "n", "i", "nth", F.substring("h", 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        below = Window.partitionBy("class", "i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumn("before", F.coalesce(F.sum("rows").over(below), F.lit(0))).where("nth > before AND nth <= before + rows")
        edges = small_side(found.select("class", "n", "i", "bucket", (F.col("nth") - F.col("before")).alias("nth"), "rows"))
    return edges, digits


def rank_cuts(df: DataFrame, key: str, quotas: list[Column], seed: int | str, label: str = "label") -> DataFrame:
    """For each class and quota q, the draw key of the q-th smallest row of that class.

    ``quotas`` are column expressions over ``n``, the size of the class. Returns
    ``class, n, cuts`` with one cut per quota; an empty string stands for quota 0.

    Only the bucket that holds the q-th row is ranked: rows are counted per class and key
    prefix, the buckets' running counts locate the q-th row, and a bucket of more than
    ``MOST_RANKED`` rows is counted again by a longer prefix. So no task sorts more than that,
    however large the class.
    """
    keyed = df.select(column(label).alias("class"), draw_key(seed, column(key)).alias("h"))
    edges, digits = _edges(keyed, quotas)
    rank = F.row_number().over(Window.partitionBy("class", "i").orderBy("h"))
    ranked = _within(keyed, edges, digits).withColumn("rank", rank)
    cut = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("h"))), F.lit("")) for i in range(len(quotas))]
    return ranked.where("rank = nth").groupBy("class").agg(F.max("n").alias("n"), F.array(*cut).alias("cuts"))


def stratified_split(
    df: DataFrame, key: str, weights: dict[str, float], seed: int, label: str = "label"
) -> DataFrame:
    """Add a ``split`` column with the same shares inside every class, exact to one row.

    Two scans of key and label (one more for each 4,096-fold of 400 million rows of a class) find
    one cut per class and part; tagging the rows is then a
    broadcast join with one row per class. The table itself is never shuffled. ``key`` must
    be unique.
    """
    *parts, (last, _) = _shares(weights)
    quotas = [F.floor(F.lit(share) * F.col("n")) for _, share in parts]
    cuts = small_side(rank_cuts(df, key, quotas, seed, label).select(F.col("class").alias("_class"), "cuts"))
    tagged = df.join(cuts, column(label).eqNullSafe(F.col("_class")), "left")
    tagged = tagged.withColumn("_drawn", draw_key(seed, column(key)))
    chosen = None
    for i, (name, _) in enumerate(parts):
        chosen = (F if chosen is None else chosen).when(F.col("_drawn") <= F.col("cuts")[i], F.lit(name))
    # A class too small for any cut has no row in the cut table: all of it is in the last part.
    return tagged.withColumn("split", chosen.otherwise(F.lit(last))).drop("_class", "cuts", "_drawn")


def sample_by_class(
    df: DataFrame, key: str, fractions: dict[str, float], seed: int, label: str = "label"
) -> DataFrame:
    """Keep each row with its class's fraction; classes not named are kept whole.

    The draw is independent of the one a split with the same seed makes, so thinning a table
    and then splitting it leaves both parts thinned alike.
    """
    drawn = draw_key(f"{seed}-sample", column(key))
    kept = F.lit(True)
    for name, fraction in fractions.items():
        kept = F.when(column(label) == F.lit(name), drawn_below(drawn, fraction)).otherwise(kept)
    return df.where(kept)


def thin_benign(
    df: DataFrame, key: str, seed: int, fraction: float = BENIGN_KEEP_FRACTION, label: str = "label"
) -> DataFrame:
    """Thin the benign class to about the size of the attacks together."""
    return sample_by_class(df, key, {BENIGN: fraction}, seed, label)


def union_synthetic(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Originals followed by synthetic rows, matched by column name."""
    return original.unionByName(synthetic)
