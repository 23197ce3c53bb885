"""Pairs inside groups without a group in one task, and connected components of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.runtime import materialise, small_side


def pair_tiles(df: DataFrame, keys: list[str], ident: str, tile: int) -> DataFrame:
    """Deal every group of ``keys`` out so that any two of its rows meet in exactly one tile pair.

    Adds ``lo``, ``hi`` and ``side``. A group of up to ``tile`` rows is one pair (0, 0). A larger one is cut
    into s parts by a hash of ``ident``; a row goes to the s pairs its part belongs to, so no task holds
    more than about two parts, whatever the size of the group. Two rows of the same part meet in (part,
    part), others in (smaller part, larger part).
    """
    large = df.groupBy(*keys).count().where(F.col("count") > tile)
    large = large.select(*keys, F.ceil(F.col("count") / F.lit(tile)).cast("int").alias("_parts"))
    dealt = df.join(small_side(large, 50_000), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.withColumns({"lo": F.least("side", "_other"), "hi": F.greatest("side", "_other")}).drop("_parts", "_other")


def sorted_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys together and sorted, for a pass that streams over them."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node that links reach.

    Alternates linking every larger neighbour, then every smaller one, to the smallest neighbour. Each
    round is written to the shared folder; nothing but two totals of it reaches the driver. Self links and
    repeated links are allowed, null ends are left out.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = materialise(links.where("u <> v").distinct(), "links")
    mark = _mark(links)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _mark(links: DataFrame) -> tuple:
    """Number of links and the sum of their hashes: equal for equal sets, whatever their order."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Merger:
    """Groups of equal label among ``n`` items of one task; ``edges`` has one link for every merge."""

    def __init__(self, n: int):
        self.labels = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others:
            mine, other = self.labels[i], self.labels[j]
            if mine != other:
                self.labels[self.labels == other] = mine
                self.edges.append((i, int(j)))
