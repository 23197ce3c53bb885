"""Exact nearest neighbours inside each class for few columns, without comparing every pair.

In many columns one direction prunes nothing; ``near_join`` is for them.

Points are projected on one direction, which never makes two points look further apart than
they are. Each class is cut along that direction into slabs of about equal size:

1. every point looks for neighbours in its own slab, which bounds how far the true ones can be;
2. only points whose bound reaches past their slab visit the slabs it reaches;
3. the best of all visits are the exact neighbours.

Copies of a point are collapsed first, and a slab that many points share because their
projections are equal is dealt out over several parts, so neither a large class nor a point
repeated in a third of all rows lands in one task. A task holds one part of a slab and one
chunk of visitors, both of bounded size, and returns k rows per point, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from flowlens.functions.labels import MAX_CLASSES
from flowlens.operators.near_join import nearest_rows
from flowlens.runtime import bounded_rows, column, materialise, small_side

_CANDIDATES = "array<struct<d2 double, id bigint, x array<double>>>"
# Borders of slabs in a class; slabs that are larger for it are dealt out over parts.
_EDGES = 10_000
# Rows of a table with one row per slab that may be broadcast.
_MAX_SLABS = 200_000
# A slab this many times its usual size is dealt out over parts.
_CROWDED = 4


def _nearest(points: np.ndarray, others: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple]]:
    """For each point, the k nearest of ``others`` by (squared distance, id)."""
    order = np.argsort(ids, kind="stable")
    row, other, d2 = nearest_rows(points, others[order], k)
    found: list[list[tuple]] = [[] for _ in range(len(points))]
    for r, b, d in zip(row.tolist(), order[other].tolist(), d2.tolist()):
        found[r].append({"d2": d, "id": int(ids[b]), "x": others[b].tolist()})
    return found


def _matrix(column_of_arrays: pd.Series) -> np.ndarray:
    return np.stack(column_of_arrays.to_numpy()).astype(float)


def nearest_in_class(
    df: DataFrame, key: str, features: list[str], k: int = 5, label: str = "label", slab_rows: int = 8192
) -> DataFrame:
    """``class, x, near``: for every distinct point its ``k + 1`` nearest rows of the same class.

    ``near`` is ordered by (squared distance, id) and includes the rows at the point itself;
    a row's own neighbours are the first ``k`` entries that are not the row. ``key`` must be a
    unique whole number and the features must not be missing.
    """
    keep = k + 1
    # Adding 0.0 turns a negative zero positive, so that equal points group together.
    x = F.array(*[column(f).cast("double") + F.lit(0.0) for f in features])
    points = df.select(column(label).alias("class"), column(key).cast("bigint").alias("id"), x.alias("x"))
    # Of any number of copies of a point only the first k + 1 can be among the nearest. The
    # rank filter is applied before the shuffle too, so a hot point does not travel whole.
    copies = Window.partitionBy("class", "x").orderBy("id")
    points = points.where(F.col("class").isNotNull()).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= keep)

    spread = df.agg(*[F.coalesce(F.stddev_pop(column(f).cast("double")), F.lit(0.0)) for f in features]).first()
    direction = np.array([float(s) for s in spread])
    length = float(np.linalg.norm(direction))
    direction = direction / length if length > 0 else np.eye(len(features))[0]
    p = sum((F.col("x")[j] * F.lit(float(w)) for j, w in enumerate(direction)), F.lit(0.0))
    points = materialise(points.withColumn("p", p), "points")

    sizes = _class_sizes(points)
    edges = _slab_edges(points, sizes, slab_rows)
    whole = all(len(e) == 0 for e in edges.values())

    @F.pandas_udf(IntegerType())
    def slab_of(cls: pd.Series, p: pd.Series) -> pd.Series:
        out = np.zeros(len(p), dtype="int32")
        for name, at in cls.groupby(cls).groups.items():
            out[at] = np.searchsorted(edges[name], p[at].to_numpy(), side="right")
        return pd.Series(out)

    slabbed = points.withColumn("slab", F.lit(0) if whole else slab_of("class", "p")).withColumn("part", F.lit(0))
    crowded = None
    if max(sizes.values(), default=0) > _CROWDED * slab_rows:
        crowded = _crowded(slabbed, slab_rows)
        slabbed = (
            slabbed.join(crowded, ["class", "slab"], "left")
            .withColumn("part", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1))).cast("int"))
            .drop("parts")
        )

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        others, ids = _matrix(group["x"]), group["id"].to_numpy()
        firsts = group[group["copy"] == 1]
        near = _nearest(_matrix(firsts["x"]), others, ids, keep)
        bound = [c[-1]["d2"] if len(c) == keep else np.inf for c in near]
        return pd.DataFrame(
            {
                "class": firsts["class"].to_numpy(),
                "slab": firsts["slab"].to_numpy(),
                "part": firsts["part"].to_numpy(),
                "x": firsts["x"].to_numpy(),
                "p": firsts["p"].to_numpy(),
                "bound": bound,
                "near": near,
            }
        )

    own = slabbed.groupBy("class", "slab", "part").applyInPandas(
        inside, f"class string, slab int, part int, x array<double>, p double, bound double, near {_CANDIDATES}"
    )
    if whole and crowded is None:
        return own.select("class", "x", "near")
    own = materialise(own, "own-slab")
    visits = _visits(own, slab_of, crowded)
    return _merge(own, _visited(visits, slabbed, keep, slab_rows), keep)


def _class_sizes(points: DataFrame) -> dict[str, int]:
    counts = points.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return {r["class"]: r["n"] for r in bounded_rows(counts, MAX_CLASSES, "classes")}


def _slab_edges(points: DataFrame, sizes: dict[str, int], slab_rows: int) -> dict[str, np.ndarray]:
    """Per class the inner slab borders, from the class's own quantiles."""
    slabs = {c: min(_EDGES, -(-n // slab_rows)) for c, n in sizes.items()}
    edges = {c: np.array([]) for c in sizes}
    most = max(slabs.values(), default=1)
    if most > 1:
        grid = [i / most for i in range(1, most)]
        quantiles = points.groupBy("class").agg(F.percentile_approx("p", grid, 100_000).alias("q"))
        for r in bounded_rows(quantiles, MAX_CLASSES, "classes"):
            step = max(1, most // slabs[r["class"]])
            if slabs[r["class"]] > 1:
                edges[r["class"]] = np.unique(np.array(r["q"])[step - 1 :: step])
    return edges


def _crowded(slabbed: DataFrame, usual: int) -> DataFrame:
    """``class, slab, parts`` for slabs far above their usual size; mostly none."""
    sizes = slabbed.groupBy("class", "slab").agg(F.count(F.lit(1)).alias("n"))
    over = sizes.where(F.col("n") > _CROWDED * usual)
    return small_side(over.select("class", "slab", F.ceil(F.col("n") / usual).cast("int").alias("parts")), _MAX_SLABS)


def _visits(own: DataFrame, slab_of, crowded: DataFrame | None) -> DataFrame:
    """One row per point and foreign part of a slab that its reach touches."""
    # Widened a little so that rounding in the projection cannot hide a true neighbour.
    reach = F.sqrt("bound") * (1 + 1e-9) + F.abs("p") * 1e-9 + 1e-9
    touched = own.select(
        "class", "x", "bound", F.struct("slab", "part").alias("home"),
        slab_of("class", F.col("p") - reach).alias("from"), slab_of("class", F.col("p") + reach).alias("to"),
    )
    slabs = touched.select("class", "x", "bound", "home", F.explode(F.sequence("from", "to")).alias("slab"))
    if crowded is None:
        slabs = slabs.withColumn("parts", F.lit(1))
    else:
        slabs = slabs.join(crowded, ["class", "slab"], "left")
    last = F.coalesce("parts", F.lit(1)) - 1
    return (
        slabs.select("class", "x", "bound", "home", "slab", F.explode(F.sequence(F.lit(0), last)).alias("part"))
        .where(F.struct("slab", "part") != F.col("home"))
        .drop("home")
    )


def _visited(visits: DataFrame, slabbed: DataFrame, keep: int, chunk_rows: int) -> DataFrame:
    """Neighbours found in foreign slabs, but for those beyond what the own slab already offers.

    A slab with many visitors is served to chunks of them.
    """
    at = ["class", "slab", "part"]
    demand = visits.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    chunks = small_side(demand.select(*at, F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")), _MAX_SLABS)
    guests = visits.join(chunks, at).withColumn("chunk", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
    hosts = slabbed.join(chunks, at).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def serve(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if guest.empty or host.empty:
            return pd.DataFrame({"class": [], "x": [], "near": []}, dtype=object)
        near = _nearest(_matrix(guest["x"]), _matrix(host["x"]), host["id"].to_numpy(), keep)
        near = [[c for c in cs if c["d2"] <= limit] for cs, limit in zip(near, guest["bound"])]
        out = pd.DataFrame({"class": guest["class"].to_numpy(), "x": guest["x"].to_numpy(), "near": near})
        return out[out["near"].str.len() > 0]

    where = [*at, "chunk"]
    return (
        guests.select(*where, "x", "bound")
        .groupBy(*where)
        .cogroup(hosts.select(*where, "id", "x").groupBy(*where))
        .applyInPandas(serve, f"class string, x array<double>, near {_CANDIDATES}")
    )


def _merge(own: DataFrame, foreign: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` candidates per point over its own slab and all it visited."""
    both = own.select("class", "x", "near").unionByName(foreign)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, keep)
    return both.groupBy("class", "x").agg(best.alias("near"))
