"""Near-duplicate vectors by collision counting over sorted projections, with an exact check.

``lists`` lists are sorted, each by ``signs`` coarse projections (their signs) and then by one fine
projection. A window centred on each vector, inside the run of equal signs, holds its collisions. Two
vectors that meet in at least ``PASS`` lists are compared in double precision. Both numbers follow from
the number of vectors and the recall asked for, by one rule at every size:

* signs = log2(vectors / ROWS), so a run of equal signs has about ``ROWS`` vectors whatever the total;
* a pair of cosine 0.95 keeps its signs and stays in the window with probability
  p = (1 - angle / pi) ** signs * P(|normal| < WINDOW); the lists are as many as make
  P(binomial(lists, p) >= PASS) reach the recall.

A pair is checked in the list that brings its PASS-th collision, so it is counted once and nothing is
collected about pairs. Runs beyond ``TILE`` vectors are dealt over pairs of tiles. Vectors with the same
components form one class and are compared once. From a task come counts and one link for every merge.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep
their own id as component. Lengths may differ between rows; only equal lengths are compared. Ids may be
null or repeat. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.batches import column, runs
from flowlens.llm.grouping import Merger, components, pair_tiles, sorted_by
from flowlens.runtime import column as named
from flowlens.runtime import materialise

ROWS = 1024
TILE = 4096
WINDOW = 2.2
PASS = 2
RECALL = 0.9999
_PAIRS = 1 << 18


def plan_lists(vectors: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(signs, lists) for so many vectors."""
    signs = max(3, round(math.log2(max(vectors, 1) / ROWS)))
    p = (1 - math.acos(threshold) / math.pi) ** signs * math.erf(WINDOW / math.sqrt(2))
    lists = PASS
    while 1 - (1 - p) ** lists - lists * p * (1 - p) ** (lists - 1) < recall:
        lists += 1
    return signs, lists


def directions(width: int, signs: int, lists: int) -> np.ndarray:
    """``lists`` * (``signs`` + 1) fixed random directions; the last of each list is the fine one."""
    return np.random.default_rng(width).standard_normal((width, lists * (signs + 1)))


def _valid(row) -> bool:
    return bool(row is not None and len(row) and all(x is not None and math.isfinite(x) for x in row) and any(row))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, data = [], [], []
        for i, row in enumerate(batch.column(1).to_pylist()):
            if _valid(row):
                raw = (np.array(row, dtype=np.float64) + 0.0).tobytes()
                ids.append(i)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                data.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
            names=["id", "cls", "vec"],
        )


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _listed(signs: int, lists: int):
    """Every vector once per list, with its run and where it lies in all lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for width in sorted({len(x) for x in raw}):
                rows = np.array([i for i, x in enumerate(raw) if len(x) == width])
                unit = _unit(np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.float64).reshape(len(rows), -1))
                points = (unit @ directions(width // 8, signs, lists)).reshape(len(rows), lists, signs + 1)
                code = ((points[:, :, :signs] > 0) << np.arange(signs)).sum(axis=2).astype(np.int32)
                fine = points[:, :, signs].astype(np.float32)
                where = [code[i].tobytes() + fine[i].tobytes() for i in range(len(rows))]
                cls, vec = batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))
                copies = batch.column(2).take(pa.array(rows))
                for t in range(lists):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), t, np.int32)),
                            pa.array(np.full(len(rows), width, np.int32)),
                            pa.array(code[:, t]),
                            cls,
                            vec,
                            copies,
                            pa.array(where, pa.binary()),
                        ],
                        names=["list", "width", "code", "cls", "vec", "copies", "places"],
                    )

    return work


def _counted(lists: int, threshold: float, window: float):
    """In each run: links of every class from pairs whose PASS-th collision is here, and one link per merge."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, borders in runs(batches, ["list", "width", "code", "lo", "hi"]):
            t_of = table.column("list").to_numpy()
            side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            two_parts = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            cls, raw, places = column(table, "cls"), column(table, "vec"), column(table, "places")
            left, right, links = [], [], []
            for g in range(len(borders) - 1):
                a, b = int(borders[g]), int(borders[g + 1])
                if b - a < 2:
                    continue
                t = int(t_of[a])
                own = np.frombuffer(b"".join(places.slice(a, b - a).to_pylist()), dtype=np.int32).reshape(b - a, 2 * lists)
                code, fine = own[:, :lists], own[:, lists:].view(np.float32)
                order = np.argsort(fine[:, t], kind="stable")
                code, fine = np.ascontiguousarray(code[order]), np.ascontiguousarray(fine[order])
                unit = _unit(np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), dtype=np.float64).reshape(b - a, -1))[order]
                sides, weight = side[a:b][order], copies[a:b][order]
                ends = np.searchsorted(fine[:, t], fine[:, t] + np.float32(window), side="right")
                total = np.zeros(b - a, dtype=np.int64)
                merger = Merger(b - a)
                for i, j in _window_pairs(ends):
                    if two_parts[a]:
                        apart = sides[i] != sides[j]
                        i, j = i[apart], j[apart]
                    i, j = _nth_collision(code, fine, t, i, j, window)
                    near = (unit[i] * unit[j]).sum(axis=1) >= threshold
                    i, j = i[near], j[near]
                    np.add.at(total, i, weight[j])
                    np.add.at(total, j, weight[i])
                    apart = merger.labels[i] != merger.labels[j]
                    for x, y in zip(i[apart], j[apart]):
                        merger.link(int(x), np.array([y]))
                rows = a + order
                left += [rows[k] for k in np.flatnonzero(total)] + [rows[x] for x, _ in merger.edges]
                right += [None] * int((total > 0).sum()) + [rows[y] for _, y in merger.edges]
                links += [int(x) for x in total[total > 0]] + [0] * len(merger.edges)
            if left:
                yield pa.RecordBatch.from_arrays(
                    [cls.take(pa.array(left, pa.int64())), cls.take(pa.array(right, pa.int64())), pa.array(links, pa.int64())],
                    names=["a", "b", "links"],
                )

    return work


def _window_pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sorted places (i, j), i < j < ends[i], in blocks of bounded size."""
    size = ends - np.arange(len(ends)) - 1
    first = 0
    reach = np.cumsum(size)
    while first < len(ends):
        done = reach[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(reach, done + _PAIRS, side="right")))
        n = size[first:last]
        i = np.repeat(np.arange(first, last), n)
        if len(i):
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield i, j
        first = last


def _nth_collision(code, fine, t: int, i: np.ndarray, j: np.ndarray, window: float):
    """Of pairs that collide in list ``t``, those with exactly PASS - 1 collisions in earlier lists."""
    found = np.zeros(len(i), dtype=np.int8)
    for s in range(t):
        found += (code[i, s] == code[j, s]) & (np.abs(fine[i, s] - fine[j, s]) <= np.float32(window))
        stay = found < PASS
        if s % 4 == 3 and not stay.all():
            i, j, found = i[stay], j[stay], found[stay]
    here = (found == PASS - 1) & (np.abs(fine[i, t] - fine[j, t]) <= np.float32(window))
    return i[here], j[here]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept`` (its id is the component's)."""
    kind = vectors.schema[id_col].dataType.simpleString()
    source = vectors.select(named(id_col).alias("id"), named(vector_col).alias("vec"))
    valid = materialise(source.mapInArrow(_prepared, f"id {kind}, cls binary, vec binary"), "vectors")
    classes = materialise(
        valid.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec")), "classes"
    )
    signs, lists = plan_lists(classes.count(), threshold)
    window = WINDOW * math.sqrt(2 - 2 * threshold)
    listed = classes.select("cls", "vec", "copies").mapInArrow(
        _listed(signs, lists), "list int, width int, code int, cls binary, vec binary, copies bigint, places binary"
    )
    keys = ["list", "width", "code"]
    dealt = sorted_by(pair_tiles(listed, keys, "cls", TILE), [*keys, "lo", "hi"])
    found = materialise(dealt.mapInArrow(_counted(lists, threshold, window), "a binary, b binary, links bigint"), "near")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    full = classes.select("cls", "rep", "copies").join(links, "cls", "left").join(roots, "cls", "left")
    full = full.withColumn("root", F.coalesce("root", "cls"))
    least = full.groupBy("root").agg(F.min("rep").alias("component"))
    full = full.join(least, "root").select(
        "cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component")
    )
    linked = valid.select("id", "cls").join(materialise(full, "linked"), "cls").select("id", "n_links", "component")
    usable = F.coalesce(
        (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    other = source.where(~usable).select("id", F.lit(0).cast("bigint"), "id")
    return linked.union(other).select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
