"""Random forests on a 0/1 class as the library's models, grown a whole tree in a task.

The library sends, for each level, a histogram of all open nodes of all trees from each partition, and looks at rows one by one. Here
the training rows are cut into bins once and written as one byte a feature; each task reads them and grows some trees
(``functions.trees``), so no histogram travels and all forests over a table are one job. The nodes are written
in the library's storage layout and read as its model once something needs that.

Borders of bins come from all rows: each partition sends some hundred values of a feature with the rows they stand for, or
all its values if they are few. A feature of no more values than bins is cut between all of them.
Draws of rows, features and nodes depend on the seed, the forest, the tree and the order of the rows alone.

The scratch folder is one that all executors reach, by a path that pyarrow opens (local or shared mount, hdfs, s3, gs).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.trees import Growth, grow_trees
from flowlens.operators.features import assembler
from flowlens.runtime import column, scratch_path
from flowlens.sources.npy import open_path, read_header

#: Values that a partition sends of a feature.
POINTS = 1024
#: Tasks that all trees are dealt out to.
TASKS = 240
#: Bytes of rows that a task holds; of larger tables it holds as many rows as fit, and reads the others again.
HELD_BYTES = 256 << 20
# Bytes of a row besides its features: its place, how often it comes, and both again while rows are dealt to children.
_ROW_BYTES = 16
_NODES_AT_ONCE = 50_000
#: Rows that are taken through a forest together.
_ROWS_AT_ONCE = 100_000
_NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int,"
    " split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)
_NODES = f"treeID int, nodeData struct<{', '.join(part.strip().replace(' ', ': ', 1) for part in _NODE.split(',')[:8])}, {_NODE.split(',', 8)[8].strip().replace(' ', ': ', 1)}>"


@dataclass(frozen=True)
class Wanted:
    """A forest: its features, the class (0 or 1) of each code, and what a row of either class weighs."""

    features: list[str]
    classes: list[int]
    weights: tuple[float, float] | None = None


@dataclass(frozen=True)
class Binned:
    """Training rows on storage: a file for each partition, with the bins of each feature and the codes."""

    path: str
    features: list[str]
    borders: list[np.ndarray]
    rows: list[tuple[int, int]]
    bins: int


def _numbers(batch: pa.RecordBatch, j: int, name: str) -> np.ndarray:
    numbers = batch.column(j)
    values = numbers.to_numpy(zero_copy_only=False) if not numbers.null_count else None
    if values is None or np.isnan(values).any():
        raise ValueError(f"a missing value in {name!r}")
    return values


def _summaries(features: list[str], points: int):
    """``feature, v, n, whole``: values of each feature in a partition, the rows up to each, and whether these are all its values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[_numbers(b, j, f) for j, f in enumerate(features)] for b in batches if b.num_rows]
        for j in range(len(features) if held else 0):
            values, counts = np.unique(np.concatenate([h[j] for h in held]), return_counts=True)
            whole = len(values) <= points
            if not whole:
                ends = counts.cumsum()
                last = np.unique(np.searchsorted(ends, np.arange(1, points + 1) * ends[-1] // points))
                values, counts = values[last], np.diff(ends[last], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([j], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.int64())), pa.array([whole])],
                names=["feature", "v", "n", "whole"],
            )

    return work


def borders_of(values: np.ndarray, counts: np.ndarray, whole: bool, bins: int) -> np.ndarray:
    """Up to ``bins - 1`` borders between sorted distinct values that stand for so many rows each; a value at a border lies below it."""
    if whole and len(values) <= bins:
        last = np.arange(len(values) - 1)
    else:
        ends = counts.cumsum()
        last = np.unique(np.searchsorted(ends, np.arange(1, bins) * ends[-1] / bins))
        last = last[last < len(values) - 1]
    low, high = values[last], values[last + 1]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = low + (high - low) / 2
    return np.where(np.isfinite(middle) & (middle < high), middle, low)


def _merged(bins: int):
    def work(table: pa.Table) -> pa.Table:
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks])
        n = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["n"].chunks])
        values, at = np.unique(v, return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, n)
        found = borders_of(values, counts, all(table["whole"].to_pylist()), bins)
        return pa.table({"feature": table["feature"][:1], "borders": pa.array([found], pa.list_(pa.float64()))})

    return work


def binned(held: DataFrame, features: list[str], code: str, bins: int) -> Binned:
    """The rows of ``held`` in bins, in its order; ``code`` is a whole number from 0. A missing number or code is an error."""
    x = [column(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]
    found = held.select(*x).mapInArrow(_summaries(features, max(POINTS, 4 * bins)), "feature int, v array<double>, n array<bigint>, whole boolean")
    found = found.groupBy("feature").applyInArrow(_merged(bins), "feature int, borders array<double>").collect()
    borders = [np.zeros(0)] * len(features)
    for r in found:
        borders[r["feature"]] = np.array(r["borders"], dtype=float)
    path = scratch_path(held.sparkSession, "bins")
    kind = np.uint8 if bins <= 256 else np.uint16

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, codes = [], []
        for b in batches:
            if not b.num_rows:
                continue
            if b.column(len(features)).null_count:
                raise ValueError(f"a missing value in {code!r}")
            x.append(np.stack([np.searchsorted(borders[j], _numbers(b, j, f)).astype(kind) for j, f in enumerate(features)]))
            codes.append(b.column(len(features)).to_numpy(zero_copy_only=False).astype(np.uint16))
        if not codes:
            return
        part = TaskContext.get().partitionId()
        fs, base = open_path(path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{part:06d}.npy") as out:  # a task that runs again writes the same file again
            np.lib.format.write_array(out, np.concatenate(x, axis=1), allow_pickle=False)
            out.write(np.concatenate(codes).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sum(map(len, codes))])], names=["part", "rows"])

    written = held.select(*x, column(code).cast("int").alias("code")).mapInArrow(work, "part bigint, rows bigint").collect()
    return Binned(path, features, borders, sorted((r["part"], r["rows"]) for r in written), bins)


def _cells(table: Binned, wanted: Wanted) -> Callable[[], Iterator[np.ndarray]]:
    """Reads the cells of a forest's features, block by block."""
    columns, classes = [table.features.index(f) for f in wanted.features], np.array(wanted.classes, dtype=np.uint8)
    kind = np.uint8 if table.bins <= 128 else np.uint16

    def blocks() -> Iterator[np.ndarray]:
        fs, base = open_path(table.path)
        for part, rows in table.rows:
            with fs.open_input_file(f"{base}/{part:06d}.npy") as raw:
                height, _, offset, stored, _ = read_header(raw)
                raw.seek(offset + height * rows * stored.itemsize)
                flags = classes[np.frombuffer(raw.read(2 * rows), np.uint16)]
                cells = np.empty((len(columns), rows), kind)
                for i, j in enumerate(columns):
                    raw.seek(offset + j * rows * stored.itemsize)
                    np.left_shift(np.frombuffer(raw.read(rows * stored.itemsize), stored), 1, out=cells[i], dtype=kind, casting="unsafe")
                cells |= flags
            yield cells

    return blocks


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _as_nodes(nodes: dict[str, np.ndarray], growth: Growth, borders: list[np.ndarray]) -> pa.StructArray:
    """A tree in the library's storage layout."""
    tallies, inner = nodes["tallies"], nodes["left"] >= 0
    weighed = tallies * growth.weights
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.nan_to_num(weighed / weighed.sum(axis=1, keepdims=True))
    impurity = share[:, 0] * share[:, 1] * (1.0 if growth.regression else 2.0)
    stats = np.stack([tallies.sum(axis=1), tallies[:, 1], tallies[:, 1]], axis=1) if growth.regression else weighed
    flat = np.concatenate([*borders, [0.0]])
    starts = np.concatenate([[0], np.cumsum([len(b) for b in borders])])
    at = starts[np.maximum(nodes["feature"], 0)] + np.maximum(nodes["border"], 0)
    split = pa.StructArray.from_arrays(
        [
            pa.array(nodes["feature"].astype(np.int32)),
            _lists(flat[at[inner]], np.concatenate([[0], np.cumsum(inner)])),
            pa.array(np.full(len(inner), -1, np.int32)),
        ],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(np.arange(len(inner), dtype=np.int32)),
            pa.array(np.nan_to_num(nodes["says"])),
            pa.array(impurity),
            _lists(stats.ravel(), np.arange(len(inner) + 1) * stats.shape[1]),
            pa.array(tallies.sum(axis=1).astype(np.int64)),
            pa.array(nodes["gain"]),
            pa.array(nodes["left"].astype(np.int32)),
            pa.array(nodes["right"].astype(np.int32)),
            split,
        ],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )


def grown(table: Binned, spark: SparkSession, wanted: dict[str, Wanted], settings: dict, regression: bool = False, flag: str = "flag", weight: str | None = None) -> dict[str, PipelineModel]:
    """The wanted forests of one size (``settings`` of the library's learner) over one table, as pipelines of the library's models."""
    names, trees = list(wanted), settings["numTrees"]
    if not table.rows:
        raise ValueError("no rows to learn from")
    each = max(1, -(-trees * len(names) // TASKS))
    tasks = [(f, first, min(trees, first + each)) for f in range(len(names)) for first in range(0, trees, each)]
    growths = {n: _growth(w, table.bins, settings, regression) for n, w in wanted.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in (t for b in batches for t in b.column(0).to_pylist()):
            forest, first, last = tasks[task]
            own, growth = wanted[names[forest]], growths[names[forest]]
            borders = [table.borders[table.features.index(f)] for f in own.features]
            held = HELD_BYTES // (len(own.features) * (1 if table.bins <= 128 else 2) + _ROW_BYTES)
            draws = [(settings["seed"], forest, tree) for tree in range(first, last)]
            for tree, nodes in zip(range(first, last), grow_trees(_cells(table, own), [n for _, n in table.rows], growth, draws, held)):
                data = _as_nodes(nodes, growth, borders)
                for at in range(0, len(data), _NODES_AT_ONCE):
                    part = data.slice(at, _NODES_AT_ONCE)
                    same = [pa.array(np.full(len(part), v, np.int32)) for v in (forest, tree)]
                    yield pa.RecordBatch.from_arrays([*same, part], names=["forest", "treeID", "nodeData"])

    path = scratch_path(spark, "trees")
    numbers = spark.range(0, len(tasks), 1, len(tasks))
    numbers.mapInArrow(work, f"forest int, {_NODES}").write.partitionBy("forest").parquet(path)
    kind = _GrownRegression if regression else _GrownClassification
    learner = RandomForestRegressor if regression else RandomForestClassifier
    models = {}
    for number, (name, own) in enumerate(wanted.items()):
        forest = Stored(f"{path}/forest={number}", own.features, trees, regression)
        planned = learner(labelCol=flag, featuresCol="features", **settings)
        models[name] = PipelineModel([assembler(own.features), kind(planned if weight is None else planned.setWeightCol(weight), forest)])
    return models


@dataclass(frozen=True)
class Stored:
    """Where the nodes of a grown forest lie."""

    path: str
    features: list[str]
    trees: int
    regression: bool


class _Grown:
    """A model of the library whose trees stay on storage until Java needs them: the driver holds no trees that only tasks read."""

    def __init__(self, learner, forest: Stored):
        super().__init__()
        self.__dict__["trees"] = []  # Params would ask for them, and wrap each for Python, which takes longer than growing it
        self._resetUid(learner.uid)
        learner._copyValues(self)
        del self.__dict__["trees"]
        self._learner, self.stored = learner, forest

    @property
    def _java_obj(self):
        if self.__dict__.get("_java") is None and "stored" in self.__dict__:
            self.__dict__["_java"] = _loaded(self._learner, self.stored)
        return self.__dict__.get("_java")

    @_java_obj.setter
    def _java_obj(self, java) -> None:
        self.__dict__["_java"] = java

    def __del__(self) -> None:
        if self.__dict__.get("_java") is not None:
            super().__del__()


class _GrownClassification(_Grown, RandomForestClassificationModel):
    pass


class _GrownRegression(_Grown, RandomForestRegressionModel):
    pass


def _loaded(learner, forest: Stored):
    """The library's model of the stored nodes, as Java holds it: that of a fit to two rows, saved, with these nodes instead of its own."""
    spark, target = SparkSession.active(), scratch_path(SparkSession.active(), "forest")
    label, weight = learner.getLabelCol(), learner.getWeightCol() if learner.isSet("weightCol") else "weight"
    rows = [(DenseVector([0.0] * len(forest.features)), float(c), 1.0) for c in (0, 1)]
    two = spark.createDataFrame(rows, ["features", "label", "weight"])
    two = two.select("features", F.col("label").alias(label, metadata={"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}), F.col("weight").alias(weight))
    learner._fit_java(two).save(target)
    spark.read.schema(_NODES).parquet(forest.path).write.mode("overwrite").parquet(f"{target}/data")
    kind = RandomForestRegressionModel if forest.regression else RandomForestClassificationModel
    return kind.read()._jread.load(target)


def stored(model: PipelineModel) -> Stored | None:
    """Of a forest grown here; of one that was saved and loaded since, or is the library's own, nothing."""
    return getattr(model.stages[-1], "stored", None)


def _trees(forest: Stored) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, threshold, left child or -1, what it says) of the nodes of each tree, in the order of the trees; a right child follows its left one."""
    fs, base = open_path(forest.path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
    found = {}
    for file in files:
        with fs.open_input_file(file) as raw:
            table = pq.ParquetFile(raw).read()
        if not table.num_rows:
            continue
        data = table["nodeData"].combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        tree, number = table["treeID"].to_numpy(), data.field("id").to_numpy()
        left, split = data.field("leftChild").to_numpy(), data.field("split")
        threshold = np.full(len(tree), np.inf)
        threshold[left >= 0] = split.field("leftCategoriesOrThreshold").flatten().to_numpy()
        if forest.regression:
            says = data.field("prediction").to_numpy()
        else:
            stats = data.field("impurityStats").flatten().to_numpy().reshape(-1, 2)
            with np.errstate(invalid="ignore", divide="ignore"):
                says = np.nan_to_num(stats[:, 1] / stats.sum(axis=1))
        nodes = split.field("featureIndex").to_numpy(), threshold, left, says
        for t in np.unique(tree).tolist():
            own = np.flatnonzero(tree == t)
            own = own[number[own].argsort()]
            found[t] = tuple(n[own] for n in nodes)
    yield from (found[t] for t in sorted(found))


def _votes(forest: Stored, x: np.ndarray) -> np.ndarray:
    """The mean of what the trees say of each row; ``x``: (features, rows)."""
    rows, flat, total = x.shape[1], np.ascontiguousarray(x).reshape(-1), np.zeros(x.shape[1])
    for feature, threshold, left, says in _trees(forest):
        feature = feature * np.int64(rows)
        at, row, end = np.zeros(rows, np.int64), np.arange(rows), np.zeros(rows, np.int64)
        while len(row):
            child = left.take(at)
            inner = child >= 0
            if not inner.all():
                end[row[~inner]] = at[~inner]
                row, at, child = row[inner], at[inner], child[inner]
            at = child + (flat.take(feature.take(at) + row) > threshold.take(at))
        total += says.take(end)
    return total / forest.trees


def scored(df: DataFrame, forests: dict[str, Stored]) -> DataFrame:
    """Adds what each forest says of a row: the probability of class 1, or the prediction of a regression.

    The library would send all trees with every task and follow them for one row after the other. Here a task reads the trees from
    storage, a forest at a time, and takes many rows through a tree together.
    """
    names = list(dict.fromkeys(f for w in forests.values() for f in w.features))
    places = [df.columns.index(n) for n in names]
    schema = df.select("*", *[F.lit(0.0).alias(n) for n in forests]).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches):
            x = np.stack([np.concatenate([_numbers(b, j, n).astype(float) for b in held]) for j, n in zip(places, names)])
            found = [_votes(w, x[[names.index(f) for f in w.features]]) for w in forests.values()]
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v[at : at + b.num_rows]) for v in found)], names=[*b.schema.names, *forests])
                at += b.num_rows

    return df.mapInArrow(work, schema)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= _ROWS_AT_ONCE:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _growth(wanted: Wanted, bins: int, settings: dict, regression: bool) -> Growth:
    p = len(wanted.features)
    # as the library chooses by itself; a single tree looks at all features
    subset = p if settings["numTrees"] == 1 else math.ceil(p / 3) if regression else math.ceil(math.sqrt(p))
    return Growth(bins, p, subset, settings["maxDepth"], settings["minInstancesPerNode"], wanted.weights or (1.0, 1.0), regression)
