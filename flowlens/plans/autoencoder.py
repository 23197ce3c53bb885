"""Autoencoders for rows without labels, trained data-parallel.

Rows are dealt into groups of about ``rows_per_group`` by a hash of their key (of their values without one), so that the
number of groups follows from the number of rows and the result does not depend on how the table was
partitioned. An epoch is one Spark job: every group takes its rows through mini-batches, starting from the same weights
and the same state of the optimiser; a task adds up what its groups end with, and the sums of tasks are added up
64 at a time until few are left. Their row-weighted mean, weights and optimiser state alike, starts the next epoch. The same
job measures the weights it starts from on the rows to stop by. Only the mean, whose size depends on the layer
widths alone, reaches the driver, where it survives the loss of any executor.

Inner layers are rectifiers, the output is linear. A rectifier that is off still passes a small part of
the error back (``LEAK``), so that units of a narrow layer cannot die.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from flowlens.fixed_values import AUTOENCODER_CODE, AUTOENCODER_WIDTHS
from flowlens.operators.features import assembler
from flowlens.operators.reconstruction import mean_squared_difference
from flowlens.runtime import column


@dataclass(frozen=True)
class Autoencoder:
    """Layer widths from input over the code back to the input, and all weights in one array."""

    widths: list[int]
    code: int
    weights: np.ndarray
    losses: tuple[float, ...] = ()


@dataclass(frozen=True)
class Training:
    epochs: int = 1000
    batch: int = 100
    rate: float = 0.001
    optimiser: str = "rmsprop"
    sparsity: float = 1e-4
    patience: int = 20
    min_delta: float = 1e-4
    seed: int = 1
    rows_per_group: int = 8192


# Tasks of a pass up to this number hold one group each, beyond it up to 64.
_TASKS = 4096
# A pass of more tasks than this deals out that many groups to each before it takes more tasks.
_USUAL_TASKS, _GROUPS_OF_TASK = 192, 32
# Sums that are added up by one task.
_FAN_IN = 64


#: Share of the error that passes a rectifier that is off, in training only.
LEAK = 0.1


def new_autoencoder(inputs: int, hidden: list[int] | None = None, code: int = AUTOENCODER_CODE, seed: int = 1) -> Autoencoder:
    """A symmetric network with random weights, scaled for rectifiers."""
    hidden = hidden if hidden is not None else AUTOENCODER_WIDTHS
    widths = [inputs, *hidden, code, *reversed(hidden), inputs]
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(widths, widths[1:]):
        bound = np.sqrt(6.0 / a)
        parts += [rng.uniform(-bound, bound, a * b), np.full(b, 0.01)]
    return Autoencoder(widths, len(hidden) + 1, np.concatenate(parts))


def layers_of(widths: list[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat weights as (matrix, offset) per layer."""
    layers, at = [], 0
    for a, b in zip(widths, widths[1:]):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def activations(layers: list, x: np.ndarray, last: int) -> list[np.ndarray]:
    """The rows at every layer, input first: rectifiers, linear at layer ``last``."""
    seen = [x]
    for k, (w, b) in enumerate(layers):
        out = seen[-1] @ w + b
        seen.append(out if k == last else np.maximum(out, 0.0))
    return seen


def gradient(widths: list[int], flat: np.ndarray, x: np.ndarray, sparsity: float, leak: float = LEAK) -> np.ndarray:
    """Gradient of mean squared error plus an L1 charge on the first layer's activity."""
    layers, grad = layers_of(widths, flat), np.zeros_like(flat)
    into = layers_of(widths, grad)
    seen = activations(layers, x, len(layers) - 1)
    back = 2.0 * (seen[-1] - x) / x.size
    for i in range(len(layers) - 1, -1, -1):
        if i == 0:
            back = back + sparsity * np.sign(seen[1]) / len(x)
        if i < len(layers) - 1:
            back = back * np.where(seen[i + 1] > 0, 1.0, leak)
        into[i][0][:] = seen[i].T @ back
        into[i][1][:] = back.sum(axis=0)
        back = back @ layers[i][0].T
    return grad


class _Steps:
    """The optimiser over one group's rows, in mini-batches that do not depend on how the rows arrive."""

    def __init__(self, widths: list[int], state: np.ndarray, t: Training):
        self.widths, self.t = widths, t
        # weights, running mean and running square of the gradient, and how many steps they have seen
        self.w, self.mean, self.square = (part.copy() for part in state[:-1].reshape(3, -1))
        self.steps, self.rows, self.waiting = float(state[-1]), 0, np.zeros((0, widths[0]))

    def take(self, data: np.ndarray) -> None:
        self.rows += len(data)
        self.waiting = np.concatenate([self.waiting, data])
        whole = len(self.waiting) // self.t.batch * self.t.batch
        for at in range(0, whole, self.t.batch):
            self.step(self.waiting[at : at + self.t.batch])
        self.waiting = self.waiting[whole:]

    def step(self, x: np.ndarray) -> None:
        t, g = self.t, gradient(self.widths, self.w, x, self.t.sparsity)
        self.steps += 1
        if t.optimiser == "adam":
            self.mean = 0.9 * self.mean + 0.1 * g
            self.square = 0.999 * self.square + 0.001 * g * g
            self.w -= t.rate * (self.mean / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.999**self.steps)) + 1e-7)
        else:
            self.square = 0.9 * self.square + 0.1 * g * g
            self.w -= t.rate * g / (np.sqrt(self.square) + 1e-7)

    def result(self) -> np.ndarray:
        if len(self.waiting):
            self.step(self.waiting)
        return np.concatenate([self.w, self.mean, self.square, [self.steps]])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``g, x``: the rows of a run of one group as the bytes of a matrix, which every epoch reads without taking arrays apart."""
    for batch in batches:
        groups, width = batch.column(0).to_numpy(), len(batch.column(1)) and len(batch.column(1)[0])
        rows = batch.column(1).flatten().to_numpy().reshape(len(groups), width)
        borders = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else []
        for a, b in zip(borders, [*borders[1:], len(groups)]):
            yield pa.RecordBatch.from_arrays([pa.array(groups[a : a + 1]), pa.array([rows[a:b].tobytes()], pa.binary())], names=["g", "x"])


def _epoch(widths: list[int], state: np.ndarray, t: Training, learn: bool):
    """One row per task: what its training groups end with, times their rows, and the error on the rows to stop by."""
    size = (len(state) - 1) // 3

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, error, checked = np.zeros_like(state), 0, 0.0, 0
        group, steps = None, None
        for batch in batches:
            for g, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(packed.as_buffer(), dtype=np.float64).reshape(-1, widths[0])
                if g < 0:
                    rebuilt = activations(layers_of(widths, state[:size]), x, len(widths) - 2)[-1]
                    error, checked = error + float(((rebuilt - x) ** 2).mean(axis=1).sum()), checked + len(x)
                    continue
                if g != group:
                    if steps is not None:
                        total, rows = total + steps.result() * steps.rows, rows + steps.rows
                    group, steps = g, _Steps(widths, state, t) if learn else None
                if steps is not None:
                    steps.take(x)
        if steps is not None:
            total, rows = total + steps.result() * steps.rows, rows + steps.rows
        sums = np.concatenate([total, [rows, error, checked]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["slot", "sums"])

    return work


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("slot")  # in one order, so that the sum is the same again
    sums = sum(np.frombuffer(x, dtype=np.float64) for x in table["sums"].to_pylist())
    return pa.table({"slot": [table["slot"][0].as_py() // _FAN_IN], "sums": pa.array([sums.tobytes()], pa.binary())})


def added_up(sums: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the tasks' rows, in the order of their numbers; few rows reach the driver."""
    while tasks > _FAN_IN:
        sums = sums.groupBy(F.floor(F.col("slot") / _FAN_IN)).applyInArrow(_added, "slot bigint, sums binary")
        tasks = -(-tasks // _FAN_IN)
    return np.frombuffer(_added(sums.toArrow())["sums"][0].as_py(), dtype=np.float64)


def scale_rows(df: DataFrame, features: list[str]) -> PipelineModel:
    """Named columns to a vector scaled to [0, 1], the range a rectifier output can rebuild."""
    return Pipeline(stages=[assembler(features, "raw"), MinMaxScaler(inputCol="raw", outputCol="scaled")]).fit(df)


def scaled_rows(scaler: PipelineModel, df: DataFrame) -> DataFrame:
    """The table with the scaled row as an array ``x``."""
    return scaler.transform(df).withColumn("x", vector_to_array("scaled")).drop("raw", "scaled")


def groups_of(rows: int, training: Training) -> tuple[int, int]:
    """(groups, tasks) of a pass over so many rows; every task has about the same number of whole groups."""
    groups = max(1, math.ceil(rows / training.rows_per_group))
    return groups, min(groups, max(_TASKS, math.ceil(groups / 64)))


def tasks_of(rows: int, training: Training) -> int:
    """Tasks of a pass over so many rows: as ``groups_of`` says while they are few. A group takes a fraction of a second, no
    longer than starting its task and adding up what it sends, so larger tables have tasks of several groups."""
    groups, tasks = groups_of(rows, training)
    return min(tasks, max(_USUAL_TASKS, math.ceil(groups / _GROUPS_OF_TASK)))


def fit_autoencoder(train: DataFrame, valid: DataFrame, start: Autoencoder, training: Training = Training(), key: str | None = None) -> Autoencoder:
    """Train on the arrays ``x`` of one table, stop by the reconstruction error on another.

    ``key`` names a column that tells rows apart; without it equal rows share a group.
    """
    place = F.xxhash64(column(key)) if key else F.xxhash64("x")
    rows = train.count()
    groups, tasks = groups_of(rows, training)[0], tasks_of(rows, training)
    # rows to stop by are dealt out like the others, in groups with negative numbers
    dealt = train.select(F.pmod(place, F.lit(groups)).alias("g"), place.alias("place"), "x").unionByName(
        valid.select((-1 - F.pmod(F.xxhash64("x"), F.lit(groups))).alias("g"), F.lit(0).cast("bigint").alias("place"), "x")
    )
    dealt = dealt.repartition(tasks, F.when(F.col("g") < 0, -1 - F.col("g")).otherwise(F.col("g")))
    ordered = dealt.sortWithinPartitions("g", "place", "x").select("g", "x")
    held = ordered.mapInArrow(_packed, "g bigint, x binary").persist(StorageLevel.MEMORY_AND_DISK)
    size = len(start.weights)
    state = np.concatenate([start.weights, np.zeros(2 * size + 1)])
    best, best_loss, reference, losses, stale = start, float("inf"), float("inf"), [], 0
    try:
        for epoch in range(training.epochs + 1):
            passed = held.mapInArrow(_epoch(start.widths, state, training, epoch < training.epochs), "slot bigint, sums binary")
            sums = added_up(passed, tasks)
            if epoch:  # the weights that this epoch started from are those the last one ended with
                losses.append(float(sums[-2] / sums[-1]))
                if losses[-1] < best_loss:
                    best, best_loss = replace(start, weights=state[:size].copy()), losses[-1]
                if losses[-1] < reference - training.min_delta:
                    reference, stale = losses[-1], 0
                else:
                    stale += 1
                    if stale >= training.patience:
                        break
            if epoch < training.epochs:
                state = sums[:-3] / sums[-3]
    finally:
        held.unpersist()
    return replace(best, losses=tuple(losses))


def _layer_udf(model: Autoencoder, layer: int):
    widths, weights = model.widths, model.weights

    @F.pandas_udf(ArrayType(DoubleType()))
    def at_layer(x: pd.Series) -> pd.Series:
        if x.empty:
            return x
        return pd.Series(list(activations(layers_of(widths, weights)[:layer], np.stack(x.to_numpy()), len(widths) - 2)[-1]))

    return at_layer


def with_code(df: DataFrame, model: Autoencoder) -> DataFrame:
    """Adds ``code``: the row at the narrowest layer of the trained network."""
    return df.withColumn("code", _layer_udf(model, model.code)(F.col("x")))


def with_error(df: DataFrame, model: Autoencoder) -> DataFrame:
    """Adds ``error``: mean squared difference between the row and its reconstruction."""
    rebuilt = df.withColumn("rebuilt", _layer_udf(model, len(model.widths) - 1)(F.col("x")))
    return rebuilt.withColumn("error", mean_squared_difference(F.col("x"), F.col("rebuilt"))).drop("rebuilt")


def sweep_autoencoders(
    train: DataFrame, valid: DataFrame, inputs: int, candidates: dict[str, list[int]], training: Training = Training(), key: str | None = None
) -> DataFrame:
    """``name, widths, epochs, best_loss`` for several layer widths over the same tables."""
    rows = []
    for name, hidden in candidates.items():
        fitted = fit_autoencoder(train, valid, new_autoencoder(inputs, hidden, seed=training.seed), training, key)
        rows.append((name, "-".join(map(str, hidden)), len(fitted.losses), min(fitted.losses)))
    return train.sparkSession.createDataFrame(rows, "name string, widths string, epochs int, best_loss double")


def save_autoencoder(spark: SparkSession, model: Autoencoder, path: str) -> str:
    """Widths and weights as a one-row table; its size depends on the widths alone."""
    row = [(model.widths, model.code, model.weights.tolist(), list(model.losses))]
    spark.createDataFrame(row, "widths array<int>, code int, weights array<double>, losses array<double>").write.parquet(path)
    return path


def load_autoencoder(spark: SparkSession, path: str) -> Autoencoder:
    r = spark.read.parquet(path).first()
    return Autoencoder(list(r["widths"]), r["code"], np.array(r["weights"]), tuple(r["losses"]))


def pca_distance(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``error``: how far a row lies from the mean, each direction measured by its own spread.

    Inside the kept components that is the sum of squared scores over their variances; what the
    components leave counts by its mean square over all rows. A row can stand out in either part.
    """
    scored = pca_error(df, model, keep="components")
    width = model.stages[-1].getOrDefault("k")
    code = vector_to_array(column("components"))
    sums = scored.agg(*[F.avg(F.pow(code[i], F.lit(2))).alias(f"v{i}") for i in range(width)], F.avg("error").alias("left")).first()
    inside = sum((code[i] * code[i] / F.lit(sums[f"v{i}"]) for i in range(width) if sums[f"v{i}"]), F.lit(0.0))
    left = F.col("error") / F.lit(sums["left"]) if sums["left"] and sums["left"] > 1e-12 else F.lit(0.0)
    return scored.withColumn("error", inside + left).drop("components")


def pca_error(df: DataFrame, model: PipelineModel, keep: str | None = None) -> DataFrame:
    """Adds ``error`` of a fitted ``fit_pca`` pipeline: what the components leave of the row.

    The components are orthonormal, so that is the row's squared length less the code's.
    """
    scored = model.transform(df)

    def squares(vector: str):
        return F.aggregate(vector_to_array(column(vector)), F.lit(0.0), lambda acc, v: acc + v * v)

    left = F.greatest(squares("centred") - squares("components"), F.lit(0.0))
    error = left / F.size(vector_to_array("centred"))
    return scored.withColumn("error", error).drop(*[c for c in ("features", "centred", "components") if c != keep])
