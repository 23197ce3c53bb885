"""Feed-forward networks with early stopping on a validation table.

Hidden layers are sigmoid, the output is softmax and the optimiser is L-BFGS, which is what the
library's network offers; there is no dropout. Features are standardised inside the pipeline.

The result is the library's model. Its start and its scores come from the library; value and gradient of the
loss come from one Spark job over all training rows for each step, which takes blocks of rows through the layers as
matrices (numpy inside tasks). Tasks send one array of the size of the weights, which are added up 64 at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.fixed_values import CLASSIFIER_WIDTHS
from flowlens.functions.descent import Objective, gradient_descent, lbfgs
from flowlens.functions.draws import uniform
from flowlens.functions.labels import round_probability
from flowlens.operators.curves import auc_roc, average_precision, cells
from flowlens.operators.evaluation import micro
from flowlens.operators.features import assembler
from flowlens.plans.autoencoder import added_up, layers_of
from flowlens.runtime import column, laid_out, layout_partitions, materialise


@dataclass(frozen=True)
class Training:
    """Rounds of a few iterations each, stopped when the validation loss no longer falls."""

    rounds: int = 50
    iterations: int = 20
    patience: int = 20
    min_delta: float = 1e-4
    tolerance: float = 1e-5
    solver: str = "l-bfgs"
    step: float = 0.03  # learning rate of solver "gd"
    seed: int = 1
    block: int = 1024


@dataclass(frozen=True)
class Network:
    """A trained network: the weights of ``best_round``, whose validation loss is the lowest."""

    model: PipelineModel
    losses: list[float]
    best_round: int

    @property
    def best_loss(self) -> float:
        return self.losses[self.best_round]


def repeat_by_weight(df: DataFrame, key: str, code: str, weights: dict[int, float], seed: int) -> DataFrame:
    """Each row about ``weight`` times: the whole part always, one more with the rest's chance.

    Stands in for class weights, which the network does not take. Weights are at least 1, so
    no row is lost.
    """
    weight = F.lit(1.0)
    for value, w in weights.items():
        weight = F.when(column(code) == value, F.lit(float(w))).otherwise(weight)
    whole = F.floor(weight)
    times = (whole + (uniform(f"{seed}-repeat", column(key)) < weight - whole).cast("int")).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def _blocks(classes: int, block: int):
    """``code, x``: the rows of a partition in blocks of ``block``, as the bytes of two arrays that every pass reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(code: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([code.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["code", "x"])

        codes, rows = np.zeros(0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(code), -1)
            if not (np.isin(code, np.arange(classes)).all() and np.isfinite(x).all()):
                raise ValueError(f"a class code that is not one of 0 to {classes - 1}, or a feature that is not finite")
            codes, rows = np.concatenate([codes, code]), x if rows is None else np.concatenate([rows, x])
            whole = len(codes) // block * block
            for at in range(0, whole, block):
                yield packed(codes[at : at + block], rows[at : at + block])
            codes, rows = codes[whole:], rows[whole:]
        if len(codes):
            yield packed(codes, rows)

    return work


#: Tasks of a pass over the training rows up to so many rows each, beyond it as many as hold so many.
_TASKS, _ROWS_OF_TASK = 48, 250_000
#: Rows that go through the layers at once, so that what they are at every layer stays near the processor.
_ROWS_AT_ONCE = 256


class Passes:
    """Takes blocks through the layers and adds up their gradients in ``into``, arrays like ``layers``."""

    def __init__(self, layers: list, into: list):
        self.layers, self.into = layers, into
        wide = [len(b) for _, b in layers]
        self.seen = [np.empty((_ROWS_AT_ONCE, n)) for n in wide]
        self.back = [np.empty((_ROWS_AT_ONCE, n)) for n in wide]
        self.ones = np.ones(_ROWS_AT_ONCE)

    def block(self, x: np.ndarray, code: np.ndarray) -> float:
        """Mean cross entropy of a block; the gradient of that mean is added."""
        parts = [slice(at, at + _ROWS_AT_ONCE) for at in range(0, len(x), _ROWS_AT_ONCE)]
        return sum(self._rows(x[p], code[p], 1.0 / len(x)) for p in parts)

    def _rows(self, x: np.ndarray, code: np.ndarray, share: float) -> float:
        n, last = len(x), len(self.layers) - 1
        seen, ones = [x, *(out[:n] for out in self.seen)], self.ones[:n]
        with np.errstate(over="ignore"):
            for i, (w, b) in enumerate(self.layers):
                out = np.matmul(seen[i], w, out=seen[i + 1])
                out += b
                if i < last:
                    np.negative(out, out=out)
                    np.exp(out, out=out)
                    out += 1.0
                    np.reciprocal(out, out=out)
        out, own = seen[-1], (np.arange(n), code.astype(np.int64))
        out -= out.max(axis=1, keepdims=True)
        back = np.exp(out, out=self.back[-1][:n])
        sums = back.sum(axis=1, keepdims=True)
        loss = float(np.log(sums).sum() - out[own].sum())
        back /= sums
        back[own] -= 1.0
        back *= share
        for i in range(last, -1, -1):
            self.into[i][0][:] += seen[i].T @ back
            self.into[i][1][:] += ones @ back
            if i:
                back, units = np.matmul(back, self.layers[i][0].T, out=self.back[i - 1][:n]), seen[i]
                back *= units
                np.subtract(1.0, units, out=units)
                back *= units
        return loss * share


def _pass(layers: list[int], weights: np.ndarray):
    """One row per task: the gradient summed over its blocks, their losses and their number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, loss, blocks = np.zeros_like(weights), 0.0, 0
        passes = Passes(layers_of(layers, weights), layers_of(layers, grad))
        for batch in batches:
            for code, x in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, layers[0])
                loss, blocks = loss + passes.block(x, np.frombuffer(code.as_buffer(), dtype=np.float64)), blocks + 1
        sums = np.concatenate([grad, [loss, blocks]])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["slot", "sums"])

    return work


def tasks_of(rows: int) -> int:
    """Tasks of a pass over so many rows. Starting a task and adding up what it sends take as long as many blocks, so a few
    hold the partitions of smaller tables; a task of larger ones holds 250,000 rows."""
    return min(layout_partitions(rows), max(_TASKS, -(-rows // _ROWS_OF_TASK)))


def _objective(held: DataFrame, tasks: int, layers: list[int]) -> Objective:
    """The mean over all blocks of their losses, as the library weighs rows, and its gradient."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sums = added_up(held.mapInArrow(_pass(layers, weights), "slot bigint, sums binary"), tasks)
        return float(sums[-2] / sums[-1]), sums[:-2] / sums[-1]

    return at


@dataclass(frozen=True)
class Held:
    """Both tables as networks of any widths read them, and the pipeline that prepared them."""

    prepare: PipelineModel
    train: DataFrame
    valid: DataFrame
    tasks: int


@contextmanager
def hold_tables(train: DataFrame, valid: DataFrame, features: list[str], code: str, classes: int, block: int) -> Iterator[Held]:
    """Standardised rows laid out once and held while any number of networks is fitted to them."""
    prepare = Pipeline(
        stages=[
            assembler(features, "raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        ]
    ).fit(train)
    coded = [prepare.transform(t).select("features", column(code).cast("double").alias(code)) for t in (train, valid)]
    rows = coded[0].count()
    tasks = tasks_of(rows)
    laid = laid_out(coded[0], None, layout_partitions(rows)).select(column(code), vector_to_array("features").alias("x"))
    held = [laid.mapInArrow(_blocks(classes, block), "code binary, x binary").coalesce(tasks), laid_out(coded[1])]
    held = [t.persist(StorageLevel.MEMORY_AND_DISK) for t in held]
    try:
        yield Held(prepare, *held, tasks)
    finally:
        for t in held:
            t.unpersist()


def fit_network(
    train: DataFrame,
    valid: DataFrame,
    features: list[str],
    code: str,
    classes: int,
    widths: list[int] | None = None,
    training: Training = Training(),
    after_round: Callable[[int, DataFrame], None] | None = None,
) -> Network:
    """A network on named columns; the weights of the best validation round are kept.

    Every lower loss is kept. ``min_delta`` only tells when training no longer gets on: it stops after
    ``patience`` rounds that have not improved by that much.

    Each round starts from the weights the round before ended with. Both tables are held for
    the whole of the training. ``after_round`` gets the round and the scored validation rows.
    """
    with hold_tables(train, valid, features, code, classes, training.block) as held:
        return fit_held_network(held, features, code, classes, widths, training, after_round)


def fit_held_network(
    held: Held, features: list[str], code: str, classes: int, widths: list[int] | None = None, training: Training = Training(),
    after_round: Callable[[int, DataFrame], None] | None = None,
) -> Network:
    """``fit_network`` on tables that are held already, in blocks of ``training.block``."""
    layers = [len(features), *(widths if widths is not None else CLASSIFIER_WIDTHS), classes]
    objective = _objective(held.train, held.tasks, layers)
    # a fit of no steps is the library's model at its start or at given weights; it looks at no more than that it has a row
    shell = MultilayerPerceptronClassifier(layers=layers, labelCol=code, featuresCol="features", maxIter=0, seed=training.seed)
    one = held.valid.sparkSession.createDataFrame([(DenseVector([0.0] * len(features)), 0.0)], held.valid.schema)
    weights = shell.fit(one).weights.toArray()
    judge = MulticlassClassificationEvaluator(labelCol=code, metricName="logLoss")
    best, best_round, reference, losses, stale = None, 0, float("inf"), [], 0
    for number in range(training.rounds):
        if training.solver == "gd":
            weights = gradient_descent(objective, weights, training.iterations, training.tolerance, training.step)
        else:
            weights = lbfgs(objective, weights, training.iterations, training.tolerance)
        model = shell.copy({shell.initialWeights: DenseVector(weights)}).fit(one)
        scored = model.transform(held.valid)
        losses.append(judge.evaluate(scored))
        if after_round is not None:
            after_round(number, scored)
        if best is None or losses[-1] < losses[best_round]:
            best, best_round = model, number
        if losses[-1] < reference - training.min_delta:
            reference, stale = losses[-1], 0
        else:
            stale += 1
            if stale >= training.patience:
                break
    return Network(PipelineModel([*held.prepare.stages, best]), losses, best_round)


def round_scores(scored: DataFrame, code: str, classes: int) -> dict[str, float]:
    """Micro precision, recall, F1 and average precision over the rounded outputs of all classes."""
    outputs = vector_to_array(F.col("probability"))
    hot = scored.select(
        *[(column(code) == c).cast("int").alias(f"t{c}") for c in range(classes)],
        *[round_probability(outputs[c]).alias(f"p{c}") for c in range(classes)],
    )
    truths, rounded = ([f"{side}{c}" for c in range(classes)] for side in "tp")
    found = micro(hot, truths, rounded).first().asDict()
    found["average_precision"] = average_precision(cells(hot, truths, rounded), "flag", "score").first()[0]
    return {**found, "auc": _binary_auc(scored, code)} if classes == 2 else found


def _binary_auc(scored: DataFrame, code: str) -> float:
    flagged = scored.select(column(code).cast("int").alias("flag"), vector_to_array(F.col("probability"))[1].alias("score"))
    return auc_roc(flagged, "flag", "score").first()[0]


def network_measures(network: Network, test: DataFrame, code: str, classes: int) -> DataFrame:
    """``n, loss, accuracy, auc`` on rows that the network has not seen; the ROC area for two classes only."""
    scored = materialise(network.model.transform(test).select(column(code).cast("double").alias(code), "prediction", "probability"), "scored")
    p = F.get(vector_to_array(F.col("probability")), column(code).cast("int"))
    auc = _binary_auc(scored, code) if classes == 2 else None
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("loss"),
        F.avg((column(code) == F.col("prediction")).cast("double")).alias("accuracy"),
        F.lit(auc).cast("double").alias("auc"),
    )


def sweep_networks(
    train: DataFrame, valid: DataFrame, features: list[str], code: str, classes: int,
    candidates: dict[str, tuple[list[int], Training]],
) -> DataFrame:
    """``name, widths, rounds, best_loss`` for several layer widths and settings over the same tables, held once for each block size."""
    found = {}
    for block in dict.fromkeys(training.block for _, training in candidates.values()):
        with hold_tables(train, valid, features, code, classes, block) as held:
            for name, (widths, training) in candidates.items():
                if training.block == block:
                    found[name] = fit_held_network(held, features, code, classes, widths, training)
    rows = [(n, "-".join(map(str, w)), len(found[n].losses), float(found[n].best_loss)) for n, (w, _) in candidates.items()]
    return train.sparkSession.createDataFrame(rows, "name string, widths string, rounds int, best_loss double")
