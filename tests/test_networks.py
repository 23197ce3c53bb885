import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from flowlens.functions.descent import gradient_descent, lbfgs
from flowlens.plans import networks
from flowlens.plans.autoencoder import layers_of
from flowlens.runtime import laid_out, layout_partitions


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(4).standard_normal((6000, 3))
    code = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 1] > 1.0)
    data = [(i, float(c), *map(float, r)) for i, (c, r) in enumerate(zip(code, x))]
    return spark.createDataFrame(data, "id bigint, code double, a double, `b c` double, d double").repartition(3)


NAMES = ["a", "b c", "d"]


def test_gradient_of_a_block_equals_finite_differences():
    widths, rng = [3, 5, 4, 2], np.random.default_rng(2)
    size = sum(a * b + b for a, b in zip(widths, widths[1:]))
    w, x, code = rng.standard_normal(size), rng.standard_normal((300, 3)), rng.integers(0, 2, 300).astype(float)

    def loss(at, grad):
        return networks.Passes(layers_of(widths, at), layers_of(widths, grad)).block(x, code)

    grad = np.zeros(size)
    loss(w, grad)
    for i in range(size):
        step = np.zeros(size)
        step[i] = 1e-6
        assert (loss(w + step, np.zeros(size)) - loss(w - step, np.zeros(size))) / 2e-6 == pytest.approx(grad[i], abs=1e-7)


@pytest.mark.parametrize("solver", ["l-bfgs", "gd"])
def test_network_is_the_one_the_library_fits(rows, solver):
    train, valid = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    training = networks.Training(rounds=2, iterations=6, block=100, solver=solver, step=0.5)
    network = networks.fit_network(train, valid, NAMES, "code", 3, [6, 5], training)
    prepare, own = network.model.stages[:-1], network.model.stages[-1]
    held = train
    for stage in prepare:
        held = stage.transform(held)
    held = laid_out(held.select("features", "code"))
    learner = MultilayerPerceptronClassifier(
        layers=[3, 6, 5, 3], labelCol="code", maxIter=6, seed=1, blockSize=100, tol=1e-5, solver=solver, stepSize=0.5
    )
    first = learner.fit(held)
    second = learner.setInitialWeights(first.weights).fit(held)
    assert network.best_round == 1
    assert own.weights.toArray() == pytest.approx(second.weights.toArray(), rel=1e-6, abs=1e-8)


def test_library_sees_no_training_rows(rows, monkeypatch):
    seen, fit = [], MultilayerPerceptronClassifier.fit

    def counted(self, df, *more):
        seen.append(df.count())
        return fit(self, df, *more)

    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", counted)
    networks.fit_network(rows, rows, NAMES, "code", 3, [4], networks.Training(rounds=2, iterations=3))
    assert set(seen) == {1}


@pytest.mark.parametrize("bad", [None, 3.0, 0.5, -1.0])
def test_codes_that_are_no_class_raise(rows, bad):
    coded = rows.withColumn("code", F.when(F.col("id") == 17, F.lit(bad).cast("double")).otherwise(F.col("code")))
    with pytest.raises(Exception, match="not one of 0 to 2"):
        networks.fit_network(coded, rows, NAMES, "code", 3, [4], networks.Training(rounds=1, iterations=1))


def test_tasks_follow_the_rows():
    assert networks.tasks_of(0) == 1 and networks.tasks_of(5_000) == 2
    assert networks.tasks_of(600_000) == networks.tasks_of(12_000_000) == 48
    assert networks.tasks_of(28_800_000) == 116
    assert all(networks.tasks_of(n) <= layout_partitions(n) for n in (1, 10_000, 10**6, 10**8, 10**9))


def test_minimisers_reach_the_least_place():
    scale = np.array([1.0, 10.0, 100.0])

    def bowl(x):
        return float((scale * (x - 2.0) ** 2).sum()) / 2 + 1.0, scale * (x - 2.0)

    assert lbfgs(bowl, np.zeros(3), 50, 1e-9) == pytest.approx([2.0] * 3, abs=1e-4)
    assert gradient_descent(bowl, np.zeros(3), 3000, 1e-9, 0.015) == pytest.approx([2.0] * 3, abs=1e-4)
    assert (lbfgs(bowl, np.full(3, 2.0), 5, 1e-9) == 2.0).all()


def test_sweep_holds_its_tables_once(rows, monkeypatch):
    calls, hold = [], networks.hold_tables
    monkeypatch.setattr(networks, "hold_tables", lambda *args: calls.append(args[-1]) or hold(*args))
    short = networks.Training(rounds=2, iterations=3)
    other = networks.Training(rounds=2, iterations=3, block=64)
    candidates = {"a": ([4], short), "b": ([3], other), "c": ([5, 4], short)}
    found = networks.sweep_networks(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), NAMES, "code", 3, candidates).collect()
    assert calls == [1024, 64]
    assert [(r["name"], r["widths"]) for r in found] == [("a", "4"), ("b", "3"), ("c", "5-4")]
    for r in found:
        widths, training = candidates[r["name"]]
        alone = networks.fit_network(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), NAMES, "code", 3, widths, training)
        assert (r["rounds"], r["best_loss"]) == (len(alone.losses), pytest.approx(alone.best_loss, rel=1e-9))


def test_measures_are_those_of_a_network_trained_as_planned(spark, sf_dir, monkeypatch):
    """The query trains at the settings of the plan, not at a few steps of it."""
    from flowlens.catalog import model_queries

    seen = []

    def fitted(train, valid, features, code, classes, widths=None, training=networks.Training()):
        seen.append((widths, training))
        raise InterruptedError

    monkeypatch.setattr(networks, "fit_network", fitted)
    with pytest.raises(InterruptedError):
        model_queries.network_measures(spark, sf_dir)
    assert seen == [(None, networks.Training(rounds=50, iterations=20, patience=20))]
