"""Models learn what can be learnt, survive a save, and undo the known faults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.catalog.views import flows, wide
from flowlens.operators import evaluation
from flowlens.operators.cleaning import clean_flows
from flowlens.operators.features import eliminate, extra_tree_importance, fit_pca, pca_summary, tree_importance
from flowlens.operators.sampling import stratified_split
from flowlens.plans import autoencoder as ae
from flowlens.plans import forests, networks
from flowlens.runtime import laid_out, layout_partitions, scratch_path
from flowlens.sources.models import load_model, save_model

TINY = forests.ForestSize(trees=5, depth=5)


@pytest.fixture(scope="module")
def clean(spark, sf_dir):
    return clean_flows(flows(spark, sf_dir), ["f_dirty"]).persist()


def test_forest_finds_what_the_label_depends_on_and_nothing_in_noise(clean):
    good = forests.fit_attack(clean, "DoS Hulk", ["f_value"], TINY)
    assert evaluation.auc_of(good.model.transform(good.test)) > 0.95 and good.seconds > 0
    noise = forests.fit_attack(clean, "DoS Hulk", ["f_k"], TINY)
    assert abs(evaluation.auc_of(noise.model.transform(noise.test)) - 0.5) < 0.2


def test_fit_attack_uses_its_own_features_and_counts_benign_as_rest(clean):
    fitted = forests.fit_attack(clean, "PortScan", ["f_value", "f_k"], TINY)
    assert fitted.model.stages[0].getInputCols() == ["f_value", "f_k"]
    positive = fitted.test.where("flag = 1")
    assert 0 < positive.count() < 24 and positive.where("f_value < 100").count() == 0


def test_saved_model_predicts_the_same(spark, clean):
    fitted = forests.fit_benign(clean, "flow_id", ["f_value", "f_k"], TINY)
    again = load_model(save_model(fitted.model, scratch_path(spark, "model")))
    pick = ["flow_id", "prediction"]
    assert fitted.model.transform(clean).select(pick).exceptAll(again.transform(clean).select(pick)).count() == 0


def test_thinned_model_is_tested_on_thinned_rows(clean):
    fitted = forests.fit_benign_thinned(clean, "flow_id", ["f_value"], TINY)
    n, benign = fitted.test.agg(F.count(F.lit(1)), F.sum("flag")).first()
    assert 0 < benign < 0.9 * n


def test_weighted_ensemble_and_one_hot_regression(clean):
    attacks = clean.where("label in ('DoS Hulk', 'PortScan')")
    parts = stratified_split(attacks, "flow_id", {"train": 0.7, "test": 0.3}, 1)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    models = forests.fit_weighted_attacks(train, {"DoS Hulk": ["f_value"], "PortScan": ["f_value", "f_k"]}, TINY)
    scored = forests.positive_probability(test, models)
    assert scored.columns == [*test.columns, "DoS Hulk", "PortScan"] and scored.count() == test.count()
    hot = forests.score_one_hot(test, forests.fit_one_hot(train, ["f_value"], ["DoS Hulk", "PortScan"], TINY))
    assert evaluation.accuracy(hot).first()["accuracy"] > 0.9


def test_synthetic_rows_only_in_training(clean):
    parts = stratified_split(clean.where("label <> 'BENIGN'"), "flow_id", {"train": 0.8, "test": 0.2}, 1)
    classes = forests.attack_classes(parts)
    model = forests.fit_smote_regression(parts.where("split = 'train'"), "flow_id", ["f_value", "f_k"], classes, TINY)
    scored = forests.nearest_class(model.transform(parts.where("split = 'test'")))
    assert scored.count() == parts.where("split = 'test'").count()


def test_network_stops_early_and_beats_the_majority(clean):
    coded = clean.withColumn("code", (F.col("label") == "BENIGN").cast("double"))
    parts = stratified_split(coded, "flow_id", {"train": 0.6, "valid": 0.2, "test": 0.2}, 1)
    training = networks.Training(rounds=30, iterations=10, patience=2)
    network = networks.fit_network(
        parts.where("split = 'train'"), parts.where("split = 'valid'"), ["f_value", "f_k"], "code", 2, [5], training
    )
    assert len(network.losses) < 30 and network.losses[network.best_round] == min(network.losses)
    scored = network.model.transform(parts.where("split = 'test'"))
    majority = scored.where("code = 1").count() / scored.count()
    assert evaluation.accuracy(scored, "code").first()["accuracy"] > majority + 0.05


def test_rows_are_repeated_by_weight(spark):
    df = spark.range(2000).select(F.col("id").alias("flow_id"), (F.col("id") % 2).cast("int").alias("code"))
    out = networks.repeat_by_weight(df, "flow_id", "code", {0: 1.0, 1: 2.5}, 1)
    counts = {r["code"]: r["count"] for r in out.groupBy("code").count().collect()}
    assert counts[0] == 1000 and 2400 < counts[1] < 2600


def test_gradient_equals_finite_differences():
    model = ae.new_autoencoder(4, [3], 2, seed=3)
    x = np.random.default_rng(1).uniform(0.1, 1, (7, 4))

    def loss(w):
        seen = ae.activations(ae.layers_of(model.widths, w), x, len(model.widths) - 2)
        return ((seen[-1] - x) ** 2).mean() + 0.01 * np.abs(seen[1]).sum() / len(x)

    g = ae.gradient(model.widths, model.weights, x, 0.01, leak=0.0)
    for i in range(0, len(g), 3):
        step = np.zeros_like(g)
        step[i] = 1e-6
        assert abs((loss(model.weights + step) - loss(model.weights - step)) / 2e-6 - g[i]) < 1e-6


def test_autoencoder_learns_codes_and_round_trips(spark, clean):
    names = ["f_value", "f_k", "f_dirty"]
    rows = ae.scaled_rows(ae.scale_rows(clean, names), clean).select("flow_id", "x")
    start = ae.new_autoencoder(3, [3], 2, seed=2)
    before = ae.with_error(rows, start).agg(F.avg("error")).first()[0]
    model = ae.fit_autoencoder(rows, rows, start, ae.Training(epochs=15, rate=0.01, batch=20))
    assert min(model.losses) < before / 2
    again = ae.load_autoencoder(spark, ae.save_autoencoder(spark, model, scratch_path(spark, "auto")))
    a, b = (ae.with_error(rows, m).agg(F.sum("error")).first()[0] for m in (model, again))
    assert a == b
    codes = ae.with_code(rows, model)
    assert codes.where("size(code) <> 2").count() == 0


def test_autoencoder_does_not_depend_on_the_partitions(spark, clean):
    names = ["f_value", "f_k", "f_dirty"]
    rows = ae.scaled_rows(ae.scale_rows(clean, names), clean).select("flow_id", "x")
    start = ae.new_autoencoder(3, [4], 2, seed=2)
    fitted = [ae.fit_autoencoder(rows.repartition(n), rows, start, ae.Training(epochs=2, rate=0.01, batch=20)) for n in (1, 4, 16)]
    assert all(np.array_equal(fitted[0].weights, m.weights) for m in fitted)


def test_network_keeps_every_lower_loss(clean, monkeypatch):
    coded = clean.withColumn("code", (F.col("label") == "BENIGN").cast("double"))
    losses = iter([0.5, 0.49995, 0.49999, 0.49998])
    monkeypatch.setattr(networks.MulticlassClassificationEvaluator, "evaluate", lambda self, df: next(losses))
    training = networks.Training(rounds=10, iterations=1, patience=3, min_delta=1e-3)
    network = networks.fit_network(coded, coded, ["f_value", "f_k"], "code", 2, [3], training)
    assert network.losses == [0.5, 0.49995, 0.49999, 0.49998]
    assert network.best_round == 1 and network.best_loss == 0.49995


def test_pca_equals_the_covariance_eigenvectors(clean):
    names = ["f_value", "f_k", "f_dirty"]
    data = np.array([[r[n] for n in names] for r in clean.collect()])
    values, vectors = np.linalg.eigh(np.cov(data.T))
    got = pca_summary(clean, names, 3).collect()
    ratios = sorted({r["explained"] for r in got}, reverse=True)
    assert np.allclose(ratios, (values / values.sum())[::-1])
    first = np.array([r["loading"] for r in got if r["component"] == 0])
    assert np.isclose(abs(first @ vectors[:, -1]), 1)
    scored = ae.pca_error(clean, fit_pca(clean, names, 1))
    centred = data - data.mean(axis=0)
    left = ((centred - np.outer(centred @ vectors[:, -1], vectors[:, -1])) ** 2).mean(axis=1)
    assert np.isclose(scored.agg(F.sum("error")).first()[0], left.sum())


def test_importance_and_elimination_prefer_the_informative_feature(clean):
    coded = clean.withColumn("code", (F.col("label") == "BENIGN").cast("double"))
    scores = {r["feature"]: r["score"] for r in tree_importance(coded, ["f_value", "f_k", "f_dirty"], "code").collect()}
    assert max(scores, key=scores.get) == "f_value"
    rows = {r["feature"]: r["rank"] for r in eliminate(coded, ["f_value", "f_k", "f_dirty"], "code", keep=1).collect()}
    assert rows["f_value"] == 1 and sorted(rows.values()) == [1, 2, 3]


def test_groups_follow_the_rows():
    training = ae.Training(rows_per_group=100)
    assert ae.groups_of(0, training) == (1, 1)
    assert ae.groups_of(101, training) == (2, 2)
    assert ae.groups_of(10**6, training) == (10_000, 4096)
    assert ae.groups_of(10**9, training) == (10**7, 156_250)


def test_tasks_of_an_epoch_hold_several_groups_of_a_large_table():
    training = ae.Training()
    assert [ae.tasks_of(n, training) for n in (0, 8_193, 192 * 8_192, 360_000 * 60)] == [1, 2, 192, 192]
    assert ae.tasks_of(10**9, training) == 3_815
    assert ae.tasks_of(10**6, training) == ae.groups_of(10**6, training)[1]


def test_many_groups_of_equal_rows_learn_alike(spark, clean):
    """Sums over more tasks than one step adds up; a key deals equal rows out; the layout does not matter."""
    names = ["f_value", "f_k", "f_dirty"]
    rows = ae.scaled_rows(ae.scale_rows(clean, names), clean).select("flow_id", "x")
    half = rows.withColumn("x", F.when(F.col("flow_id") % 2 == 0, F.array(*[F.lit(0.5)] * 3)).otherwise(F.col("x")))
    training = ae.Training(epochs=6, rate=0.01, batch=2, rows_per_group=4)
    assert ae.groups_of(half.count(), training)[1] > 2 * ae._FAN_IN
    start = ae.new_autoencoder(3, [4], 2, seed=2)
    fitted = [ae.fit_autoencoder(half.repartition(n), half, start, training, "flow_id") for n in (2, 9)]
    assert np.array_equal(fitted[0].weights, fitted[1].weights) and len(fitted[0].losses) == 6
    assert fitted[0].losses[-1] < ae.with_error(half, start).agg(F.avg("error")).first()[0] / 2


def test_state_of_the_optimiser_is_carried_on(spark, clean):
    """One group, two epochs of one batch each, against the same steps taken here."""
    names = ["f_value", "f_k", "f_dirty"]
    rows = ae.scaled_rows(ae.scale_rows(clean, names), clean).select("flow_id", "x")
    start, training = ae.new_autoencoder(3, [4], 2, seed=2), ae.Training(epochs=2, rate=0.01, batch=10**6, optimiser="adam")
    fitted = ae.fit_autoencoder(rows, rows, start, training, "flow_id")
    x = np.array([r["x"] for r in rows.collect()])
    state = np.concatenate([start.weights, np.zeros(2 * len(start.weights) + 1)])
    losses = []
    for _ in range(2):
        steps = ae._Steps(start.widths, state, training)
        steps.take(x)
        state = steps.result()
        seen = ae.activations(ae.layers_of(start.widths, state[: len(start.weights)]), x, 3)
        losses.append(((seen[-1] - x) ** 2).mean())
    assert fitted.losses == pytest.approx(losses, rel=1e-9)


def test_one_scan_feeds_all_attacks(spark, sf_dir):
    from test_plans import plan

    from flowlens.fixed_values import ATTACK_FEATURES

    text = plan(forests.attack_rows(wide(spark, sf_dir), ATTACK_FEATURES))
    assert text.split("(1)")[0].count("Scan parquet") == 1 and text.split("(1)")[0].count("Exchange") == 1


def test_rows_of_an_attack_are_distinct_and_keep_their_split(spark):
    rows = [("1.5", "x", "a"), ("1.5", "x", "a"), ("1.5", "x", "b"), (None, "2", "a"), ("Infinity", "2", "b"), ("1.5", "x", None)]
    df = spark.createDataFrame(rows * 3, "u string, v string, label string")
    got = forests.attack_rows(df, {"a": ["u", "v"], "b": ["v"]}).collect()
    assert sorted((r["attack"], tuple(r["v"]), r["flag"]) for r in got) == [
        ("a", (0.0, 2.0), 0), ("a", (0.0, 2.0), 1), ("a", (1.5, 0.0), 0), ("a", (1.5, 0.0), 1),
        ("b", (0.0,), 0), ("b", (0.0,), 1), ("b", (2.0,), 0), ("b", (2.0,), 1),
    ]


def test_layout_follows_the_rows(spark):
    assert [layout_partitions(n) for n in (0, 1, 2_500, 2_501, 500_000, 10**8, 10**11)] == [1, 1, 1, 2, 200, 200, 100_000]
    same = spark.range(7_500).select("id", F.lit(1.0).alias("x"))
    held = laid_out(same, ["id"])
    sizes = held.groupBy(F.spark_partition_id()).count().collect()
    assert held.columns == ["x"] and len(sizes) == 3 and max(r["count"] for r in sizes) < 3_000


def test_extra_trees_rank_planted_features_first_and_differ_from_the_forest(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((1500, 6))
    code = (x[:, 1] + 0.7 * x[:, 4] > 0).astype(int) + (x[:, 1] > 1.2)
    names = [f"c {j}" for j in range(6)]
    df = spark.createDataFrame([(float(c), *map(float, row)) for c, row in zip(code, x)], ["code", *names])
    score = {s["feature"]: s["score"] for s in extra_tree_importance(df, names, "code", trees=8).collect()}
    assert sorted(score, key=score.get)[-2:] == ["c 4", "c 1"] and sum(score.values()) == pytest.approx(1)
    plain = {s["feature"]: s["score"] for s in tree_importance(df, names, "code", trees=8).collect()}
    assert max(abs(score[n] - plain[n]) for n in names) > 0.01
    again = {s["feature"]: s["score"] for s in extra_tree_importance(df, names, "code", trees=8).collect()}
    assert again == score
    with pytest.raises(ValueError, match="no rows"):
        extra_tree_importance(df.limit(0), names, "code")


def test_measures_of_a_network_on_other_rows(clean):
    coded = clean.withColumn("code", (F.col("label") == "BENIGN").cast("double"))
    train, test = coded.where("flow_id % 3 > 0"), coded.where("flow_id % 3 = 0")
    network = networks.fit_network(train, train, ["f_value", "f_k"], "code", 2, [4], networks.Training(rounds=2, iterations=20))
    found = networks.network_measures(network, test, "code", 2).first()
    rows = network.model.transform(test).select("code", "prediction", "probability").collect()
    assert found["n"] == len(rows)
    assert found["accuracy"] == pytest.approx(np.mean([r["code"] == r["prediction"] for r in rows]))
    assert found["loss"] == pytest.approx(np.mean([-np.log(max(r["probability"][int(r["code"])], 1e-15)) for r in rows]))
    pos, neg = ([r["probability"][1] for r in rows if r["code"] == c] for c in (1, 0))
    assert found["auc"] == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
    assert found["accuracy"] > 0.9 and found["auc"] > 0.95
    scored = network.model.transform(test)
    assert networks.round_scores(scored, "code", 2)["auc"] == pytest.approx(found["auc"])
