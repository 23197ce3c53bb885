"""Hand-made inputs and properties of the exact operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import draws, labels
from flowlens.operators import align, cleaning, curves, ensemble, evaluation, features, profile, reconstruction, sampling
from golden import SCORES, SELECTED_AT_HALF, TOTAL_14, TOTAL_15, WEIGHTS_14, WEIGHTS_15


# Cleaning -----------------------------------------------------------------------------------


def test_cast_never_fails_and_fill_covers_every_gap(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("-Infinity",)], "v string")
    cast = cleaning.cast_numeric(df, ["v"])
    assert cast.where("v is null").count() == 2
    assert sorted(r["v"] for r in cleaning.fill_missing(cast).collect()) == [0.0, 0.0, 0.0, 0.0, 1.5]
    kept = cleaning.fill_missing(cast, infinite_is_missing=False)
    assert kept.where(F.col("v") == float("-inf")).count() == 1


def test_null_label_never_becomes_a_class(spark):
    df = spark.createDataFrame([(1, None), (2, "BENIGN"), (3, "Bot"), (4, " Label")], "flow_id int, label string")
    kept = cleaning.clean_flows(df, [])
    assert {r["flow_id"] for r in kept.collect()} == {2, 3}
    assert df.select(labels.benign_flag(F.col("label"))).first()[0] is None


def test_features_stay_in_table_order(spark):
    df = spark.createDataFrame([(1, 2, 3, "x")], "c int, a int, b int, label string")
    assert cleaning.project_features(df, ["b", "c", "b"], "label").columns == ["c", "b", "label"]


# Labels -------------------------------------------------------------------------------------


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in df.select(labels.round_to_class(F.col("v"))).collect()] == [0, 2, 2]
    assert df.select(labels.round_probability(F.lit(0.5))).first()[0] == 0


def test_benign_is_always_rest(spark):
    df = spark.createDataFrame([("BENIGN",), ("PortScan",), ("Bot",)], "label string")
    assert [r[0] for r in df.select(labels.one_vs_rest(F.col("label"), "PortScan")).collect()] == [0, 1, 0]


def test_decode_undoes_encode_and_one_hot_rows_sum_to_one(spark):
    df = spark.createDataFrame([(n,) for n in "bbacab"], "label string")
    for order, first in (("alphabetAsc", "a"), ("frequencyDesc", "b")):
        model = labels.fit_codes(df, "label", "code", order)
        assert model.labels[0] == first
        back = labels.decode(model.transform(df), "code", "name", model.labels)
        assert back.where("name <> label").count() == 0
    hot = labels.one_hot(df, "label")
    assert hot.columns[1:] == ["is_a", "is_b", "is_c"]
    assert hot.where("is_a + is_b + is_c <> 1").count() == 0


# Weights and scores -------------------------------------------------------------------------


@pytest.mark.parametrize("known,total,classes", [(WEIGHTS_14, TOTAL_14, 14), (WEIGHTS_15, TOTAL_15, 15)])
def test_class_weights_match_known_ones(spark, known, total, classes):
    others = [c for c in range(classes) if c not in known]
    rest = total - sum(n for n, _ in known.values())
    rows = [(c, n) for c, (n, _) in known.items()] + [(c, rest // len(others)) for c in others]
    rows[-1] = (rows[-1][0], rows[-1][1] + rest % len(others))
    got = {r["code"]: r["weight"] for r in profile.log_weights(spark.createDataFrame(rows, "code int, n bigint")).collect()}
    assert all(math.isclose(got[c], w, rel_tol=1e-9) for c, (_, w) in known.items())
    assert all(got[c] == 1.0 for c in others)


def test_known_scores_are_ranked_and_selected(spark):
    shuffled = random.Random(1).sample(list(SCORES.items()), len(SCORES))
    df = spark.createDataFrame(shuffled, "feature string, score double")
    ranked = [r["feature"] for r in features.rank_scores(df).collect()]
    assert ranked == [f for _, f in sorted(((s, f) for f, s in SCORES.items()), reverse=True)]
    assert features.above(df, 0.5).count() == SELECTED_AT_HALF
    wide = spark.createDataFrame([tuple(range(len(SCORES))) + ("x",)], [*SCORES, "label"])
    kept = features.keep_best(wide, df, 75, "label").columns
    assert kept == [c for c in SCORES if c in ranked[:75]] + ["label"]


def test_information_of_a_copy_is_the_entropy_and_of_noise_nothing(spark):
    rows = [(i % 4, i // 4 % 2, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "same int, other int, label int").withColumn("label", F.col("label").cast("string"))
    got = {r["feature"]: r["score"] for r in features.mutual_information(features.joint_counts(df, ["same", "other"])).collect()}
    assert math.isclose(got["same"], math.log(4)) and abs(got["other"]) < 1e-12


def test_bins_by_rank_do_not_see_a_monotone_change(spark):
    df = spark.range(3000).selectExpr("double(id % 1000) as x", "exp(double(id % 1000) / 20) as y", "string(id % 1000 < 300) as label")
    df = df.withColumn("z", F.when(F.col("x") < 10, float("nan")).otherwise(F.col("x")))
    joint = features.joint_counts(df, ["x", "y", "z"], by_rank=True)
    got = {r["feature"]: r["score"] for r in features.mutual_information(joint).collect()}
    assert math.isclose(got["x"], got["y"]) and got["x"] > 0.5
    assert joint.where("feature = 'z' and bin = -1").agg(F.sum("n")).first()[0] == 30
    flat = {r["feature"]: r["score"] for r in features.mutual_information(features.joint_counts(df, ["x", "y"])).collect()}
    assert flat["y"] < 0.3 < flat["x"]


# Splits -------------------------------------------------------------------------------------


def _labelled(spark, sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "flow_id bigint, label string")


def test_stratified_split_is_exact_in_every_class(spark):
    sizes = {"a": 5003, "b": 40, "c": 7, "d": 1}
    df = _labelled(spark, sizes).unionByName(spark.createDataFrame([(99_999, None)], "flow_id bigint, label string"))
    split = sampling.stratified_split(df, "flow_id", {"train": 0.8, "valid": 0.1, "test": 0.1}, seed=3)
    counts = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label, n in sizes.items():
        train, valid = math.floor(0.8 * n), math.floor(0.9 * n) - math.floor(0.8 * n)
        want = {"train": train, "valid": valid, "test": n - train - valid}
        assert {s: counts.get((label, s), 0) for s in want} == want
    assert split.count() == df.count()


def test_split_does_not_depend_on_partitions(spark):
    df = _labelled(spark, {"a": 500, "b": 100})
    one = sampling.stratified_split(df.coalesce(1), "flow_id", {"x": 0.5, "y": 0.5}, 1)
    many = sampling.stratified_split(df.repartition(7, "flow_id"), "flow_id", {"x": 0.5, "y": 0.5}, 1)
    assert one.exceptAll(many).count() == 0


def test_split_ranks_no_more_rows_at_once_than_allowed(spark, monkeypatch):
    label = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 5).cast("string"))
    df = spark.range(3000).select(F.col("id").alias("flow_id"), label.alias("label"))
    shares = {"train": 0.8, "valid": 0.1, "test": 0.1}
    want = sampling.stratified_split(df, "flow_id", shares, 3).select("flow_id", "split").collect()
    monkeypatch.setattr(sampling, "_PREFIX", 1)
    monkeypatch.setattr(sampling, "MOST_RANKED", 4)
    keyed = df.select(F.col("label").alias("class"), sampling.draw_key(3, F.col("flow_id")).alias("h"))
    edges, digits = sampling._edges(keyed, [F.floor(0.8 * F.col("n")), F.floor(0.9 * F.col("n"))])
    assert digits > 2
    held = sampling._within(keyed, edges, digits).groupBy("class", "i").count().collect()
    assert len(held) == 2 * 7 and max(r["count"] for r in held) <= 4
    got = sampling.stratified_split(df, "flow_id", shares, 3).select("flow_id", "split").collect()
    assert sorted(got) == sorted(want)


def test_split_with_repeated_keys_ends(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_RANKED", 4)
    df = spark.range(20).select(F.lit(1).alias("flow_id"), F.lit("a").alias("label"))
    assert sampling.stratified_split(df, "flow_id", {"x": 0.5, "y": 0.5}, 1).count() == 20


def test_thinning_and_splitting_with_one_seed_are_independent(spark):
    df = spark.range(20_000).select(F.col("id").alias("flow_id"), F.lit("BENIGN").alias("label"))
    thin = sampling.thin_benign(df, "flow_id", seed=5)
    share = thin.count() / 20_000
    assert abs(share - 471454 / 2647898) < 0.02
    parts = sampling.random_split(thin, ["flow_id"], {"train": 0.8, "test": 0.2}, seed=5)
    assert abs(parts.where("split = 'test'").count() / thin.count() - 0.2) < 0.03


def test_draw_bounds(spark):
    df = spark.range(10_000).select(draws.draw_key(1, F.col("id")).alias("k"), draws.uniform(1, F.col("id")).alias("u"))
    for f in (0.0, 0.25, 1.0):
        assert df.where(draws.drawn_below(F.col("k"), f) != (F.col("u") < f)).count() == 0


# Measures -----------------------------------------------------------------------------------


def test_perfect_and_constant_predictors(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "b")], "label string, prediction string")
    assert evaluation.macro(evaluation.per_class(evaluation.confusion(df))).first()["f1"] == 1.0
    assert evaluation.accuracy(df).first()["accuracy"] == 1.0
    constant = df.withColumn("prediction", F.lit("a"))
    by_class = {r["class"]: r for r in evaluation.report(constant).collect()}
    assert (by_class["b"]["precision"], by_class["b"]["recall"], by_class["b"]["f1"]) == (0.0, 0.0, 0.0)
    assert by_class["avg / total"]["support"] == 3
    flat = spark.createDataFrame([(1, 0.3), (0, 0.3), (0, 0.3)], "flag int, score double")
    assert curves.auc_roc(flat, "flag", "score").first()["auc"] == 0.5
    assert curves.auc_roc(flat.where("flag = 0"), "flag", "score").first()["auc"] == 0.5


def test_curve_measures_equal_brute_force(spark):
    rng = random.Random(4)
    # A third of all rows share one score.
    rows = [(rng.randint(0, 1), 0.5 if rng.random() < 0.33 else round(rng.gauss(0, 1), 2)) for _ in range(600)]
    df = spark.createDataFrame(rows, "flag int, score double")
    pos, neg = [s for f, s in rows if f], [s for f, s in rows if not f]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert math.isclose(curves.auc_roc(df, "flag", "score").first()["auc"], wins / len(pos) / len(neg))
    want, ap, last = {}, 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(s >= t for _, s in rows)
        want[t] = (tp, n - tp)
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in curves.pr_curve(df, "flag", "score").collect()}
    assert got == want
    assert math.isclose(curves.average_precision(df, "flag", "score").first()[0], ap)
    best = curves.best_threshold(df, "flag", "score").first()
    f1 = {t: 2 * tp / (tp + fp + len(pos)) for t, (tp, fp) in want.items()}
    assert best["threshold"] == min(t for t in f1 if f1[t] == max(f1.values()))


def test_auc_equals_the_library_evaluator(spark, sf_dir):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from flowlens.catalog.views import flows

    df = flows(spark, sf_dir).where("label is not null").select((F.col("label") == "BENIGN").cast("double").alias("flag"), "f_k")
    judge = BinaryClassificationEvaluator(labelCol="flag", rawPredictionCol="f_k", numBins=0)
    assert math.isclose(curves.auc_roc(df, "flag", "f_k").first()["auc"], judge.evaluate(df))


def test_ties_go_to_the_first_model_and_nan_counts_as_none(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, 0.5), (2, 0.1, 0.9, 0.9), (3, float("nan"), 0.2, 0.1)], "flow_id int, m1 double, m2 double, m3 double"
    )
    got = ensemble.ensemble_argmax(df, ["m1", "m2", "m3"]).orderBy("flow_id").collect()
    assert [r["prediction"] for r in got] == ["m1", "m2", "m2"]


def test_scores_align_by_key_and_only_complete_rows_stay(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "flow_id int, p double")
    b = spark.createDataFrame([(2, 0.4), (3, 0.5)], "flow_id int, p double")
    rows = align.align_scores({"a": a, "b b": b}, "flow_id", "p").collect()
    assert [r.asDict() for r in rows] == [{"flow_id": 2, "a": 0.2, "b b": 0.4}]


def test_perfect_reconstruction_has_no_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], [1.0, 4.0])], "x array<double>, same array<double>, off array<double>")
    row = df.select(
        reconstruction.mean_squared_difference(F.col("x"), F.col("same")).alias("a"),
        reconstruction.mean_squared_difference(F.col("x"), F.col("off")).alias("b"),
    ).first()
    assert (row["a"], row["b"]) == (0.0, 2.0)


@pytest.mark.parametrize("range_rows", [40, 200_000])
def test_curves_of_groups_equal_plain_ones(spark, monkeypatch, range_rows):
    """One group with most rows, one of a single score, one without positives, one without a name."""
    monkeypatch.setattr(curves, "_RANGE_ROWS", range_rows)
    r = random.Random(2)
    rows = [("most", r.randrange(2), round(r.gauss(0, 1), 2)) for _ in range(900)]
    rows += [("tied", k % 3 == 0, 0.5) for k in range(30)] + [("never", 0, r.random()) for _ in range(20)]
    rows += [(None, k % 2, (k % 2) + r.random() * 1.5) for k in range(50)] + [("most", 1, None)]
    df = spark.createDataFrame([(g, int(f), s) for g, f, s in rows], "model string, flag int, score double")
    auc = {x["model"]: x["auc"] for x in curves.auc_roc(df, "flag", "score", ["model"]).collect()}
    ap = {x["model"]: x["average_precision"] for x in curves.average_precision(df, "flag", "score", ["model"]).collect()}
    for name in ("most", "tied", "never", None):
        own = [(f, s) for g, f, s in rows if g == name and s is not None]
        pos, neg = [s for f, s in own if f], [s for f, s in own if not f]
        wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        assert auc[name] == pytest.approx(wins / (len(pos) * len(neg)) if pos and neg else 0.5)
        precision = [sum(q >= p for q in pos) / sum(s >= p for _, s in own) for p in pos]
        assert ap[name] == pytest.approx(sum(precision) / len(pos) if pos else 0.0)
    assert set(auc) == set(ap) == {"most", "tied", "never", None}
