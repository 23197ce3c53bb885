"""Fits, scores and their reports. Fitted results are no SQL; where a model query has SQL, the
SQL states a property the result must have on every row."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.sampling_queries import draw_sql
from flowlens.catalog.views import WIDE_FEATURES, WITH_CLEAN, WITH_WIDE, flows, wide
from flowlens.fixed_values import ATTACK_FEATURES, AUTOENCODER_SWEEP, BENIGN, BENIGN_FEATURES
from flowlens.functions.labels import benign_flag, fit_codes, merge_web_attacks, one_hot
from flowlens.operators import curves, evaluation as e
from flowlens.operators.cleaning import clean_flows, fill_missing, cast_numeric
from flowlens.operators.ensemble import ensemble_argmax
from flowlens.operators.features import fit_pca
from flowlens.operators.profile import label_counts, log_weights
from flowlens.operators.sampling import stratified_split
from flowlens.plans import autoencoder as ae
from flowlens.plans import forests as fo
from flowlens.plans import networks as nn
from flowlens.plans.flagship import detect_attacks
from flowlens.runtime import bounded_rows, materialise, scratch_path
from flowlens.sources.csv import read_csv_typed, write_csv
from flowlens.sources.models import load_model, save_model

_MERGED = """m AS (SELECT * REPLACE (CASE WHEN label LIKE 'Web Attack%' THEN 'Web-Attack' ELSE label END AS label) FROM wide)"""
_SMALL = fo.ForestSize(trees=20, depth=8)
_NET = nn.Training(rounds=4, iterations=12, patience=2)
_AUTO = ae.Training()
# Narrow layers get stuck from some starts; from this one they do not.
_START = 5


def _wide(spark, sf_dir) -> DataFrame:
    return wide(spark, sf_dir).withColumn("label", merge_web_attacks(F.col("label")))


def _attacks(spark, sf_dir) -> DataFrame:
    return _wide(spark, sf_dir).where(F.col("label") != BENIGN)


def _parts(df: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """The split table, written once: every fit and score below reads it from there."""
    return materialise(stratified_split(df, "flow_id", shares, seed), "parts")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _flag_report(fitted: fo.Fitted) -> DataFrame:
    """Report of a benign (1) or attack (0) model, and whether its ROC area is above 0.9. Rows are scored once."""
    scored = fo.flag_scores(fitted).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        auc = e.auc_of(scored)
        report = _beats_majority(e.report(scored, "flag", "prediction"))
    finally:
        scored.unpersist()
    return report.withColumn("auc_above_09", F.lit(int(auc > 0.9)))


def _splits(share: float) -> str:
    """SQL of the rows that a stratified split leaves for testing: ``tested(label, support)``."""
    return f"tested AS (SELECT label, n - CAST(floor({share} * n) AS BIGINT) AS support FROM (SELECT label, count(*) AS n FROM m GROUP BY label))"


def _verdict_sql(rows: str, where: str = "true") -> str:
    """Support of every class in the test part, and a model that beats always answering the largest class."""
    return f"""{WITH_WIDE}, {_MERGED}, {rows} SELECT label AS class, support, 1 AS beats_majority FROM tested WHERE {where} AND support > 0
    UNION ALL SELECT 'avg / total', CAST(sum(support) AS BIGINT), 1 FROM tested WHERE {where}"""


def _beats_majority(report: DataFrame) -> DataFrame:
    """``class, support, beats_majority`` of a report: the weighted F1 against that of the largest class alone."""
    rows = report.select(F.col("class").cast("string").alias("class"), "f1", F.col("support").cast("bigint").alias("support")).collect()
    total = next(r for r in rows if r["class"] == "avg / total")
    share = max(r["support"] for r in rows if r is not total) / total["support"]
    beats = int(total["f1"] > 2 * share * share / (1 + share))
    out = [(r["class"], r["support"], beats) for r in rows if r["support"] > 0]
    return report.sparkSession.createDataFrame(out, "class string, support bigint, beats_majority int")


_FLAGGED = "tested AS (SELECT CASE WHEN label = 'BENIGN' THEN '1' ELSE '0' END AS label, count(*) AS support FROM {rows} GROUP BY 1)"


@query("detect_attacks")
def flagship(spark, sf_dir):
    return detect_attacks(flows(spark, sf_dir), "flow_id", ["f_value", "f_k", "f_dirty"])


# One attack versus the rest ------------------------------------------------------------------


def _content_sql(attack: str, features: list[str]) -> str:
    """Test rows and positives among the distinct rows of an attack's columns, split by their content."""
    names = ", ".join(f'"{f}"' for f in features)
    return f"""SELECT '{attack}' AS attack, count(*) AS n_test, count(*) FILTER (WHERE label = '{attack}') AS n_positive
    FROM (SELECT DISTINCT {names}, label FROM m) WHERE {draw_sql('200', *[f'"{f}"' for f in features], 'label')} >= 0.7"""


# A model of fewer positives than this is not asked to beat chance.
_FEW = 5
_CHANCE_SQL = f"CASE WHEN n_positive >= {_FEW} THEN 1 END AS beats_chance"


def _measures(scored: DataFrame, by: str = "attack") -> DataFrame:
    """Per model: test rows, positives, ROC area and average precision, all models in one job each."""
    flags = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_test"), F.sum("flag").cast("bigint").alias("n_positive"))
    auc = curves.auc_roc(scored, "flag", "score", [by])
    return flags.join(auc, by).join(curves.average_precision(scored, "flag", "score", [by]), by)


def _beats_chance(measures: DataFrame) -> DataFrame:
    """What SQL can tell of the measures: sizes, and that models of enough positives are better than chance in both measures."""
    better = (F.col("auc") > 0.5) & (F.col("average_precision") > F.col("n_positive") / F.col("n_test"))
    return measures.select("attack", "n_test", "n_positive", F.when(F.col("n_positive") >= _FEW, better.cast("int")).alias("beats_chance"))


def _one_vs_rest(spark, sf_dir) -> DataFrame:
    return materialise(fo.fitted_scores(fo.fit_attacks(_wide(spark, sf_dir), ATTACK_FEATURES)), "scores")


@query(
    "one_vs_rest_forest",
    f"""{WITH_WIDE}, {_MERGED}, s AS ({" UNION ALL ".join(_content_sql(a, fs) for a, fs in ATTACK_FEATURES.items())})
    SELECT attack, n_test, n_positive, {_CHANCE_SQL} FROM s""",
)
def one_vs_rest_forest(spark, sf_dir):
    return _beats_chance(_measures(_one_vs_rest(spark, sf_dir)))


@query("one_vs_rest_measures")
def one_vs_rest_measures(spark, sf_dir):
    """The measures themselves."""
    return _measures(_one_vs_rest(spark, sf_dir))


_ENSEMBLE_FEATURES = list(dict.fromkeys(f for fs in ATTACK_FEATURES.values() for f in fs))


def _ensemble(spark, sf_dir) -> tuple[DataFrame, dict]:
    """The attack rows in two parts, and one forest of 400 trees for each attack."""
    parts = _parts(_attacks(spark, sf_dir), {"train": 0.8, "test": 0.2})
    return parts, fo.fit_weighted_attacks(parts.where("split = 'train'"), ATTACK_FEATURES, key="flow_id")


def _weighted_verdicts(spark, sf_dir) -> DataFrame:
    parts, models = _ensemble(spark, sf_dir)
    return materialise(fo.attack_verdicts(parts.where("split = 'test'"), models).withColumn("flag", F.col("label")), "verdicts")


@query(
    "attack_forests_weighted",
    f"""{WITH_WIDE}, {_MERGED}, {_splits(0.8)}, a AS (SELECT unnest([{", ".join(f"'{a}'" for a in ATTACK_FEATURES)}]) AS attack),
    s AS (SELECT attack, CAST(sum(support) AS BIGINT) AS n_test, CAST(coalesce(sum(support) FILTER (WHERE label = attack), 0) AS BIGINT) AS n_positive
        FROM a, tested WHERE label <> 'BENIGN' GROUP BY attack)
    SELECT attack, n_test, n_positive, {_CHANCE_SQL} FROM s""",
)
def attack_forests_weighted(spark, sf_dir):
    return _beats_chance(_measures(_weighted_verdicts(spark, sf_dir)))


@query("attack_forests_report")
def attack_forests_report(spark, sf_dir):
    """Precision, recall and F1 of each model's yes and no, with its measures over all thresholds."""
    verdicts = _weighted_verdicts(spark, sf_dir)
    return e.report(verdicts, "label", "prediction", "attack").join(_measures(verdicts), "attack")


@query(
    "positive_probability",
    f"""{WITH_WIDE}, {_MERGED} SELECT label, count(*) AS n, 12 AS n_scores, 1 AS all_in_range,
        CASE WHEN count(*) >= 50 THEN 1 END AS own_score_is_higher
    FROM m WHERE label <> 'BENIGN' AND label IN ({", ".join(f"'{a}'" for a in ATTACK_FEATURES)}) GROUP BY label""",
)
def positive_probability(spark, sf_dir):
    """Per attack: rows, and for attacks of 50 rows or more whether their own model scores them
    above the rows of other attacks on average."""
    parts, models = _ensemble(spark, sf_dir)
    # written once, as every cell below would score its row again
    scored = materialise(fo.positive_probability(parts.select("flow_id", "label", *[F.col(f"`{f}`") for f in _ENSEMBLE_FEATURES]), models), "scored")
    scores = F.array(*[F.col(f"`{a}`") for a in models])
    inside = F.forall(scores, lambda p: (p >= 0) & (p <= 1)).cast("int")
    names = F.array(*[F.lit(a) for a in models])
    each = F.explode(F.arrays_zip(names.alias("model"), scores.alias("p"))).alias("c")
    cells = scored.select("label", F.size(scores).alias("n_scores"), inside.alias("inside"), each)
    own = F.col("c.model") == F.col("label")
    per_model = cells.groupBy(F.col("c.model").alias("label")).agg(
        F.count_if(own).alias("n"),
        F.max("n_scores").alias("n_scores"),
        F.min("inside").alias("all_in_range"),
        (F.avg(F.when(own, F.col("c.p"))) > F.avg(F.when(~own, F.col("c.p")))).cast("int").alias("own_score_is_higher"),
    )
    often = F.when(F.col("n") >= 50, F.col("own_score_is_higher"))
    return per_model.where("n > 0").withColumn("own_score_is_higher", often)


@query("ensemble_forest", _verdict_sql(_splits(0.8), "label <> 'BENIGN'"))
def ensemble_forest(spark, sf_dir):
    parts, models = _ensemble(spark, sf_dir)
    scored = materialise(fo.positive_probability(parts.where("split = 'test'"), models), "scored")
    return _beats_majority(e.report(ensemble_argmax(scored, list(models))))


# Benign versus attack --------------------------------------------------------------------------


def _benign_sql(tested: str) -> str:
    return _verdict_sql(tested).replace("1 AS beats_majority", "1 AS beats_majority, 1 AS auc_above_09").replace("1 FROM tested", "1, 1 FROM tested")


_KEYED = f"{draw_sql('100', 'flow_id')} >= 0.8"
_THINNED = f"(label <> 'BENIGN' OR {draw_sql('100-sample', 'flow_id')} < 471454.0 / 2647898)"


@query("benign_forest", _benign_sql(_FLAGGED.format(rows=f"(SELECT * FROM m WHERE {_KEYED})")))
def benign_forest(spark, sf_dir):
    return _flag_report(fo.fit_benign(_wide(spark, sf_dir), "flow_id", WIDE_FEATURES))


@query("benign_forest_sampled", _benign_sql(_FLAGGED.format(rows=f"(SELECT * FROM m WHERE {_KEYED} AND {_THINNED})")))
def benign_forest_sampled(spark, sf_dir):
    return _flag_report(fo.fit_benign_thinned(_wide(spark, sf_dir), "flow_id", WIDE_FEATURES))


@query(
    "benign_forest_full",
    _benign_sql(
        """tested AS (SELECT CASE WHEN label = 'BENIGN' THEN '1' ELSE '0' END AS label, CAST(sum(n - floor(0.8 * n)) AS BIGINT) AS support
        FROM (SELECT label, count(*) AS n FROM m GROUP BY label) GROUP BY 1)"""
    ),
)
def benign_forest_full(spark, sf_dir):
    df = _wide(spark, sf_dir)
    every = [*WIDE_FEATURES, "Flow Bytes/s"]
    df = fill_missing(cast_numeric(df, every), every)
    return _flag_report(fo.fit_benign_full(df, "flow_id", every))


@query(
    "score_model",
    f"""{WITH_WIDE} SELECT label = 'BENIGN' AS benign, count(*) AS n, count(*) AS n_sum_to_one, 1 AS mostly_right
    FROM wide GROUP BY 1""",
)
def score_model(spark, sf_dir):
    """Per true class: rows, rows whose probabilities sum to one, and whether nine in ten are told right.

    The model is a small one; scoring is what this query is about.
    """
    df = _wide(spark, sf_dir)
    fitted = fo.fit_benign(df, "flow_id", BENIGN_FEATURES, _SMALL)
    p = vector_to_array("probability")
    scored = fitted.model.transform(wide(spark, sf_dir)).withColumn("benign", F.col("label") == BENIGN)
    right = F.avg((F.col("prediction") == benign_flag(F.col("label"))).cast("int")) > 0.9
    return scored.groupBy("benign").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(p[0] + p[1] - 1) < 1e-9).alias("n_sum_to_one"), right.cast("int").alias("mostly_right")
    )


# All classes at once ---------------------------------------------------------------------------


@query("attack_forest_onehot", _verdict_sql(_splits(0.8), "label <> 'BENIGN'"))
def attack_forest_onehot(spark, sf_dir):
    parts = _parts(_attacks(spark, sf_dir), {"train": 0.8, "test": 0.2})
    classes = fo.attack_classes(parts)
    models = fo.fit_one_hot(parts.where("split = 'train'"), WIDE_FEATURES, classes, key="flow_id")
    scored = materialise(fo.score_one_hot(parts.where("split = 'test'"), models), "scored")
    return _beats_majority(e.report(scored))


@query("attack_forest_onehot_rounded")
def attack_forest_onehot_rounded(spark, sf_dir):
    """The class columns rounded one by one, each against its own 0/1 truth."""
    parts = _parts(_attacks(spark, sf_dir), {"train": 0.8, "test": 0.2})
    classes = fo.attack_classes(parts)
    models = fo.fit_one_hot(parts.where("split = 'train'"), WIDE_FEATURES, classes, key="flow_id")
    scored = materialise(fo.score_one_hot(parts.where("split = 'test'"), models), "scored")
    rounded = one_hot(scored, "label", classes, "t_").withColumns({f"p_{c}": F.bround(f"`score_{c}`") for c in classes})
    return e.one_hot_report(rounded, {c: f"t_{c}" for c in classes}, {c: f"p_{c}" for c in classes})


@query("attack_forest_smote", _verdict_sql(_splits(0.8), "label <> 'BENIGN'"))
def attack_forest_smote(spark, sf_dir):
    parts = _parts(_attacks(spark, sf_dir), {"train": 0.8, "test": 0.2})
    classes = fo.attack_classes(parts)
    model = fo.fit_smote_regression(parts.where("split = 'train'"), "flow_id", WIDE_FEATURES, classes)
    scored = fo.nearest_class(model.transform(parts.where("split = 'test'")))
    picked = F.array(*[F.lit(c) for c in classes])
    return _beats_majority(e.report(scored.withColumn("class_name", F.element_at(picked, F.col("class_code") + 1)), "label", "class_name"))


@query("multiclass_forest_regression")
def multiclass_forest_regression(spark, sf_dir):
    df = _wide(spark, sf_dir)
    coded = fit_codes(df, "label", "code", "frequencyDesc").transform(df)
    fitted = fo.fit_code_regression(coded.select("flow_id", "code", *[F.col(f"`{f}`") for f in WIDE_FEATURES]), "flow_id", WIDE_FEATURES, "code")
    scored = fo.nearest_class(fitted.model.transform(fitted.test)).withColumn("code_int", F.col("code").cast("int"))
    error = e.rmse(scored, "code", "prediction").first()["rmse"]
    return e.report(scored, "code_int", "class_code").withColumn("rmse", F.lit(error))


# Networks --------------------------------------------------------------------------------------

_SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


def _network_report(df: DataFrame, classes: list[str], weighted: bool) -> DataFrame:
    parts = _parts(df, _SHARES, seed=42)
    coded = fit_codes(parts, "label", "code").transform(parts)
    train = coded.where("split = 'train'")
    if weighted:
        weights = bounded_rows(log_weights(label_counts(train, "code")), 1000, "classes")
        train = nn.repeat_by_weight(train, "flow_id", "code", {int(r["code"]): r["weight"] for r in weights}, seed=1)
    network = nn.fit_network(train, coded.where("split = 'valid'"), WIDE_FEATURES, "code", len(classes), training=_NET)
    scored = network.model.transform(coded.where("split = 'test'"))
    names = F.array(*[F.lit(c) for c in classes])
    named = scored.withColumn("prediction", F.element_at(names, F.col("prediction").cast("int") + 1))
    return _beats_majority(e.report(named))


@query("mlp_multiclass", _verdict_sql(_splits(0.9)))
def mlp_multiclass(spark, sf_dir):
    df = _wide(spark, sf_dir)
    return _network_report(df, sorted([*fo.attack_classes(df), BENIGN]), weighted=True)


@query("mlp_attacks", _verdict_sql(_splits(0.9), "label <> 'BENIGN'"))
def mlp_attacks(spark, sf_dir):
    df = _attacks(spark, sf_dir)
    return _network_report(df, fo.attack_classes(df), weighted=True)


@query(
    "mlp_binary",
    _verdict_sql(
        """tested AS (SELECT label, n - CAST(floor(0.9 * n) AS BIGINT) AS support
        FROM (SELECT CASE WHEN label = 'BENIGN' THEN 'benign' ELSE 'attack' END AS label, count(*) AS n FROM m GROUP BY 1))"""
    ),
)
def mlp_binary(spark, sf_dir):
    df = _wide(spark, sf_dir).withColumn("label", F.when(benign_flag(F.col("label")) == 1, "benign").otherwise("attack"))
    return _network_report(df, ["attack", "benign"], weighted=False)


def _binary_parts(spark, sf_dir) -> DataFrame:
    df = _wide(spark, sf_dir).withColumn("code", benign_flag(F.col("label")).cast("double"))
    return _parts(df, _SHARES, seed=42)


@query("early_stopping")
def early_stopping(spark, sf_dir):
    """Validation loss and scores round by round, and the round whose weights were kept."""
    parts = _binary_parts(spark, sf_dir)
    training = nn.Training(rounds=8, iterations=5, patience=3)
    seen = []
    network = nn.fit_network(
        parts.where("split = 'train'"), parts.where("split = 'valid'"), WIDE_FEATURES, "code", 2, [20], training,
        lambda number, scored: seen.append(nn.round_scores(scored, "code", 2)),
    )
    names = ["precision", "recall", "f1", "average_precision"]
    rows = [
        (i, loss, *[float(seen[i][n]) for n in names], int(i == network.best_round)) for i, loss in enumerate(network.losses)
    ]
    scores = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"round int, loss double, {scores}, kept int")


@query("network_measures")
def network_measures(spark, sf_dir):
    """Loss, accuracy and ROC area of the binary network, trained as its plan says, on its test rows."""
    parts = _binary_parts(spark, sf_dir)
    train, valid, test = (parts.where(f"split = '{name}'") for name in _SHARES)
    return nn.network_measures(nn.fit_network(train, valid, WIDE_FEATURES, "code", 2), test, "code", 2)


@query("width_sweep")
def width_sweep(spark, sf_dir):
    parts = _binary_parts(spark, sf_dir)
    training = nn.Training(rounds=3, iterations=10, patience=2)
    slow = nn.Training(rounds=3, iterations=10, patience=2, solver="gd", step=0.002)
    candidates = {"narrow": ([10], training), "wide": ([50], training), "deep": ([20, 20], training), "slow": ([10], slow)}
    return nn.sweep_networks(
        parts.where("split = 'train'"), parts.where("split = 'valid'"), WIDE_FEATURES, "code", 2, candidates
    )


@query("network_argmax", f"{WITH_WIDE} SELECT flow_id, 1 AS same_class, 1 AS learned FROM wide")
def network_argmax(spark, sf_dir):
    """The predicted class is the place of the largest network output, on every row, and on rows that were held out it is
    wrong less than half as often as always naming the larger class."""
    df = _wide(spark, sf_dir).withColumn("code", benign_flag(F.col("label")).cast("double"))
    held_out = F.pmod("flow_id", F.lit(5)) == 0
    network = nn.fit_network(df.where(~held_out), df.where(held_out), WIDE_FEATURES, "code", 2, training=_NET)
    p = vector_to_array("probability")
    largest = F.array_position(p, F.array_max(p)) - 1
    scored = network.model.transform(df)
    scored = scored.select("flow_id", "code", "prediction", (largest == F.col("prediction").cast("bigint")).cast("int").alias("same_class"))
    scored = materialise(scored, "scored")
    wrong, benign, n = scored.where(held_out).agg(F.count_if(F.col("code") != F.col("prediction")), F.count_if(F.col("code") == 1), F.count("*")).first()
    return scored.select("flow_id", "same_class", F.lit(int(2 * wrong < min(benign, n - benign))).alias("learned"))


# Without labels --------------------------------------------------------------------------------


def _auto_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows scaled, in three parts: to train on, to stop by, to report on. Labels are never seen in training."""
    df = _wide(spark, sf_dir)
    rows = ae.scaled_rows(ae.scale_rows(df, WIDE_FEATURES), df).select("flow_id", "label", "x")
    rows = materialise(rows, "scaled")
    fold = F.pmod("flow_id", F.lit(5))
    return rows.where(fold > 1), rows.where(fold == 0), rows.where(fold == 1)


def _mean_row_loss(rows: DataFrame) -> float:
    """Mean squared difference from the mean row: what a network that learns nothing reaches."""
    per_column = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("v"))
    return per_column.agg(F.avg("v")).first()[0]


_LEARNED_SQL = "SELECT 1 AS beats_half_of_mean_row, 1 AS has_epochs"


def _learned(spark, model: ae.Autoencoder, valid: DataFrame) -> DataFrame:
    row = (int(min(model.losses) < _mean_row_loss(valid) / 2), int(0 < len(model.losses)))
    return spark.createDataFrame([row], "beats_half_of_mean_row int, has_epochs int")


@query(
    "autoencoder_fit",
    f"""{WITH_WIDE}, {_MERGED} SELECT label, count(*) AS n, 1 AS beats_half_of_mean_row FROM m GROUP BY label""",
)
def autoencoder_fit(spark, sf_dir):
    """Rows per class, and whether the network rebuilds rows it was not trained on much better than the mean row."""
    train, valid, test = _auto_tables(spark, sf_dir)
    model = ae.fit_autoencoder(train, valid, ae.new_autoencoder(len(WIDE_FEATURES), seed=_START), _AUTO, "flow_id")
    loss = ae.with_error(test, model).agg(F.avg("error")).first()[0]
    beats = F.lit(int(loss < _mean_row_loss(test) / 2)).alias("beats_half_of_mean_row")
    return train.unionByName(valid).unionByName(test).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("*", beats)


@query("autoencoder5_fit", _LEARNED_SQL)
def autoencoder5_fit(spark, sf_dir):
    train, valid, _ = _auto_tables(spark, sf_dir)
    start = ae.new_autoencoder(len(WIDE_FEATURES), AUTOENCODER_SWEEP["model25"], seed=_START)
    model = ae.fit_autoencoder(train, valid, start, _AUTO, "flow_id")
    return _learned(spark, model, valid)


@query("autoencoder_curve")
def autoencoder_curve(spark, sf_dir):
    """The loss on the rows to stop by after each epoch, and the epoch whose weights were kept."""
    train, valid, _ = _auto_tables(spark, sf_dir)
    model = ae.fit_autoencoder(train, valid, ae.new_autoencoder(len(WIDE_FEATURES), seed=_START), _AUTO, "flow_id")
    kept = int(np.argmin(model.losses))
    return spark.createDataFrame([(i, loss, int(i == kept)) for i, loss in enumerate(model.losses)], "epoch int, loss double, kept int")


@query("load_autoencoder", f"{WITH_WIDE} SELECT flow_id, 1 AS same_error FROM wide")
def load_autoencoder(spark, sf_dir):
    """A stored network scores every row as it did before it was stored."""
    train, valid, test = _auto_tables(spark, sf_dir)
    model = ae.fit_autoencoder(train, valid, ae.new_autoencoder(len(WIDE_FEATURES), seed=_START), _AUTO, "flow_id")
    again = ae.load_autoencoder(spark, ae.save_autoencoder(spark, model, scratch_path(spark, "autoencoder")))
    before = ae.with_error(train.unionByName(valid).unionByName(test), model).withColumnRenamed("error", "before")
    return ae.with_error(before, again).select("flow_id", (F.col("before") == F.col("error")).cast("int").alias("same_error"))


@query("bottleneck_encode", f"{WITH_WIDE} SELECT flow_id, 2 AS width, 1 AS not_negative, 1 AS varies FROM wide")
def bottleneck_encode(spark, sf_dir):
    """Codes from the trained network: two rectified numbers per row that differ between rows."""
    train, valid, test = _auto_tables(spark, sf_dir)
    model = ae.fit_autoencoder(train, valid, ae.new_autoencoder(len(WIDE_FEATURES), seed=_START), _AUTO, "flow_id")
    coded = materialise(ae.with_code(train.unionByName(valid).unionByName(test), model).select("flow_id", "code"), "codes")
    spread = coded.agg(F.stddev(F.col("code")[0]), F.stddev(F.col("code")[1])).first()
    varies = F.lit(int(max(s or 0.0 for s in spread) > 1e-3))
    return coded.select(
        "flow_id", F.size("code").alias("width"), F.forall("code", lambda v: v >= 0).cast("int").alias("not_negative"), varies.alias("varies")
    )


@query("autoencoder_sweep")
def autoencoder_sweep(spark, sf_dir):
    train, valid, _ = _auto_tables(spark, sf_dir)
    return ae.sweep_autoencoders(train, valid, len(WIDE_FEATURES), AUTOENCODER_SWEEP, _AUTO, "flow_id")


def _threshold_report(valid: DataFrame, test: DataFrame) -> DataFrame:
    """The threshold of the best F1 on one table, what it reaches on another, and that table's share of attacks."""
    flag = (F.col("label") != BENIGN).cast("int").alias("flag")
    best = curves.best_threshold(valid.select(flag, "error"), "flag", "error").first()
    hit = (F.col("flag") == 1) & (F.col("error") >= F.lit(best["threshold"]))
    sums = test.select(flag, "error").agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("error") >= F.lit(best["threshold"])).alias("found"), F.sum("flag").alias("pos"), F.count("*").alias("n")
    )
    base = F.col("pos") / F.col("n")
    f1, flag_all = 2 * F.col("tp") / (F.col("found") + F.col("pos")), 2 * base / (base + 1)
    return sums.select(
        F.lit(best["threshold"]).alias("threshold"),
        F.try_divide("tp", "found").alias("precision"),
        F.try_divide("tp", "pos").alias("recall"),
        f1.alias("f1"),
        base.alias("base_rate"),
        flag_all.alias("f1_of_flagging_all"),
    )


@query("autoencoder_threshold")
def autoencoder_threshold(spark, sf_dir):
    """Attack rows found by the error alone: threshold from the rows that stopped training, report on others."""
    train, valid, test = _auto_tables(spark, sf_dir)
    model = ae.fit_autoencoder(train, valid, ae.new_autoencoder(len(WIDE_FEATURES), seed=_START), _AUTO, "flow_id")
    return _threshold_report(ae.with_error(valid, model), ae.with_error(test, model))


@query("pca_anomaly", "SELECT 1 AS beats_flagging_all, 1 AS has_base_rate")
def pca_anomaly(spark, sf_dir):
    df = _wide(spark, sf_dir)
    fold = F.pmod("flow_id", F.lit(2))
    scored = materialise(ae.pca_distance(df, fit_pca(df, WIDE_FEATURES, 5, scale=True)).select("flow_id", "label", "error"), "distances")
    found = _threshold_report(scored.where(fold == 0), scored.where(fold == 1))
    beats = (F.col("f1") > F.col("f1_of_flagging_all") + 0.1).cast("int")
    return found.select(beats.alias("beats_flagging_all"), ((F.col("base_rate") > 0) & (F.col("base_rate") < 1)).cast("int").alias("has_base_rate"))


@query(
    "pca_anomaly_complete",
    f"{WITH_CLEAN} SELECT flow_id, CAST(0 AS DOUBLE) AS error FROM clean",
)
def pca_anomaly_complete(spark, sf_dir):
    """With as many components as features nothing is left of any row."""
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    names = ["f_value", "f_k", "f_dirty"]
    return ae.pca_error(df, fit_pca(df, names, 3, scale=True)).select("flow_id", F.round("error", 6).alias("error"))


# Models on storage, reports, timing ---------------------------------------------------------------


def _reloaded(spark, sf_dir):
    df = _wide(spark, sf_dir)
    fitted = fo.fit_benign(df, "flow_id", BENIGN_FEATURES, _SMALL)
    again = load_model(save_model(fitted.model, scratch_path(spark, "model")))
    kept = ["flow_id", "label"]
    first = fitted.model.transform(df).select(*kept, *BENIGN_FEATURES, F.col("prediction").alias("before"))
    return again.transform(first)


@query("save_model", f"{WITH_WIDE}, {_MERGED} SELECT flow_id, label, 1 AS same_prediction FROM m")
def save_model_query(spark, sf_dir):
    same = (F.col("before") == F.col("prediction")).cast("int")
    return _reloaded(spark, sf_dir).select("flow_id", "label", same.alias("same_prediction"))


@query("load_model", f"{WITH_WIDE}, {_MERGED} SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_changed FROM m GROUP BY label")
def load_model_query(spark, sf_dir):
    return _reloaded(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("prediction")).alias("n_changed")
    )


_RULE = "CASE WHEN f_value < 90 THEN 'BENIGN' WHEN f_value < 160 THEN 'DoS Hulk' WHEN f_value < 190 THEN 'PortScan' ELSE 'Bot' END"
_REPORT_ATTACKS = ["Bot", "DoS Hulk", "PortScan"]
_REPORT_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS attack, CAST({v} AS VARCHAR) AS class, sum(CAST(truth = {v} AND guess = {v} AS INT)) AS hits,
    sum(CAST(truth = {v} AS INT)) AS support, sum(CAST(guess = {v} AS INT)) AS predicted
    FROM (SELECT CAST(label = '{a}' AS INT) AS truth, CAST({_RULE} = '{a}' AS INT) AS guess FROM clean)"""
    for a in _REPORT_ATTACKS
    for v in (0, 1)
)


@query(
    "sink_report",
    f"""{WITH_CLEAN}, s AS ({_REPORT_SQL}), c AS (SELECT attack, class, hits / predicted AS precision, hits / support AS recall,
        2 * hits / (support + predicted) AS f1, CAST(support AS BIGINT) AS support FROM s)
    SELECT attack, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c
    UNION ALL SELECT attack, 'avg / total', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT)
    FROM c GROUP BY attack""",
)
def sink_report(spark, sf_dir):
    """Reports of all attacks as one CSV table with a directory per attack."""
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"]).withColumn("guess", F.expr(_RULE))
    each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("attack"),
                    (F.col("label") == a).cast("int").alias("label"),
                    (F.col("guess") == a).cast("int").alias("prediction"),
                )
                for a in _REPORT_ATTACKS
            ]
        )
    )
    table = _rounded(e.report(df.select(each.alias("v")).select("v.*"), "label", "prediction", "attack"), "precision", "recall", "f1")
    path = write_csv(table, scratch_path(spark, "report"), by="attack")
    return read_csv_typed(spark, path, "class string, precision double, recall double, f1 double, support bigint, attack string")


@query("fit_seconds")
def fit_seconds(spark, sf_dir):
    """How long fits of growing forests take on the same rows."""
    df = _wide(spark, sf_dir)
    n = df.count()
    rows = []
    for trees in (5, 10, 20):
        fitted = fo.fit_benign(df, "flow_id", BENIGN_FEATURES, fo.ForestSize(trees=trees))
        rows.append((trees, n, float(fitted.seconds)))
    return spark.createDataFrame(rows, "trees int, n_rows bigint, seconds double")
