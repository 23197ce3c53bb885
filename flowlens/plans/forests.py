"""Forest models: one attack versus the rest, benign versus attack, and all classes at once.

Every model is a pipeline from named columns to a prediction, so it can be saved, loaded and
applied to any table with those columns.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.fixed_values import BENIGN
from flowlens.functions.draws import draw_key
from flowlens.functions.labels import (
    MAX_CLASSES,
    argmax,
    benign_flag,
    class_names,
    code_by_list,
    one_vs_rest,
    round_to_class,
)
from flowlens.operators.cleaning import with_label
from flowlens.operators.features import assembler
from flowlens.operators.profile import label_counts
from flowlens.operators.sampling import random_split, split_by, stratified_split, thin_benign
from flowlens.operators.smote import smote
from flowlens.plans.grown import Wanted, binned, grown, scored, stored
from flowlens.runtime import SIDE_BY_SIDE, bounded_rows, column, laid_out, layout_partitions, materialise, scratch_path, side_by_side, spread

# Deeper trees are refused by the library.
DEEPEST = 30
#: Partitions that all fits running at once read together, as long as none has more than so many rows.
FOREST_PARTITIONS, FOREST_ROWS = 12, 250_000
_CODE = "_code"
_FLAG = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}


@dataclass(frozen=True)
class ForestSize:
    """How large a forest to grow; the values of each plan below are its defaults.

    ``bins`` is the number of split candidates per feature. Plans that stand for exact splits
    take more of them.
    """

    trees: int = 20
    depth: int = 5
    min_leaf: int = 1
    bins: int = 32
    seed: int = 1

    def settings(self) -> dict:
        return {
            "numTrees": self.trees,
            "maxDepth": min(self.depth, DEEPEST),
            "minInstancesPerNode": self.min_leaf,
            "maxBins": self.bins,
            "seed": self.seed,
            "maxMemoryInMB": 1024,
            "cacheNodeIds": True,
        }


@dataclass(frozen=True)
class Fitted:
    """A model, the rows held out for testing it, and how long it took to fit."""

    model: PipelineModel
    test: DataFrame
    seconds: float


def as_flag(flag: Column, name: str = "flag") -> Column:
    """A 0/1 label that tells the learner its classes, which saves it a pass over the rows."""
    return flag.cast("double").alias(name, metadata=_FLAG)


def forest_partitions(rows: int, at_once: int = 1) -> int:
    """Partitions of so many training rows when ``at_once`` forests are grown side by side.

    Every partition sends a full histogram of every open node of all trees, however few of its rows lie there. Deep trees have
    nodes in proportion to the rows, so what is sent stays in proportion to the rows only while the partitions are few.
    """
    few = max(FOREST_PARTITIONS // min(at_once, SIDE_BY_SIDE), -(-rows // FOREST_ROWS))
    return min(few, layout_partitions(rows))


@contextmanager
def hold(train: DataFrame, keys: list[str] | None = None, at_once: int = 1) -> Iterator[DataFrame]:
    """Training rows laid out once and held while any number of models is fitted to them, ``at_once`` side by side."""
    held = laid_out(train, keys, lambda rows: forest_partitions(rows, at_once)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def fit_held_classifier(held: DataFrame, features: list[str], label: str, size: ForestSize, weight: str | None = None) -> tuple[PipelineModel, float]:
    """A forest on named columns of held rows and the seconds its fit took."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", **size.settings())
    if weight is not None:
        forest = forest.setWeightCol(weight)
    return _timed(Pipeline(stages=[assembler(features), forest]), held)


def fit_held_regressor(held: DataFrame, features: list[str], label: str, size: ForestSize) -> tuple[PipelineModel, float]:
    forest = RandomForestRegressor(labelCol=label, featuresCol="features", **size.settings())
    return _timed(Pipeline(stages=[assembler(features), forest]), held)


def _timed(pipeline: Pipeline, held: DataFrame) -> tuple[PipelineModel, float]:
    start = time.monotonic()
    return pipeline.fit(held), time.monotonic() - start


def fit_classifier(
    train: DataFrame, features: list[str], label: str, size: ForestSize, weight: str | None = None, keys: list[str] | None = None,
    at_once: int = 1,
) -> tuple[PipelineModel, float]:
    """The same on rows that are held for this fit alone; ``keys`` deal them out. ``at_once`` such fits run side by side."""
    names = [*features, label, *([weight] if weight else []), *(keys or [])]
    with hold(train.select(*[column(n) for n in names]), keys, at_once) as held:
        return fit_held_classifier(held, features, label, size, weight)


def fit_regressor(train: DataFrame, features: list[str], label: str, size: ForestSize, keys: list[str] | None = None) -> tuple[PipelineModel, float]:
    with hold(train.select(*[column(n) for n in [*features, label, *(keys or [])]]), keys) as held:
        return fit_held_regressor(held, features, label, size)


# One attack versus the rest ------------------------------------------------------------------


def attack_rows(df: DataFrame, dictionary: dict[str, list[str]], shares: dict[str, float] | None = None, seed: int = 200, label: str = "label") -> DataFrame:
    """``attack, v, flag, split``: every distinct row of each attack's own columns, numbered columns in ``v``.

    All attacks come from one scan of the table. Copies are dropped first, so the split goes by the content of the
    rows: a distinct row is its own key.
    """
    kinds = dict(df.dtypes)

    def as_text(name: str) -> Column:
        # a negative zero is the same row as a positive one
        c = column(name) + F.lit(0.0) if kinds[name] in ("double", "float") else column(name)
        return c.cast("string")

    named_rows = [
        F.struct(F.lit(a).alias("attack"), F.array(*[as_text(f) for f in fs]).alias("v"), column(label).alias("label")) for a, fs in dictionary.items()
    ]
    each = with_label(df, label).select(F.explode(F.array(*named_rows)).alias("r")).select("r.*").distinct()
    drawn = draw_key(seed, F.concat_ws("-", "v", "label"))
    value = F.transform("v", lambda t: _finite_or_zero(t.try_cast("double")))
    parts = split_by(each.withColumn("drawn", drawn), "drawn", shares or {"train": 0.7, "test": 0.3})
    return parts.select("attack", value.alias("v"), one_vs_rest(F.col("label"), F.col("attack")).alias("flag"), "split")


def _finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def fit_attacks(
    df: DataFrame, dictionary: dict[str, list[str]], size: ForestSize = ForestSize(bins=256),
    shares: dict[str, float] | None = None, seed: int = 200, label: str = "label",
) -> dict[str, Fitted]:
    """Each attack of the dictionary against every other label, benign included, on the attack's own features.

    A rare attack often sits in the last fraction of a percent of a feature, which few bins of
    equal frequency cannot cut off; hence many bins.
    """
    made = attack_rows(df, dictionary, shares, seed, label)
    path = scratch_path(df.sparkSession, "attacks")
    made.write.partitionBy("attack").parquet(path)  # a directory per attack: a fit reads its own rows only
    rows = df.sparkSession.read.schema(made.schema).parquet(path)

    def fit(attack: str, features: list[str]) -> Fitted:
        own = rows.where(F.col("attack") == attack)
        own = own.select(*[F.col("v")[i].alias(f) for i, f in enumerate(features)], as_flag(F.col("flag")), "split")
        model, seconds = fit_classifier(own.where("split = 'train'"), features, "flag", size, at_once=len(dictionary))
        return Fitted(model, own.where("split = 'test'").drop("split"), seconds)

    return side_by_side(df.sparkSession, {a: (lambda a=a, fs=fs: fit(a, fs)) for a, fs in dictionary.items()})


def fit_attack(df: DataFrame, attack: str, features: list[str], size: ForestSize = ForestSize(bins=256), **more) -> Fitted:
    """``fit_attacks`` for one attack."""
    return fit_attacks(df, {attack: features}, size, **more)[attack]


def fitted_scores(fitted: dict[str, Fitted]) -> DataFrame:
    """``attack, flag, score, prediction`` over the test rows of several models, each scored once."""
    scored = [
        f.model.transform(f.test).select(F.lit(a).alias("attack"), F.col("flag").cast("int").alias("flag"), vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction"))
        for a, f in fitted.items()
    ]
    return reduce(DataFrame.unionByName, scored)


def fit_weighted_attacks(
    train: DataFrame,
    dictionary: dict[str, list[str]],
    size: ForestSize = ForestSize(trees=400, depth=DEEPEST, min_leaf=3, bins=128),
    label: str = "label",
    key: str | None = None,
) -> dict[str, PipelineModel]:
    """One class-balanced forest per attack over the same training rows, laid out and cut into bins once for all of them."""
    counts = {r[label]: r["n"] for r in bounded_rows(label_counts(train, label), MAX_CLASSES, "classes")}
    total = sum(counts.values())

    def wanted(attack: str, features: list[str]) -> Wanted:
        positive = counts.get(attack, 0)
        weights = total / (2 * max(total - positive, 1)), total / (2 * max(positive, 1))
        return Wanted(features, [int(c == attack) for c in counts], weights)

    return _fit_labelled(train, {a: wanted(a, fs) for a, fs in dictionary.items()}, label, list(counts), key, size, weight="weight")


def _fit_labelled(
    train: DataFrame, forests: dict[str, Wanted], label: str, classes: list, key: str | None, size: ForestSize, **more
) -> dict[str, PipelineModel]:
    """Forests whose rows are told by their label, one of ``classes``; all read the same rows, written once."""
    names = list(dict.fromkeys(f for w in forests.values() for f in w.features))
    known = [c for c in classes if c is not None]  # a row without label has no code, which is an error
    coded = train.select(*[column(n) for n in names], code_by_list(column(label), known).alias(_CODE), *([column(key)] if key else []))
    spots = [i for i, c in enumerate(classes) if c is not None]
    forests = {n: replace(w, classes=[w.classes[i] for i in spots]) for n, w in forests.items()}
    with hold(coded, [key] if key else None) as held:
        table = binned(held, names, _CODE, size.bins)
    return grown(table, train.sparkSession, forests, size.settings(), **more)


def positive_probability(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """One column per model with its probability of class 1.

    All models see the same rows, which are spread over all cores before: no join. Forests grown here are applied in one pass.
    """
    forests = {name: stored(model) for name, model in models.items()}
    if all(forests.values()):
        return scored(spread(df), forests)
    for name, model in models.items():
        score = vector_to_array("probability")[1]
        df = model.transform(df).select(*[column(c) for c in df.columns], score.alias(name))
    return df


def attack_verdicts(df: DataFrame, models: dict[str, PipelineModel], label: str = "label") -> DataFrame:
    """``attack, label, prediction, score``: each model's own yes or no on each row, in one pass."""
    told = positive_probability(df, models)
    verdict = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("attack"),
                    one_vs_rest(column(label), a).alias("label"),
                    (column(a) > 0.5).cast("int").alias("prediction"),
                    column(a).alias("score"),
                )
                for a in models
            ]
        )
    )
    return told.select(verdict.alias("v")).select("v.*")


# Benign versus attack --------------------------------------------------------------------------


def fit_benign(
    df: DataFrame,
    key: str,
    features: list[str],
    size: ForestSize = ForestSize(trees=200, depth=25),
    seed: int = 100,
    label: str = "label",
) -> Fitted:
    """Benign (1) against all attacks (0), an 80/20 split by key."""
    parts = random_split(_flagged(df, key, features, label), [key], {"train": 0.8, "test": 0.2}, seed)
    return _fit_flag(parts, key, features, size)


def fit_benign_thinned(
    df: DataFrame, key: str, features: list[str], size: ForestSize = ForestSize(trees=200, depth=25), seed: int = 100,
    label: str = "label",
) -> Fitted:
    """The same on a thinned benign class; the test rows come from the thinned table too."""
    return fit_benign(thin_benign(df, key, seed, label=label), key, features, size, seed, label)


def fit_benign_full(
    df: DataFrame, key: str, features: list[str], size: ForestSize = ForestSize(trees=250, depth=DEEPEST, bins=128), seed: int = 0,
    label: str = "label",
) -> Fitted:
    """The same on every column given, with a split stratified by label."""
    parts = stratified_split(df, key, {"train": 0.8, "test": 0.2}, seed, label)
    return _fit_flag(_flagged(parts, key, [*features, "split"], label), key, features, size)


def _flagged(df: DataFrame, key: str, names: list[str], label: str) -> DataFrame:
    return with_label(df, label).select(column(key), *[column(n) for n in names], as_flag(benign_flag(column(label))))


def _fit_flag(parts: DataFrame, key: str, features: list[str], size: ForestSize) -> Fitted:
    start = time.monotonic()
    train = parts.where("split = 'train'").select(*[column(f) for f in features], "flag", column(key))
    with hold(train, [key]) as held:
        table = binned(held, features, "flag", size.bins)
    model = grown(table, parts.sparkSession, {"flag": Wanted(features, [0, 1])}, size.settings())["flag"]
    return Fitted(model, parts.where("split = 'test'").drop("split"), time.monotonic() - start)


def flag_scores(fitted: Fitted) -> DataFrame:
    """``flag, prediction, rawPrediction`` of the test rows; a forest grown here gives the probability of class 1 as its raw prediction."""
    forest = stored(fitted.model)
    if forest is None:
        told = fitted.model.transform(fitted.test)
    else:
        told = scored(spread(fitted.test.select(*[column(f) for f in forest.features], "flag")), {"rawPrediction": forest})
        told = told.withColumn("prediction", (F.col("rawPrediction") > 0.5).cast("int"))
    return told.select(F.col("flag").cast("int").alias("flag"), F.col("prediction").cast("int").alias("prediction"), "rawPrediction")


# All classes at once ---------------------------------------------------------------------------


def fit_code_classifier(train: DataFrame, features: list[str], code: str, size: ForestSize = ForestSize()) -> PipelineModel:
    """A forest over all class codes."""
    return fit_classifier(train, features, code, size)[0]


def fit_one_hot(
    train: DataFrame, features: list[str], classes: list[str],
    size: ForestSize = ForestSize(trees=200, depth=DEEPEST, min_leaf=20, bins=128), label: str = "label", key: str | None = None,
) -> dict[str, PipelineModel]:
    """One regression per class on its 0/1 column, over rows that are laid out and cut into bins once."""
    known = class_names(train, label)
    forests = {c: Wanted(features, [int(k == c) for k in known]) for c in classes}
    return _fit_labelled(train, forests, label, known, key, size, regression=True, flag="target")


def score_one_hot(df: DataFrame, models: dict[str, PipelineModel], prefix: str = "score_") -> DataFrame:
    """Each class's regression output beside the rows and the class with the largest one."""
    forests = {prefix + name: stored(model) for name, model in models.items()}
    if all(forests.values()):
        df = scored(spread(df), forests)
    else:
        for name, model in models.items():
            df = model.transform(df).select(*[column(c) for c in df.columns], column("prediction").alias(prefix + name))
    scores = F.array(*[column(prefix + c) for c in models])
    names = F.array(*[F.lit(c) for c in models])
    return df.withColumn("prediction", F.element_at(names, argmax(scores) + 1))


def fit_smote_regression(
    train: DataFrame, key: str, features: list[str], classes: list[str],
    size: ForestSize = ForestSize(trees=100, depth=20, min_leaf=10, bins=128), ratio: float = 0.8, seed: int = 42,
    label: str = "label",
) -> PipelineModel:
    """Regression on the label code of an oversampled training table."""
    more = smote(train, key, features, ratio=ratio, seed=seed, label=label)
    coded = more.select(column(key), "copy", *[column(f) for f in features], code_by_list(column(label), classes).cast("double").alias("code"))
    return fit_regressor(materialise(coded, "oversampled"), features, "code", size, [key, "copy"])[0]


def fit_code_regression(
    df: DataFrame, key: str, features: list[str], code: str, size: ForestSize = ForestSize(trees=100, depth=10),
    seed: int = 0,
) -> Fitted:
    """Regression on a class code, an 85/15 split by key."""
    parts = random_split(df, [key], {"train": 0.85, "test": 0.15}, seed)
    model, seconds = fit_regressor(parts.where("split = 'train'"), features, code, size, [key])
    return Fitted(model, parts.where("split = 'test'").drop("split"), seconds)


def nearest_class(scored: DataFrame, prediction: str = "prediction", output: str = "class_code") -> DataFrame:
    """Regression output as the nearest class code."""
    return scored.withColumn(output, round_to_class(column(prediction)))


def attack_classes(df: DataFrame, label: str = "label") -> list[str]:
    return [c for c in class_names(df, label) if c != BENIGN]
