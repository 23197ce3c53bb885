"""Feature scores and selection."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.fixed_values import BENIGN
from flowlens.functions.labels import class_names
from flowlens.runtime import bounded_rows, column, side_by_side


def label_means(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """``label, feature, score``: the mean of every feature in every class."""
    means = df.groupBy(column(label)).agg(*[F.avg(column(f)).alias(f) for f in features])
    return means.unpivot([label], features, "feature", "score")


def joint_counts(
    df: DataFrame, features: list[str], label: str = "label", bins: int = 32, by_rank: bool = False
) -> DataFrame:
    """``feature, bin, label, n`` over bins of equal width, or of about equal frequency with ``by_rank``.

    Bins by rank suit heavy-tailed features, of which equal widths see little but the tail.
    One pass finds the borders of all features, one counts them together: rows are unpivoted
    inside each task and counted before the shuffle, so what is shuffled is bounded by
    features x bins x classes. A missing value is a bin of its own, -1, and so are minus and plus
    infinity, -2 and -3: they take no part in the borders of the others.
    """
    binned = _rank_bins(df, features, label, bins) if by_rank else _width_bins(df, features, label, bins)
    long = binned.unpivot(["label"], [column(f) for f in features], "feature", "bin")
    return long.groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("n"))


def _odd_bin(feature: str) -> Column:
    """The bin of a value that is no number, null for one that is."""
    x = column(feature).cast("double")
    infinite = F.when(x == float("-inf"), F.lit(-2)).when(x == float("inf"), F.lit(-3))
    return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(infinite)


def _finite(feature: str) -> Column:
    return F.when(_odd_bin(feature).isNull(), column(feature).cast("double"))


def _rank_bins(df: DataFrame, features: list[str], label: str, bins: int) -> DataFrame:
    usable = [_finite(f) for f in features]
    grid = [i / bins for i in range(1, bins)]
    borders = df.agg(*[F.percentile_approx(u, grid, 10_000).alias(f"b{i}") for i, u in enumerate(usable)]).first()
    infinite = float("inf")
    splits = [[-infinite, *sorted({b for b in (borders[i] or [0.0]) if abs(b) != infinite} or {0.0}), infinite] for i in range(len(features))]
    named = df.select(
        column(label).alias("label"),
        *[u.alias(f"x{i}") for i, u in enumerate(usable)],
        *[_odd_bin(f).alias(f"odd{i}") for i, f in enumerate(features)],
    )
    cut = Bucketizer(
        splitsArray=splits,
        inputCols=[f"x{i}" for i in range(len(features))],
        outputCols=[f"bin{i}" for i in range(len(features))],
        handleInvalid="keep",
    ).transform(named)
    found = [F.coalesce(F.col(f"odd{i}"), F.col(f"bin{i}")).cast("int").alias(f) for i, f in enumerate(features)]
    return cut.select("label", *found)


def _width_bins(df: DataFrame, features: list[str], label: str, bins: int) -> DataFrame:
    spec = []
    for i, f in enumerate(features):
        usable = _finite(f)
        spec += [F.min(usable).alias(f"low{i}"), F.max(usable).alias(f"high{i}")]
    extremes = df.agg(*spec).first()

    def bin_of(i: int, f: str):
        low, high = extremes[f"low{i}"], extremes[f"high{i}"]
        x = column(f).cast("double")
        if low is None or low == high:
            place = F.lit(0)
        else:
            place = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1))
        return F.coalesce(_odd_bin(f), place).cast("int").alias(f)

    return df.select(column(label).alias("label"), *[bin_of(i, f) for i, f in enumerate(features)])


def mutual_information(joint: DataFrame, *by: str) -> DataFrame:
    """``feature, score`` in nats from a joint-count table (per group of ``by`` too, if given)."""
    group = [*by, "feature"]

    def total(*names: str):
        return F.sum("n").over(Window.partitionBy(*group, *names))

    terms = joint.select(
        *group, "n", total().alias("all"), total("bin").alias("in_bin"), total("label").alias("in_class")
    )
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("in_bin") * F.col("in_class")))
    return terms.groupBy(*group).agg(F.sum(term).alias("score"))


def attack_scores(joint: DataFrame, attacks: list[str]) -> DataFrame:
    """``attack, feature, score``: information each feature gives about one attack versus the rest."""
    each = joint.withColumn("attack", F.explode(F.array(*[F.lit(a) for a in attacks])))
    flagged = each.groupBy("attack", "feature", "bin", (F.col("label") == F.col("attack")).alias("label")).agg(
        F.sum("n").alias("n")
    )
    return mutual_information(flagged, "attack")


def attack_dictionary(df: DataFrame, features: list[str], top: int = 4, label: str = "label") -> DataFrame:
    """``attack, features``: the ``top`` most informative features of every attack, best first."""
    attacks = [c for c in class_names(df, label) if c != BENIGN]
    scores = attack_scores(joint_counts(df, features, label), attacks).withColumn("score", F.round("score", 9))
    best = Window.partitionBy("attack").orderBy(F.desc("score"), "feature")
    ranked = scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "feature"))), lambda s: s["feature"])
    return ranked.groupBy("attack").agg(listed.alias("features"))


def rank_scores(scores: DataFrame) -> DataFrame:
    """Best score first; equal scores by falling feature name."""
    return scores.orderBy(F.desc("score"), F.desc("feature"))


def above(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features with at least the threshold."""
    return scores.where(F.col("score") >= F.lit(threshold))


def best(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best features (ties by name)."""
    return rank_scores(scores).limit(k)


def keep_best(df: DataFrame, scores: DataFrame, k: int, *others: str) -> DataFrame:
    """The table's ``k`` best-scored columns in table order, then the other columns asked for."""
    chosen = {r["feature"] for r in bounded_rows(best(scores, k), k, "features")}
    return df.select(*[column(c) for c in df.columns if c in chosen], *[column(c) for c in others])


def assembler(features: list[str], output: str = "features") -> VectorAssembler:
    """Features into one vector, by name; a missing value is an error, not a dropped row."""
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="error")


def tree_importance(
    df: DataFrame, features: list[str], code: str, trees: int = 10, depth: int = 10, seed: int = 1
) -> DataFrame:
    """``feature, score`` from a forest grown on all rows with random feature subsets."""
    forest = RandomForestClassifier(
        labelCol=code, featuresCol="features", numTrees=trees, maxDepth=depth, bootstrap=False,
        featureSubsetStrategy="sqrt", seed=seed,
    )
    held = df.select(column(code), *[column(f) for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = Pipeline(stages=[assembler(features), forest]).fit(held).stages[-1]
    finally:
        held.unpersist()
    rows = list(zip(features, [float(v) for v in model.featureImportances.toArray()]))
    return df.sparkSession.createDataFrame(rows, "feature string, score double")


def extra_tree_importance(
    df: DataFrame, features: list[str], code: str, trees: int = 10, depth: int = 10, borders: int = 16, seed: int = 1
) -> DataFrame:
    """``feature, score`` from extremely random trees: the mean of the trees' shares of importance.

    Each tree may split a feature only at ``borders`` places of its own, drawn evenly between the feature's smallest and
    largest value, and looks at a random subset of the features in each node; all rows take part in every tree. One pass
    finds the extremes. The rows are held once for all trees; a tree reads its features as the numbers of
    the borders below them. A missing or infinite value is an error.
    """
    x = [column(f).cast("double") for f in features]
    held = df.select(column(code).alias("code"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).persist(StorageLevel.MEMORY_AND_DISK)
    places = [f"x{i}" for i in range(len(features))]

    def grow(tree: int, low: list[float], high: list[float]) -> list[float]:
        drawn = np.random.default_rng([seed, tree]).uniform(size=(len(features), borders))
        inner = [sorted({float(a + (b - a) * u) for u in row}) for a, b, row in zip(low, high, drawn)]
        cut = Bucketizer(
            splitsArray=[[-float("inf"), *b, float("inf")] for b in inner], inputCols=places, outputCols=[f"b{i}" for i in range(len(features))]
        )
        forest = RandomForestClassifier(
            labelCol="code", featuresCol="features", numTrees=1, maxDepth=depth, bootstrap=False, featureSubsetStrategy="sqrt",
            maxBins=max(32, borders + 1), seed=seed + tree,
        )
        model = Pipeline(stages=[cut, assembler([f"b{i}" for i in range(len(features))]), forest]).fit(held)
        return model.stages[-1].featureImportances.toArray().tolist()

    try:
        ends = held.agg(*[F.min(p) for p in places], *[F.max(p) for p in places]).first()
        low, high = list(ends[: len(features)]), list(ends[len(features) :])
        if any(v is None for v in low):
            raise ValueError("no rows to learn from, or a feature without a value")
        shares = side_by_side(df.sparkSession, {t: (lambda t=t: grow(t, low, high)) for t in range(trees)})
    finally:
        held.unpersist()
    rows = [(f, float(np.mean([shares[t][i] for t in range(trees)]))) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, score double")


def fit_pca(df: DataFrame, features: list[str], k: int = 5, scale: bool = False):
    """A fitted pipeline: assemble, centre (and scale on request), project on ``k`` components.

    Only the features x features covariance reaches the driver.
    """
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=scale)
    pca = PCA(k=k, inputCol="centred", outputCol="components")
    return Pipeline(stages=[assembler(features), scaler, pca]).fit(df)


def pca_summary(df: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """``component, explained, feature, loading``: variance ratios and the component matrix."""
    model = fit_pca(df, features, k).stages[-1]
    loadings, ratios = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [
        (c, float(ratios[c]), f, float(loadings[j, c])) for c in range(k) for j, f in enumerate(features)
    ]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, feature string, loading double")


def eliminate(
    df: DataFrame, features: list[str], code: str, keep: int = 50, step: int = 1, iterations: int = 50
) -> DataFrame:
    """``feature, rank, selected``: recursive elimination by logistic regression.

    Each round refits on the features left and drops the ``step`` with the smallest sum of
    squared coefficients over the classes. The table is held for the whole of it.
    """
    held = df.select(column(code), *[column(f) for f in features]).persist(StorageLevel.MEMORY_AND_DISK)
    left, dropped = list(features), []
    try:
        while len(left) > keep:
            regression = LogisticRegression(
                labelCol=code, featuresCol="features", maxIter=iterations, standardization=False
            )
            model = Pipeline(stages=[assembler(left), regression]).fit(held)
            weight = (model.stages[-1].coefficientMatrix.toArray() ** 2).sum(axis=0)
            worst = sorted(range(len(left)), key=lambda j: (weight[j], left[j]))[: min(step, len(left) - keep)]
            dropped.append([left[j] for j in worst])
            left = [f for j, f in enumerate(left) if j not in set(worst)]
    finally:
        held.unpersist()
    ranks = {f: 1 for f in left}
    for distance, names in enumerate(reversed(dropped), start=2):
        ranks.update({f: distance for f in names})
    rows = [(f, ranks[f], int(ranks[f] == 1)) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, selected int")
