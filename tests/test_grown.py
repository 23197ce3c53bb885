"""Forests that are grown a tree in a task: the library's rules, its models, and tables that do not fit."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.functions import trees
from flowlens.operators import evaluation
from flowlens.plans import forests, grown
from flowlens.runtime import scratch_path
from flowlens.sources.models import load_model, save_model

NAMES = ["a", "b c", "d"]
SIZE = forests.ForestSize(trees=7, depth=6, min_leaf=2, bins=16, seed=3)


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(7).standard_normal((3000, 3))
    label = np.where(x[:, 0] + x[:, 1] * x[:, 2] > 0.8, "bad", np.where(x[:, 1] > 0, "BENIGN", "odd"))
    data = [(i, str(c), *map(float, r)) for i, (c, r) in enumerate(zip(label, x))]
    return spark.createDataFrame(data, "id bigint, label string, a double, `b c` double, d double").repartition(3)


def _plain(cells, times, rows, growth, depth):
    """(tallies, feature, border) of a tree that looks at all features, node by node in Python; None for a leaf."""
    tally = [sum(int(times[r]) for r in rows if cells[0][r] % 2 == c) for c in (0, 1)]
    best, weights, n = None, growth.weights, sum(tally)

    def impure(t):
        w = [t[0] * weights[0], t[1] * weights[1]]
        return w[0] * w[1] / sum(w) if sum(w) else 0.0

    for f in range(len(cells)):
        for border in range(growth.bins - 1):
            left = [sum(int(times[r]) for r in rows if cells[f][r] % 2 == c and cells[f][r] // 2 <= border) for c in (0, 1)]
            right = [tally[0] - left[0], tally[1] - left[1]]
            if min(sum(left), sum(right)) >= growth.min_leaf:
                rest = impure(left) + impure(right)
                if best is None or rest < best[0] - 1e-12:
                    best = rest, f, border
    if best is None or depth == growth.depth or n < 2 or best[0] > impure(tally) * (1 - 1e-12) or min(tally) == 0:
        return tally, None
    parts = [[r for r in rows if (cells[best[1]][r] // 2 <= best[2]) == side] for side in (True, False)]
    children = [_plain(cells, times, p, growth, depth + 1) for p in parts]
    says = [t[1] * weights[1] > t[0] * weights[0] for t, _ in children]
    if all(c[1] is None for c in children) and says[0] == says[1]:
        return tally, None
    return tally, (best[1], best[2], *children)


def _nested(nodes, at=0):
    tally = nodes["tallies"][at].astype(int).tolist()
    if nodes["left"][at] < 0:
        return tally, None
    return tally, (int(nodes["feature"][at]), int(nodes["border"][at]), _nested(nodes, nodes["left"][at]), _nested(nodes, nodes["right"][at]))


def _cells(seed, rows=250, bins=6):
    x = np.random.default_rng(seed).integers(0, bins, (3, rows))
    flag = (x[0] + x[1] * (x[2] > 2) + np.random.default_rng(seed + 9).integers(0, 3, rows) > bins).astype(int)
    return (2 * x + flag).astype(np.uint8)


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.6, 3.0)])
@pytest.mark.parametrize("chunk", [1 << 17, 20])
def test_tree_is_the_one_of_a_plain_search(monkeypatch, weights, chunk):
    monkeypatch.setattr(trees, "_ROWS_AT_ONCE", chunk)
    for seed in range(4):
        cells = _cells(seed)
        growth = trees.Growth(6, 3, 3, 5, 3, weights)
        times = trees.bag(cells.shape[1], (seed, 1))
        tree = trees.grow_held(cells, times, growth, np.random.default_rng(0))
        want = _plain(cells.tolist(), times, np.flatnonzero(times).tolist(), growth, 0)
        # of equally good splits either search may take its own; the tallies of the children tell whether they differ in worth
        assert _worth(_nested(tree), weights) == pytest.approx(_worth(want, weights), abs=0.03)
        assert _nested(tree)[0] == want[0]


def _worth(node, weights):
    """Share of wrong weight in the leaves."""
    def leaves(n):
        return [n[0]] if n[1] is None else leaves(n[1][2]) + leaves(n[1][3])

    told = [(t[0] * weights[0], t[1] * weights[1]) for t in leaves(node)]
    return sum(min(t) for t in told) / sum(map(sum, told))


def test_tree_over_blocks_that_do_not_fit_is_as_good_and_whole():
    cells = _cells(5, 4000)
    growth = trees.Growth(6, 3, 3, 8, 3)
    parts = np.array_split(cells, 7, axis=1)
    rows = [p.shape[1] for p in parts]
    one, = trees.grow_trees(lambda: iter(parts), rows, growth, [(1, 2)], 10**6)
    for held in (3000, 700, 40):
        other, = trees.grow_trees(lambda: iter(parts), rows, growth, [(1, 2)], held)
        assert _nested(other) == _nested(one)  # all features take part, so nothing is drawn but the rows


def test_borders_lie_between_all_values_if_they_are_few_and_share_the_rows_if_not():
    few = grown.borders_of(np.array([0.0, 1.0, 5.0]), np.array([1, 10_000, 1]), True, 4)
    assert few.tolist() == [0.5, 3.0]
    many = grown.borders_of(np.arange(1000.0), np.ones(1000, int), False, 5)
    assert many.tolist() == [199.5, 399.5, 599.5, 799.5]
    assert grown.borders_of(np.array([7.0]), np.array([3]), True, 4).tolist() == []
    huge = grown.borders_of(np.array([-np.inf, -1e308, 1e308, np.inf]), np.ones(4, int), True, 4)
    assert huge[0] == -np.inf and -1e308 <= huge[1] < 1e308 and 1e308 <= huge[2] < np.inf


def test_forest_is_a_model_of_the_library(spark, rows):
    """The scores over stored trees are those of the library's model, before and after it is saved."""
    models = forests.fit_weighted_attacks(rows, {"bad": NAMES, "odd": ["b c", "d"]}, SIZE, key="id")
    assert models["bad"].stages[-1].getNumTrees == 7 and models["bad"].stages[-1].getOrDefault("maxDepth") == 6
    quick = {r["id"]: (r["bad"], r["odd"]) for r in forests.positive_probability(rows, models).collect()}
    again = {n: load_model(save_model(m, scratch_path(spark, "model"))) for n, m in models.items()}
    for same in (again, {n: _own(m) for n, m in models.items()}):
        told = {r["id"]: (r["bad"], r["odd"]) for r in forests.positive_probability(rows, same).collect()}
        assert len(told) == len(quick) and all(quick[i] == pytest.approx(told[i], abs=1e-12) for i in told)


def _own(model):
    """The same without its note where the trees lie."""
    model.stages[-1].totalNumNodes  # Java holds the trees from here on
    del model.stages[-1].stored
    return model


def test_one_hot_scores_are_the_library_s(rows):
    models = forests.fit_one_hot(rows, NAMES, ["bad", "odd"], SIZE, key="id")
    quick = {r["id"]: r for r in forests.score_one_hot(rows, models).collect()}
    told = forests.score_one_hot(rows, {n: _own(m) for n, m in models.items()}).collect()
    for r in told:
        assert [quick[r["id"]][c] for c in ("score_bad", "score_odd")] == pytest.approx([r["score_bad"], r["score_odd"]], abs=1e-12)


def test_scores_of_a_benign_model_are_the_library_s(rows):
    fitted = forests.fit_benign(rows, "id", NAMES, SIZE)
    assert fitted.seconds > 0
    quick, told = (forests.flag_scores(f) for f in (fitted, forests.Fitted(_own(forests.fit_benign(rows, "id", NAMES, SIZE).model), fitted.test, 0.0)))
    assert quick.dtypes[2] == ("rawPrediction", "double") and told.dtypes[2] == ("rawPrediction", "vector")
    assert evaluation.auc_of(quick) == pytest.approx(evaluation.auc_of(told), abs=1e-9)
    assert evaluation.report(quick, "flag", "prediction").orderBy("class").collect() == evaluation.report(told, "flag", "prediction").orderBy("class").collect()


def test_forest_is_as_good_as_the_library_s(rows):
    size = forests.ForestSize(trees=30, depth=10, min_leaf=3, bins=32)
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    flagged = [t.withColumn("flag", forests.as_flag((F.col("label") == "bad").cast("int"))) for t in (train, test)]
    library, _ = forests.fit_classifier(flagged[0], NAMES, "flag", size, keys=["id"])
    right = []
    for model in (library, forests.fit_weighted_attacks(train, {"bad": NAMES}, size, key="id")["bad"]):
        told = model.transform(flagged[1]).select("flag", vector_to_array("probability")[1].alias("p"))
        right.append(told.agg(F.avg(((F.col("p") > 0.5) == (F.col("flag") == 1)).cast("int"))).first()[0])
    assert right[1] > right[0] - 0.03 and right[1] > 0.88


def test_layout_does_not_change_a_forest(rows):
    told = []
    for n in (1, 5):
        models = forests.fit_weighted_attacks(rows.repartition(n), {"bad": NAMES}, SIZE, key="id")
        told.append({r["id"]: r["bad"] for r in forests.positive_probability(rows, models).collect()})
    assert told[0] == told[1]


def test_fits_start_few_jobs_whatever_the_depth(spark, rows):
    """The library starts a job for each level of each forest."""
    spark.sparkContext.setJobGroup("grown", "")
    try:
        held = forests.fit_weighted_attacks(rows, {"bad": NAMES}, forests.ForestSize(trees=5, depth=25, bins=16), key="id")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("grown")
        assert held["bad"].stages[-1].totalNumNodes > 100
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 15


def test_missing_numbers_and_labels_are_errors(spark, rows):
    for bad in (rows.withColumn("d", F.when(F.col("id") != 5, F.col("d"))), rows.withColumn("d", F.when(F.col("id") != 5, F.col("d")).otherwise(F.lit(float("nan")))), rows.withColumn("label", F.when(F.col("id") != 5, F.col("label")))):
        with pytest.raises(Exception, match="missing value"):
            forests.fit_weighted_attacks(bad, {"bad": NAMES}, SIZE, key="id")
