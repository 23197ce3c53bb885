"""Exact neighbours and oversampling against brute force, with hot copies and many slabs."""

import random

import numpy as np
import pytest

from flowlens.operators.near_join import ROUNDS, _Close, near_in_class, nearest_rows
from flowlens.operators.neighbours import nearest_in_class
from flowlens.operators.smote import smote


def _points(seed, n, copies):
    """Two classes on a grid (many ties); ``copies`` rows of class a are one and the same point."""
    rng = random.Random(seed)
    rows = [(i, "ab"[i % 7 == 0], float(rng.randint(0, 30)), float(rng.randint(0, 30)), 0.0) for i in range(n)]
    return rows + [(n + i, "a", 3.0, 4.0, -0.0) for i in range(copies)]


def _brute(rows, k):
    near = {}
    for i, c, *x in rows:
        d = sorted((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, other, *y in rows if other == c and j != i)
        near[i] = [j for _, j in d[:k]]
    return near


@pytest.mark.parametrize("slab_rows", [15, 60, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_equal_brute_force(spark, slab_rows, seed):
    rows = _points(seed, 260, 120)
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double, v double, w double")
    found = {(r["class"], tuple(r["x"])): [n["id"] for n in r["near"]] for r in nearest_in_class(df, "flow_id", ["u", "v", "w"], 5, slab_rows=slab_rows).collect()}
    want = _brute(rows, 5)
    for i, c, *x in rows:
        own = found[(c, tuple(v + 0.0 for v in x))]
        assert [j for j in own if j != i][:5] == want[i]


def test_one_crowded_slab_is_dealt_out(spark):
    """A feature that dwarfs the other makes almost all projections equal."""
    rng = random.Random(9)
    rows = [(i, "a", 5e7 if i % 9 else -5e7, rng.random() * 1e-9) for i in range(400)]
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double, v double")
    found = {tuple(r["x"]): [n["id"] for n in r["near"]] for r in nearest_in_class(df, "flow_id", ["u", "v"], 5, slab_rows=20).collect()}
    want = _brute(rows, 5)
    assert all([j for j in found[tuple(x)] if j != i][:5] == want[i] for i, _, *x in rows)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 1.0), (3, "b", 5.0)], "flow_id bigint, label string, u double")
    found = {tuple(r["x"]): [n["id"] for n in r["near"]] for r in nearest_in_class(df, "flow_id", ["u"], 5).collect()}
    assert found == {(0.0,): [1, 2], (1.0,): [2, 1], (5.0,): [3]}


@pytest.mark.parametrize("ratio", [0.8, 1.0])
def test_oversampling_reaches_its_target_between_neighbours(spark, ratio):
    rng = random.Random(3)
    rows = [(i, "big", rng.random(), rng.random()) for i in range(40)]
    rows += [(100 + i, "small", rng.random(), rng.random()) for i in range(8)]
    rows += [(200, "single", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double, v double")
    out = smote(df, "flow_id", ["u", "v"], ratio=ratio, k=5, seed=1).collect()
    made = [r for r in out if r["copy"] > 0]
    counts = {c: sum(r["label"] == c for r in out) for c in ("big", "small", "single")}
    target = int(ratio * 40)
    assert counts == {"big": 40, "small": target, "single": target}
    assert len({(r["flow_id"], r["copy"]) for r in out}) == len(out)
    at = {i: (u, v) for i, _, u, v in rows}
    near = _brute(rows, 5)
    for r in made:
        (u, v), p = at[r["flow_id"]], (r["u"], r["v"])
        if r["label"] == "single":
            assert p == (0.5, 0.5)
            continue
        assert any(
            abs((a - u) * (p[1] - v) - (b - v) * (p[0] - u)) < 1e-12
            and min(u, a) - 1e-12 <= p[0] <= max(u, a) + 1e-12
            for a, b in (at[j] for j in near[r["flow_id"]])
        )
    seeds = [sum(r["flow_id"] == i for r in made) for i in range(100, 108)]
    assert max(seeds) - min(seeds) <= 1


@pytest.mark.parametrize("bound", [10_000, 0])
def test_points_with_many_copies_only_repeat_themselves(spark, monkeypatch, bound):
    """Both ways of pairing, with and without the broadcast of copied points, give the same rows."""
    from flowlens.operators import smote as module

    real = module.small_side
    monkeypatch.setattr(module, "small_side", lambda df, *m: df if bound == 0 and "copied" in df.columns else real(df, *m))
    rows = [(i, "big", 0.0) for i in range(90)] + [(100 + i, "hot", 7.0) for i in range(20)] + [(130, "hot", 9.0), (131, "hot", 9.5)]
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double")
    out = smote(df, "flow_id", ["u"], k=5, seed=1).where("label = 'hot' and copy > 0").collect()
    assert len(out) == 90 - 22
    assert all(r["u"] == 7.0 for r in out if r["flow_id"] < 130)
    assert all(7.0 <= r["u"] <= 9.5 for r in out if r["flow_id"] >= 130) and any(r["u"] > 7 for r in out)


def test_one_row_raised_to_many(spark, monkeypatch):
    from flowlens.operators import smote as module

    monkeypatch.setattr(module, "_COPIES", 7)
    df = spark.range(50).selectExpr("id as flow_id", "if(id < 2, 'rare', 'big') as label", "double(id) as u")
    out = smote(df, "flow_id", ["u"], ratio=1.0, k=5, seed=1)
    assert out.where("label = 'rare'").count() == 48
    assert out.where("label = 'rare'").select("flow_id", "copy").distinct().count() == 48


def _cloud(n, width, seed, latent=5):
    """Points of few dimensions, bent into many columns of different scales, with some noise."""
    r = np.random.default_rng(seed)
    inner = r.standard_normal((n, latent))
    bent = np.concatenate([inner, np.sin(inner), inner**2], axis=1) @ r.standard_normal((3 * latent, width))
    return (bent + 0.02 * r.standard_normal((n, width))) * np.exp(r.uniform(-1, 1, width))


@pytest.mark.parametrize("width", [23, 64])
def test_wide_neighbours_reach_their_recall_with_bounded_visits(spark, width):
    x = _cloud(6000, width, width)
    names = [f"c{j}" for j in range(width)]
    labels = ["big" if i % 5 else "small" for i in range(len(x))]
    df = spark.createDataFrame([(i, labels[i], *map(float, x[i])) for i in range(len(x))], ["flow_id", "label", *names])
    found = near_in_class(df, "flow_id", names, 5, bucket_rows=256, seed=3)
    right = total = rows = 0
    at = {tuple(x[i].tolist()): i for i in range(len(x))}
    for r in found.table.collect():
        i = at[tuple(r["x"])]
        own = [j for j in range(len(x)) if labels[j] == labels[i]] if rows % 10 == 0 else None
        rows += 1
        assert r["near"][0]["id"] == i and len(r["near"]) == 6
        assert [c["d2"] for c in r["near"]] == sorted(c["d2"] for c in r["near"])
        if own is not None:
            d2 = np.sort(((x[own] - x[i]) ** 2).sum(axis=1))[5]
            right += sum(c["d2"] <= d2 * (1 + 1e-9) for c in r["near"])
            total += 6
    assert rows == len(x)
    assert right / total >= 0.9 and found.recall >= 0.95
    # buckets hold about 256 points before they double, and every point is in one for each order
    assert found.orders <= ROUNDS and found.visits <= found.orders * 2 * 256 < len(x)


def test_a_crowded_cell_is_dealt_out(spark):
    """Projections that are all but equal leave one cell for almost all points."""
    rng = random.Random(9)
    rows = [(i, "a", 5e7 if i % 9 else -5e7, rng.random() * 1e-9) for i in range(600)]
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double, v double")
    found = near_in_class(df, "flow_id", ["u", "v"], 5, bucket_rows=40)
    assert found.recall >= 0.95 and found.table.count() == 600


def test_small_classes_are_exact(spark):
    rows = _points(4, 260, 120)
    df = spark.createDataFrame(rows, "flow_id bigint, label string, u double, v double, w double")
    near = near_in_class(df, "flow_id", ["u", "v", "w"], 5)
    assert (near.recall, near.orders) == (1.0, 1)
    found = {(r["class"], tuple(r["x"])): [n["id"] for n in r["near"]] for r in near.table.collect()}
    want = _brute(rows, 5)
    for i, c, *x in rows:
        assert [j for j in found[(c, tuple(v + 0.0 for v in x))] if j != i][:5] == want[i]


def test_only_near_pairs_are_measured_and_none_is_missed():
    rng = np.random.default_rng(4)
    for scale, shift in ((1.0, 0.0), (1.0, 1e9), (1e-170, 0.0), (1e160, 0.0)):
        points = np.round(rng.uniform(0, 50, (900, 23)), 1) * scale + shift
        row, other, d2 = nearest_rows(points[:60], points, 6)
        with np.errstate(over="ignore"):
            every = sum((points[:60, j, None] - points[None, :, j]) ** 2 for j in range(23))
        order = np.lexsort((np.broadcast_to(np.arange(900), every.shape), every), axis=1)[:, :6]
        assert row.tolist() == np.repeat(np.arange(60), 6).tolist() and other.tolist() == order.ravel().tolist()
        assert np.array_equal(d2, np.take_along_axis(every, order, 1).ravel())
    measured, _ = _Close(points := rng.uniform(0, 50, (4096, 23)), 6).pairs(points[:200])
    assert len(measured) < 200 * 20


def test_orders_are_not_written_to_storage(spark, monkeypatch):
    """Of each order only what was found is kept, not the points again."""
    from flowlens.operators import near_join

    written = []
    write = near_join.materialise
    monkeypatch.setattr(near_join, "materialise", lambda df, name="table": written.append((name, df.columns)) or write(df, name))
    rng = random.Random(6)
    rows = [(i, "a", *(rng.random() for _ in range(6))) for i in range(400)]
    df = spark.createDataFrame(rows, "flow_id bigint, label string, " + ", ".join(f"x{j} double" for j in range(6)))
    found = near_in_class(df, "flow_id", [f"x{j}" for j in range(6)], 5, bucket_rows=60)
    assert found.orders > 1 and found.recall >= 0.95
    assert [name for name, columns in written if "x" in columns] == ["points"]
