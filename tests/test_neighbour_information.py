"""Information by distances to neighbours, against comparing all rows; ties, borders, tiny classes."""

import math
import random

import pytest

from flowlens.operators import neighbour_information as ni


def psi(x):
    return -0.5772156649015329 + sum(1 / i for i in range(1, x))


def plain(rows, k):
    usable = [(x, c) for x, c in rows if c is not None and x is not None and math.isfinite(x)]
    size = {c: sum(d == c for _, d in usable) for _, c in usable}
    usable = [(x, c) for x, c in usable if size[c] > 1]
    total = 0.0
    for i, (x, c) in enumerate(usable):
        own = sorted(abs(y - x) for j, (y, d) in enumerate(usable) if d == c and j != i)
        near = min(k, size[c] - 1)
        r = own[near - 1] * (1 - ni.NEARER)
        total += psi(near) - psi(size[c]) - psi(sum(x - r <= y <= x + r for y, _ in usable))
    return max(0.0, psi(len(usable)) + total / len(usable)) if usable else 0.0


@pytest.mark.parametrize("range_rows", [13, 60, 200_000])
@pytest.mark.parametrize("k", [1, 3])
def test_scores_equal_those_of_all_pairs(spark, monkeypatch, range_rows, k):
    monkeypatch.setattr(ni, "RANGE_ROWS", range_rows)
    r = random.Random(5)
    rows = []
    for i in range(300):
        c = r.choice("aaaab")
        rows.append((c, r.gauss(2.0 * (c == "b"), 1), float(r.randrange(12)), 1.0 if i % 3 else r.random(), float(i)))
    rows += [("one", 0.1, 1.0, 1.0, 1.5), ("two", 0.1, 1.0, 1.0, -7.0), ("two", 90.0, 3.0, 2.0, 500.0), (None, 0.0, 0.0, 0.0, 0.0)]
    rows += [("a", None, math.nan, math.inf, -0.0), ("b", None, None, -math.inf, 0.0)] + [("far", 1e6 + i, 40.0 + i, -5.0, 1e3) for i in range(3)]
    df = spark.createDataFrame(rows, "label string, u double, v double, `w/s` double, t double")
    got = {x["feature"]: x["score"] for x in ni.neighbour_information(df, ["u", "v", "w/s", "t"], k=k).collect()}
    for j, name in enumerate(["u", "v", "w/s", "t"]):
        assert got[name] == pytest.approx(plain([(x[j + 1], x[0]) for x in rows], k), abs=1e-9), name


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None)], "label string, u double, v double")
    assert {(r["feature"], r["score"]) for r in ni.neighbour_information(df, ["u", "v"]).collect()} == {("u", 0.0), ("v", 0.0)}
    assert ni.neighbour_information(df.limit(0), ["u"]).first()["score"] == 0.0
