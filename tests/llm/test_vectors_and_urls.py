"""Near-duplicate vectors and URL rules against plain versions."""

import math

import brute
import numpy as np
import pytest
from compare import connect, differences

from flowlens.llm import near_vectors, url_rules
from flowlens.llm.queries import ORACLES, QUERIES


def _links(rows, threshold=0.95):
    usable = [v if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for v in rows]
    out = []
    for b, y in enumerate(usable):
        for a, x in enumerate(usable[:b]):
            if x and y and len(x) == len(y):
                x, z = np.array(x, dtype=float), np.array(y, dtype=float)
                if x @ z / math.sqrt((x @ x) * (z @ z)) >= threshold:
                    out.append((a, b))
    return out


def _check(spark, rows, kind="float"):
    df = brute.clash(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int"))
    want = brute.groups_by_links([r[0] for r in rows], _links([r[1] for r in rows]))
    usable = [bool(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    want = [w if u else (w[0], w[0], 0) for w, u in zip(want, usable)]
    got = near_vectors.near_vectors(df).collect()
    assert sorted(map(str, [(r["vec_id"], r["component_id"], r["n_links"]) for r in got])) == sorted(map(str, want))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_awkward_vectors(spark):
    r = np.random.default_rng(3)
    base = [float(x) for x in np.float32(r.standard_normal(16))]
    near = [x * 1.01 + 0.01 for x in base]
    near = [float(np.float32(x)) for x in near]
    rows = [
        (5, base, 1),
        (3, base, 2),
        (9, [2 * x for x in base], None),
        (4, near, 1),
        (4, near, 1),
        (None, base, 1),
        (11, None, 1),
        (12, [0.0] * 16, 1),
        (13, [float("nan")] + base[1:], 1),
        (14, [float("inf")] + base[1:], 1),
        (15, [None] + base[1:], 1),
        (16, [], 1),
        (17, base[:8], 1),
        (None, None, None),
    ]
    _check(spark, rows)
    _check(spark, rows[:0])


def test_many_vectors_with_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 128)
    monkeypatch.setattr(near_vectors, "ROWS", 64)
    r = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = r.standard_normal(32)
        for _ in range(1 if c < 40 else 15):
            rows.append((len(rows), [float(x) for x in centre + 0.16 * r.standard_normal(32)], 0))
    dense = r.standard_normal(32)
    rows += [(len(rows) + k, [float(x) for x in dense + 0.1 * r.standard_normal(32)], 0) for k in range(200)]
    _check(spark, rows, "double")


def test_given_vectors_equal_all_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet").collect()
    want = brute.groups_by_links([r["vec_id"] for r in table], [])
    x = np.array([r["embedding"] for r in table], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    links = [(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.95) if a < b]
    want = brute.groups_by_links([r["vec_id"] for r in table], links)
    got = QUERIES["op9_embedding_near_dedup"](spark, sf_dir.replace("0.001", "0.1")).collect()
    assert sorted((r["vec_id"], r["component_id"], r["n_links"]) for r in got) == sorted(want)


def test_number_of_lists_reaches_the_recall():
    for n in (100, 10_000, 10_000_000):
        signs, lists = near_vectors.plan_lists(n, 0.95)
        p = (1 - math.acos(0.95) / math.pi) ** signs * math.erf(near_vectors.WINDOW / math.sqrt(2))
        assert 1 - (1 - p) ** lists - lists * p * (1 - p) ** (lists - 1) >= near_vectors.RECALL


# URLs


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, key):
    assert differences(QUERIES[key](spark, sf_dir), connect(sf_dir), ORACLES[key]) == []


def _judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    rest = rest[end:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p if "/" in rule else p):
            fits.append((-len(rule), rule, verdict))
    return (host, path, *(min(fits)[1:] if fits else (None, "allow")))


def test_nested_rules_and_awkward_urls(spark):
    rules = [("net/", "block"), ("b.net/", "allow"), ("a.b.net/x/", "block"), ("net/x/y/z/long", "allow"), ("com", "block"), ("c.com/q", "allow"), ("a,b.net/x/", "block"), ("net,/", "block")]
    hosts = ["net", "b.net", "a.b.net", "xa.b.net", "ab.net", "B.NET", "com", "d.c.com", "e.f", "", "net.", ".net", "b-net", "é.net"]
    hosts += ["net,evil", "foo.net,b", "foo.net,b,", "c.com,q", ",net", "a,b.net", "b.net.", "net:80", "b.net:80", "x,y.b.net", "net,"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/1", "/x/y/z/longer?a=://b/", "?q", "#f/x/", "/q#://")]
    urls += [None, "", "no scheme", "://", "a://b://c.net/x/", "http:///path"] + ["https://w.a.b.net/x/same"] * 300
    rows = [(i % 350 or None, u) for i, u in enumerate(urls)]
    pages = brute.clash(spark.createDataFrame(rows, "page_id bigint, url string"))
    known = spark.createDataFrame([*rules, ("net/", "block"), (None, "block"), ("x.y/", None)], "rule string, verdict string")
    want = sorted(str((i, *_judge(u, rules))) for i, u in rows)
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = url_rules.judge_urls(pages.repartition(3), known).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in got) == want


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_rules.judge_urls(pages, none).first()["verdict"] == "allow"
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0
