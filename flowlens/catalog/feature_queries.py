"""Feature scores, selection and per-attack projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import WIDE_FEATURES, WITH_CLEAN, WITH_FLOWS, WITH_WIDE, flows, wide
from flowlens.fixed_values import ATTACK_FEATURES, WEB_ATTACK
from flowlens.functions.labels import fit_codes, merge_web_attacks, one_vs_rest
from flowlens.operators import features as f
from flowlens.operators.cleaning import clean_flows
from flowlens.operators.neighbour_information import neighbour_information
from flowlens.runtime import column
from flowlens.sources.dictionary import feature_union


def _bin(name: str, bins: int = 32) -> str:
    """Equal-width bin between the column's extremes, which the CTE r holds."""
    return f"""CAST(least(floor(("{name}" - "low {name}") / ("high {name}" - "low {name}") * {bins}.0), {bins - 1}) AS INT)"""


def _joint(table: str, names: list[str]) -> str:
    extremes = ", ".join(f'min("{n}") AS "low {n}", max("{n}") AS "high {n}"' for n in names)
    counts = " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {_bin(n)} AS bin, label, count(*) AS n FROM {table}, r GROUP BY ALL""" for n in names
    )
    return f"r AS (SELECT {extremes} FROM {table}), joint AS ({counts})"


def _information(joint: str, by: str) -> str:
    """Information in nats of bin about label inside each group of ``by``."""
    return f"""SELECT {by}, sum(n / total * ln(n * total / (in_bin * in_class))) AS score FROM (
        SELECT *, CAST(sum(n) OVER (PARTITION BY {by}) AS DOUBLE) AS total,
            CAST(sum(n) OVER (PARTITION BY {by}, bin) AS DOUBLE) AS in_bin,
            CAST(sum(n) OVER (PARTITION BY {by}, label) AS DOUBLE) AS in_class FROM {joint}) GROUP BY {by}"""


_NAMES = ["f_value", "f_k", "f_dirty"]
_WIDE_MI = f"{WITH_WIDE}, {_joint('wide', WIDE_FEATURES)}, mi AS ({_information('joint', 'feature')})"


def _wide_scores(spark, sf_dir) -> DataFrame:
    scores = f.mutual_information(f.joint_counts(wide(spark, sf_dir), WIDE_FEATURES))
    return scores.withColumn("score", F.round("score", 6))


@query(
    "mutual_information",
    f"{WITH_CLEAN}, {_joint('clean', _NAMES)} SELECT feature, round(score, 6) AS score FROM ({_information('joint', 'feature')})",
)
def mutual_information(spark, sf_dir):
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    return f.mutual_information(f.joint_counts(df, _NAMES)).withColumn("score", F.round("score", 6))


_NEIGHBOURS = 3


def _reach_sql(k: int) -> str:
    """Distance to the k-th nearest value of the class: the best of all runs of k + 1 values that hold the row's."""
    far = "CAST('inf' AS DOUBLE)"
    runs = [f"greatest(coalesce(x - lag(x, {j}) OVER w, {far}), coalesce(lead(x, {k - j}) OVER w - x, {far}))" for j in range(k + 1)]
    return f"least({', '.join(runs)})"


def _digamma_sql(x: str) -> str:
    y = f"({x} + 10.0)"
    terms = [f"ln({y})", f"- 1 / (2 * {y})", f"- 1 / (12 * {y} ** 2)", f"+ 1 / (120 * {y} ** 4)", f"- 1 / (252 * {y} ** 6)"]
    return f"({' '.join([*terms, *[f'- 1 / ({x} + {i}.0)' for i in range(10)]])})"


@query(
    "neighbour_information",
    f"""{WITH_CLEAN}, long AS (UNPIVOT (SELECT label, f_value, f_k, f_dirty FROM clean) ON f_value, f_k, f_dirty INTO NAME feature VALUE x),
    sized AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS size FROM long QUALIFY size > 1),
    near AS (SELECT feature, label, x, size, CASE {" ".join(f"WHEN size = {k + 1} THEN {_reach_sql(k)}" for k in range(1, _NEIGHBOURS))}
        ELSE {_reach_sql(_NEIGHBOURS)} END * (1 - 1e-10) AS r FROM sized WINDOW w AS (PARTITION BY feature, label ORDER BY x)),
    weights AS (SELECT feature, x AS v, count(*) AS w FROM sized GROUP BY ALL),
    asked AS (SELECT feature, size, x - r AS low, x + r AS high, count(*) AS n FROM near GROUP BY ALL),
    counted AS (SELECT asked.*, (SELECT sum(w) FROM weights WHERE weights.feature = asked.feature AND v BETWEEN low AND high) AS m FROM asked),
    sums AS (SELECT feature, sum(n) AS total, sum(n * ({_digamma_sql(f"least({_NEIGHBOURS}, size - 1)")} - {_digamma_sql("size")}
        - {_digamma_sql("m")})) AS psi FROM counted GROUP BY feature)
    SELECT feature, round(greatest(0.0, {_digamma_sql("total")} + psi / total), 6) AS score FROM sums""",
)
def neighbour_information_query(spark, sf_dir):
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    return neighbour_information(df, _NAMES, k=_NEIGHBOURS).withColumn("score", F.round("score", 6))


@query("rank_scores", f"{_WIDE_MI} SELECT feature, round(score, 6) AS score FROM mi ORDER BY round(score, 6) DESC, feature DESC")
def rank_scores(spark, sf_dir):
    return f.rank_scores(_wide_scores(spark, sf_dir))


@query("select_by_threshold", f"{_WIDE_MI} SELECT feature, round(score, 6) AS score FROM mi WHERE round(score, 6) >= 0.4")
def select_by_threshold(spark, sf_dir):
    return f.above(_wide_scores(spark, sf_dir), 0.4)


@query(
    "select_k_best",
    f"{_WIDE_MI} SELECT feature, round(score, 6) AS score FROM mi ORDER BY round(score, 6) DESC, feature DESC LIMIT 10",
)
def select_k_best(spark, sf_dir):
    return f.best(_wide_scores(spark, sf_dir), 10)


@query(
    "project_k_best",
    f"""{_WIDE_MI}, top AS (SELECT feature FROM mi ORDER BY round(score, 6) DESC, feature DESC LIMIT 10),
    long AS ({" UNION ALL ".join(f"""SELECT flow_id, label, '{n}' AS feature, CAST("{n}" AS DOUBLE) AS value FROM wide""" for n in WIDE_FEATURES)})
    SELECT flow_id, label, feature, value FROM long SEMI JOIN top USING (feature)""",
)
def project_k_best(spark, sf_dir):
    """The table's ten best columns, one line per cell."""
    df = wide(spark, sf_dir)
    kept = f.keep_best(df, _wide_scores(spark, sf_dir), 10, "flow_id", "label")
    names = [c for c in kept.columns if c not in ("flow_id", "label")]
    values = [column(n).cast("double").alias(n) for n in names]
    return kept.select("flow_id", "label", *values).unpivot(["flow_id", "label"], [column(n) for n in names], "feature", "value")


_RAW = """r AS (SELECT min(x) FILTER (isfinite(x)) AS low, max(x) FILTER (isfinite(x)) AS high FROM raw), joint AS (
    SELECT 'f_dirty' AS feature, CASE WHEN x IS NULL OR isnan(x) THEN -1 WHEN isinf(x) THEN CASE WHEN x < 0 THEN -2 ELSE -3 END
        ELSE CAST(least(floor((x - low) / (high - low) * 32.0), 31) AS INT) END AS bin, label, count(*) AS n
    FROM raw, r GROUP BY ALL)"""


@query(
    "mutual_information_raw",
    f"""{WITH_FLOWS}, raw AS (SELECT TRY_CAST(f_dirty AS DOUBLE) AS x, label FROM flows WHERE label IS NOT NULL AND label <> ' Label'),
    {_RAW} SELECT feature, round(score, 6) AS score FROM ({_information('joint', 'feature')})""",
)
def mutual_information_raw(spark, sf_dir):
    """An uncleaned column: missing, infinite and other values are bins of their own."""
    df = flows(spark, sf_dir).where("label IS NOT NULL AND label <> ' Label'")
    df = df.select("label", F.expr("try_cast(f_dirty AS double)").alias("f_dirty"))
    return f.mutual_information(f.joint_counts(df, ["f_dirty"])).withColumn("score", F.round("score", 6))


# The registry key's dictionary: per attack its three most informative features.
_DICTIONARY = f"""{WITH_WIDE}, {_joint('wide', WIDE_FEATURES)},
    attacks AS (SELECT DISTINCT label AS attack FROM wide WHERE label <> 'BENIGN'),
    flagged AS (SELECT attack, feature, bin, (joint.label = attack) AS label, CAST(sum(n) AS BIGINT) AS n
        FROM joint, attacks GROUP BY ALL),
    scored AS ({_information('flagged', 'attack, feature')}),
    top AS (SELECT attack, feature, row_number() OVER (PARTITION BY attack ORDER BY round(score, 9) DESC, feature) AS place
        FROM scored QUALIFY place <= 3)"""


def _dictionary(spark, sf_dir) -> DataFrame:
    return f.attack_dictionary(wide(spark, sf_dir), WIDE_FEATURES, 3)


@query("attack_feature_union", f"{_DICTIONARY} SELECT DISTINCT feature FROM top")
def attack_feature_union(spark, sf_dir):
    return feature_union(_dictionary(spark, sf_dir))


@query("attack_dictionary", f"{_DICTIONARY} SELECT attack, string_agg(feature, '|' ORDER BY place) AS features FROM top GROUP BY attack")
def attack_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir).select("attack", F.array_join("features", "|").alias("features"))


def _mean(names: list[str], quote: str) -> str:
    return "(" + " + ".join(f"{quote}{n}{quote}" for n in names) + f") / {len(names)}.0"


_PER_ATTACK = " UNION ALL ".join(
    f"""SELECT '{a}' AS attack, CAST(m.label = '{a}' AS INT) AS is_attack, count(*) AS n,
    round(avg({_mean(names, '"')}), 6) AS mean_features FROM m GROUP BY ALL"""
    for a, names in ATTACK_FEATURES.items()
)


@query(
    "per_attack_features",
    f"""{WITH_WIDE}, m AS (SELECT * REPLACE (CASE WHEN label LIKE 'Web Attack%' THEN '{WEB_ATTACK}' ELSE label END AS label)
    FROM wide) {_PER_ATTACK}""",
)
def per_attack_features(spark, sf_dir):
    """Every attack's own projection of the table, profiled side by side in one pass."""
    df = wide(spark, sf_dir).withColumn("label", merge_web_attacks(F.col("label")))
    views = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("attack"),
                    one_vs_rest(F.col("label"), a).alias("is_attack"),
                    F.expr(_mean(names, "`")).alias("v"),
                )
                for a, names in ATTACK_FEATURES.items()
            ]
        )
    )
    return (
        df.select(views.alias("p"))
        .groupBy("p.attack", "p.is_attack")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p.v"), 6).alias("mean_features"))
    )


def _coded(spark, sf_dir) -> DataFrame:
    df = wide(spark, sf_dir).withColumn("label", merge_web_attacks(F.col("label")))
    return fit_codes(df, "label", "code").transform(df)


_LISTED = " UNION ALL ".join(f"SELECT '{n}' AS feature" for n in WIDE_FEATURES)


@query("tree_importance", f"SELECT feature, 1 AS in_range, 1 AS sum_is_one, 1 AS informative FROM ({_LISTED})")
def tree_importance(spark, sf_dir):
    """Per feature: a share between 0 and 1, shares that sum to one, and more than one feature with weight."""
    scores = f.rank_scores(f.extra_tree_importance(_coded(spark, sf_dir), WIDE_FEATURES, "code"))
    sums = scores.agg(F.sum("score").alias("s"), F.count_if(F.col("score") > 0).alias("n")).first()
    inside = F.col("score").between(0, 1).cast("int").alias("in_range")
    return scores.select("feature", inside, F.lit(int(abs(sums["s"] - 1) < 1e-6)).alias("sum_is_one"), F.lit(int(sums["n"] > 1)).alias("informative"))


@query("pca", f"SELECT i AS component, {len(WIDE_FEATURES)} AS n_features, 1 AS unit_length, 1 AS right_angles, 1 AS falls FROM range(5) t(i)")
def pca(spark, sf_dir):
    """Per component: unit length, a right angle to the others, and a share of variance not above the one before."""
    summary = f.pca_summary(wide(spark, sf_dir), WIDE_FEATURES, 5).collect()
    vectors = [[r["loading"] for r in summary if r["component"] == c] for c in range(5)]
    shares = [next(r["explained"] for r in summary if r["component"] == c) for c in range(5)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    rows = [
        (
            c,
            len(vectors[c]),
            int(abs(dot(vectors[c], vectors[c]) - 1) < 1e-6),
            int(all(abs(dot(vectors[c], vectors[d])) < 1e-6 for d in range(5) if d != c)),
            int(0 <= shares[c] <= (shares[c - 1] if c else 1.0)),
        )
        for c in range(5)
    ]
    return spark.createDataFrame(rows, "component bigint, n_features int, unit_length int, right_angles int, falls int")


_COV = " UNION ALL ".join(
    f"""SELECT '{a}' AS first, '{b}' AS second, round(covar_samp({a}, {b}), 5) AS covariance FROM clean"""
    for i, a in enumerate(_NAMES)
    for b in _NAMES[i:]
)


@query("pca_covariance", f"{WITH_CLEAN} {_COV}")
def pca_covariance(spark, sf_dir):
    """The covariances behind the components, rebuilt from all components and their variances."""
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    model = f.fit_pca(df, _NAMES, len(_NAMES)).stages[-1]
    total = df.agg(reduce(lambda a, b: a + b, [F.var_samp(n) for n in _NAMES])).first()[0]
    loadings, ratios = model.pc.toArray(), model.explainedVariance.toArray()
    rebuilt = (loadings * (ratios * total)) @ loadings.T
    rows = [(a, b, float(rebuilt[i, j])) for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES) if i <= j]
    out = spark.createDataFrame(rows, "first string, second string, covariance double")
    return out.withColumn("covariance", F.round("covariance", 5))


@query("rfe", f"SELECT feature, {len(WIDE_FEATURES)} AS n, 18 AS n_selected, 1 AS ranks_fit FROM ({_LISTED})")
def rfe(spark, sf_dir):
    """Per feature: features, selected ones, and whether selected ones rank first and dropped ones are all apart."""
    ranked = f.eliminate(_coded(spark, sf_dir), WIDE_FEATURES, "code", keep=18, iterations=20)
    rows = [(r["feature"], r["rank"]) for r in ranked.collect()]
    ranks = sorted(k for _, k in rows)
    fits = int(ranks == [1] * 18 + list(range(2, len(rows) - 18 + 2)))
    out = [(name, len(rows), sum(k == 1 for k in ranks), fits) for name, _ in rows]
    return spark.createDataFrame(out, "feature string, n int, n_selected int, ranks_fit int")
