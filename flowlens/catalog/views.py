"""Stand-in flow tables over the given test tables.

A view is a list of (expression, name) pairs that Spark SQL and DuckDB both evaluate, so the
same definition feeds a query and the SQL it is checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.fixed_values import ATTACK_FEATURES, BENIGN_FEATURES

FLOWS = [
    ("event_id", "flow_id"),
    ("user_id", "src_id"),
    ("value", "f_value"),
    ("CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)", "f_k"),
    (
        "CASE WHEN event_id%97=0 THEN 'Infinity' WHEN event_id%101=0 THEN 'NaN'"
        " WHEN event_id%103=0 THEN NULL WHEN event_id%107=0 THEN 'Flow Bytes/s'"
        " ELSE CAST(CAST(event_id%1000 AS INT) AS STRING) END",
        "f_dirty",
    ),
    (
        "CASE WHEN event_id%109=0 THEN ' Label' WHEN event_id%113=0 THEN NULL"
        " WHEN value<100 THEN 'BENIGN' WHEN value<150 THEN 'DoS Hulk'"
        " WHEN value<200 THEN 'PortScan' WHEN value<230 THEN 'Web Attack - XSS'"
        " WHEN value<260 THEN 'Web Attack - Brute Force' ELSE 'Bot' END",
        "label",
    ),
]

WIDE_FEATURES = list(dict.fromkeys(f for fs in [*ATTACK_FEATURES.values(), BENIGN_FEATURES] for f in fs))

# Bands of `value`, ten wide from 100 up, one attack each.
_BANDS = [
    "DoS Hulk", "PortScan", "DDoS", "DoS GoldenEye", "FTP-Patator", "SSH-Patator", "DoS slowloris",
    "DoS Slowhttptest", "Bot", "Web Attack - Brute Force", "Web Attack - XSS", "Infiltration",
    "Web Attack - Sql Injection",
]


def _wide_feature(j: int) -> str:
    """Signal of strength 1 to 3 plus noise whose width grows with the column's position."""
    return f"value * {1 + j % 3}.0 + (event_id * {7 + 2 * j}) % {5 + 3 * j}"


WIDE = [
    ("event_id", "flow_id"),
    *[(_wide_feature(j), name) for j, name in enumerate(WIDE_FEATURES)],
    (dict((n, e) for e, n in FLOWS)["f_dirty"], "Flow Bytes/s"),
    (
        "CASE WHEN value<100 THEN 'BENIGN'"
        + "".join(f" WHEN value<{110 + 10 * i} THEN '{name}'" for i, name in enumerate(_BANDS))
        + " ELSE 'Heartbleed' END",
        "label",
    ),
]

ITEMS = [
    ("l_quantity", "l_quantity"),
    ("l_extendedprice", "l_extendedprice"),
    ("l_discount", "l_discount"),
    ("l_tax", "l_tax"),
    ("l_returnflag", "label"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, table: str, spec: list[tuple[str, str]]) -> DataFrame:
    return _table(spark, sf_dir, table).selectExpr(*[f"{e} AS `{n}`" for e, n in spec])


def _sql(table: str, spec: list[tuple[str, str]]) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for e, n in spec) + f" FROM {table}"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow, imbalanced, dirty table with a key."""
    return _view(spark, sf_dir, "events", FLOWS)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature columns the attack dictionary names, fifteen classes."""
    return _view(spark, sf_dir, "events", WIDE)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers and an even three-class label, no key, many rows."""
    return _view(spark, sf_dir, "lineitem", ITEMS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, array of numbers, class."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


FLOWS_SQL = _sql("events", FLOWS)
WIDE_SQL = _sql("events", WIDE)
ITEMS_SQL = _sql("lineitem", ITEMS)
WITH_FLOWS = f"WITH flows AS ({FLOWS_SQL})"
WITH_WIDE = f"WITH wide AS ({WIDE_SQL})"
WITH_ITEMS = f"WITH items AS ({ITEMS_SQL})"
# Labelled, castable, gap-free flows: what operators.cleaning.clean_flows makes of the view.
WITH_CLEAN = f"""{WITH_FLOWS}, clean AS (
    SELECT flow_id, src_id, f_value, f_k,
        CASE WHEN d IS NULL OR isnan(d) OR isinf(d) THEN 0.0 ELSE d END AS f_dirty, label
    FROM (SELECT *, TRY_CAST(flows.f_dirty AS DOUBLE) AS d FROM flows)
    WHERE label IS NOT NULL AND label <> ' Label')"""
