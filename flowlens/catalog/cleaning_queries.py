"""Cleaning operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import FLOWS_SQL, WITH_FLOWS, WITH_ITEMS, flows, items
from flowlens.functions.labels import benign_flag
from flowlens.operators import cleaning as c
from flowlens.operators.align import append_columns

_ATTACKS = ["DoS Hulk", "PortScan", "Bot"]
_NUMBER = "TRY_CAST(f_dirty AS DOUBLE)"


@query("rename_label", FLOWS_SQL)
def rename_label(spark, sf_dir):
    raw = flows(spark, sf_dir).withColumnsRenamed({"label": " label", "f_value": "  f_value "})
    return c.trim_headers(raw)


@query("drop_columns", f"{WITH_FLOWS} SELECT flow_id, f_value, f_k, label FROM flows")
def drop_columns(spark, sf_dir):
    return c.drop_columns(flows(spark, sf_dir), "src_id", "f_dirty", "External IP")


@query("filter_label_notnull", f"{WITH_FLOWS} SELECT * FROM flows WHERE label IS NOT NULL")
def filter_label_notnull(spark, sf_dir):
    return c.with_label(flows(spark, sf_dir))


@query("filter_header_rows", f"{WITH_FLOWS} SELECT * FROM flows WHERE label <> ' Label'")
def filter_header_rows(spark, sf_dir):
    return c.without_header_rows(flows(spark, sf_dir))


@query("filter_benign_out", f"{WITH_FLOWS} SELECT flow_id, label FROM flows WHERE label IS NOT NULL AND label <> 'BENIGN'")
def filter_benign_out(spark, sf_dir):
    return c.without_benign(flows(spark, sf_dir)).select("flow_id", "label")


@query(
    "filter_attacks_in",
    f"{WITH_FLOWS} SELECT flow_id, f_value, label FROM flows WHERE label IN ('DoS Hulk', 'PortScan', 'Bot')",
)
def filter_attacks_in(spark, sf_dir):
    return c.only_labels(flows(spark, sf_dir), _ATTACKS).select("flow_id", "f_value", "label")


@query("project_features", f"{WITH_FLOWS} SELECT f_value, f_k, label FROM flows")
def project_features(spark, sf_dir):
    return c.project_features(flows(spark, sf_dir), ["f_k", "f_value", "f_k", "not_there"], "label")


@query("project_column_range", f"{WITH_FLOWS} SELECT flow_id, src_id, f_value, f_k FROM flows")
def project_column_range(spark, sf_dir):
    return c.project_through(flows(spark, sf_dir), "f_k")


@query("cast_numeric", f"{WITH_FLOWS} SELECT flow_id, {_NUMBER} AS f_dirty FROM flows")
def cast_numeric(spark, sf_dir):
    return c.cast_numeric(flows(spark, sf_dir).select("flow_id", "f_dirty"), ["f_dirty"])


@query("drop_by_dtype", f"{WITH_FLOWS} SELECT flow_id, src_id, f_value, f_k FROM flows")
def drop_by_dtype(spark, sf_dir):
    return c.drop_non_numeric(flows(spark, sf_dir))


@query(
    "fill_missing",
    f"""{WITH_FLOWS} SELECT flow_id,
        CASE WHEN {_NUMBER} IS NULL OR isnan({_NUMBER}) OR isinf({_NUMBER}) THEN 0.0 ELSE {_NUMBER} END AS f_dirty
    FROM flows""",
)
def fill_missing(spark, sf_dir):
    return c.fill_missing(cast_numeric(spark, sf_dir), ["f_dirty"])


@query(
    "drop_missing",
    f"""{WITH_FLOWS} SELECT flow_id, {_NUMBER} AS f_dirty, label FROM flows
    WHERE {_NUMBER} IS NOT NULL AND NOT isnan({_NUMBER}) AND label IS NOT NULL""",
)
def drop_missing(spark, sf_dir):
    return c.drop_missing(c.cast_numeric(flows(spark, sf_dir).select("flow_id", "f_dirty", "label"), ["f_dirty"]))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) FILTER (WHERE {p}) AS n_missing FROM flows"
    for n, p in [
        ("flow_id", "flow_id IS NULL"),
        ("src_id", "src_id IS NULL"),
        ("f_value", "f_value IS NULL OR isnan(f_value)"),
        ("f_k", "f_k IS NULL OR isnan(f_k)"),
        ("f_dirty", f"{_NUMBER} IS NULL OR isnan({_NUMBER})"),
        ("label", "label IS NULL"),
    ]
)


@query("missing_report", f"{WITH_FLOWS} {_MISSING_SQL}")
def missing_report(spark, sf_dir):
    return c.missing_report(c.cast_numeric(flows(spark, sf_dir), ["f_dirty"]))


@query(
    "rows_with_missing",
    f"""{WITH_FLOWS} SELECT flow_id, f_value, label FROM flows
    WHERE {_NUMBER} IS NULL OR isnan({_NUMBER}) OR label IS NULL""",
)
def rows_with_missing(spark, sf_dir):
    df = c.cast_numeric(flows(spark, sf_dir), ["f_dirty"])
    return c.rows_with_missing(df, ["f_dirty", "label"]).select("flow_id", "f_value", "label")


@query("head_rows", f"{WITH_FLOWS} SELECT flow_id, f_value, label FROM flows ORDER BY flow_id LIMIT 1000")
def head_rows(spark, sf_dir):
    return c.head_rows(flows(spark, sf_dir).select("flow_id", "f_value", "label"), 1000, "flow_id")


@query(
    "append_columns",
    f"""{WITH_FLOWS} SELECT flow_id, f_value, label,
    CASE WHEN label IS NULL THEN -1 WHEN label = 'BENIGN' THEN 1 ELSE 0 END AS benign FROM flows""",
)
def append_columns_query(spark, sf_dir):
    df = flows(spark, sf_dir)
    codes = df.select("flow_id", "label", F.coalesce(benign_flag(F.col("label")), F.lit(-1)).alias("benign"))
    return append_columns(df.select("flow_id", "f_value"), codes, "flow_id")


@query(
    "clean_flows",
    f"""{WITH_FLOWS} SELECT label, count(*) AS n, round(sum(f_value), 4) AS sum_value, round(sum(
        CASE WHEN {_NUMBER} IS NULL OR isnan({_NUMBER}) OR isinf({_NUMBER}) THEN 0.0 ELSE {_NUMBER} END), 4) AS sum_dirty
    FROM flows WHERE label IS NOT NULL AND label <> ' Label' GROUP BY label""",
)
def clean_flows_query(spark, sf_dir):
    return (
        c.clean_flows(flows(spark, sf_dir), ["f_dirty"])
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("f_value"), 4).alias("sum_value"),
            F.round(F.sum("f_dirty"), 4).alias("sum_dirty"),
        )
    )


@query("missing_report_items", f"""{WITH_ITEMS} {" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) FILTER (WHERE {n} IS NULL) AS n_missing FROM items"
    for n in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "label"])}""")
def missing_report_items(spark, sf_dir):
    return c.missing_report(items(spark, sf_dir))
