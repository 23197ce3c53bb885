"""Counts, duplicates and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import WITH_CLEAN, WITH_FLOWS, WITH_ITEMS, flows, items
from flowlens.functions.labels import fit_codes
from flowlens.operators import profile as p
from flowlens.operators.cleaning import clean_flows
from flowlens.operators.sampling import random_split


def _clean(spark, sf_dir):
    return clean_flows(flows(spark, sf_dir), ["f_dirty"])


@query("label_counts", f"{WITH_FLOWS} SELECT label, count(*) AS n FROM flows GROUP BY label")
def label_counts(spark, sf_dir):
    return p.label_counts(flows(spark, sf_dir))


@query(
    "label_pair_counts",
    f"""{WITH_CLEAN}, c AS (SELECT label, count(*) AS n FROM clean GROUP BY label)
    SELECT CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS code, label, n FROM c""",
)
def label_pair_counts(spark, sf_dir):
    df = _clean(spark, sf_dir)
    coded = fit_codes(df, "label", "code", "frequencyDesc").transform(df)
    return p.pair_counts(coded, "code", "label")


@query(
    "table_shape",
    f"""{WITH_CLEAN}, drawn AS (SELECT CASE WHEN ('0x' || substr(md5(concat('200-', flow_id)), 1, 8))::BIGINT
        < 0.7 * 4294967296 THEN 'train' ELSE 'test' END AS split FROM clean)
    SELECT split, count(*) AS n_rows, 7 AS n_columns FROM drawn GROUP BY split""",
)
def table_shape(spark, sf_dir):
    return p.table_shape(random_split(_clean(spark, sf_dir), ["flow_id"], {"train": 0.7, "test": 0.3}, 200), "split")


@query("dedupe_rows", f"{WITH_ITEMS} SELECT DISTINCT l_quantity, l_discount, l_tax, label FROM items")
def dedupe_rows(spark, sf_dir):
    return p.dedupe_rows(items(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "label"])


@query("distinct_labels", f"{WITH_FLOWS} SELECT DISTINCT label FROM flows")
def distinct_labels(spark, sf_dir):
    return p.distinct_values(flows(spark, sf_dir), "label")


@query("distinct_label_count", f"{WITH_FLOWS} SELECT count(DISTINCT label) AS n_labels FROM flows")
def distinct_label_count(spark, sf_dir):
    return flows(spark, sf_dir).agg(F.countDistinct("label").alias("n_labels"))


@query(
    "describe_column",
    f"""{WITH_FLOWS}, c AS (SELECT label, count(*) AS c FROM flows WHERE label IS NOT NULL GROUP BY label)
    SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_unique, first(label ORDER BY c DESC, label) AS top,
        max(c) AS freq FROM c""",
)
def describe_column(spark, sf_dir):
    return p.describe_column(flows(spark, sf_dir), "label")


@query(
    "class_weight_log",
    f"""{WITH_CLEAN}, c AS (SELECT label, count(*) AS n FROM clean GROUP BY label)
    SELECT label, n, round(greatest(1.0, ln(0.15 * (SELECT sum(n) FROM c) / n)), 6) AS weight FROM c""",
)
def class_weight_log(spark, sf_dir):
    return p.log_weights(p.label_counts(_clean(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@query(
    "class_weight_balanced",
    f"""{WITH_CLEAN}, c AS (SELECT label, count(*) AS n FROM clean GROUP BY label),
    w AS (SELECT label, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c)
    SELECT flow_id, label, round(weight, 6) AS weight FROM clean JOIN w USING (label)""",
)
def class_weight_balanced(spark, sf_dir):
    df = _clean(spark, sf_dir).select("flow_id", "label")
    weighted = p.attach_weights(df, p.balanced_weights(p.label_counts(df)))
    return weighted.withColumn("weight", F.round("weight", 6))
