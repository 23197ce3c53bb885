"""Label encodings over whole tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import WITH_CLEAN, WITH_FLOWS, flows
from flowlens.functions import labels as lb
from flowlens.operators.cleaning import clean_flows

_LIST = ["BENIGN", "DoS Hulk", "PortScan", "Bot"]
_CODES = f"""{WITH_CLEAN}, c AS (SELECT label, count(*) AS n FROM clean GROUP BY label),
    codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS by_name,
        row_number() OVER (ORDER BY n DESC, label) - 1 AS by_count FROM c)"""


def _clean(spark, sf_dir):
    return clean_flows(flows(spark, sf_dir), ["f_dirty"])


@query(
    "merge_web_attacks",
    f"""{WITH_FLOWS} SELECT flow_id,
    CASE WHEN label LIKE 'Web Attack%' THEN 'Web-Attack' ELSE label END AS label FROM flows""",
)
def merge_web_attacks(spark, sf_dir):
    marked = F.regexp_replace("label", "Attack - ", "Attack \ufffd ")
    return flows(spark, sf_dir).select(
        "flow_id", lb.merge_web_attacks(lb.normalise_dash(marked)).alias("label")
    )


@query(
    "label_one_vs_rest",
    f"{WITH_CLEAN} SELECT flow_id, CASE WHEN label = 'PortScan' THEN 1 ELSE 0 END AS is_attack FROM clean",
)
def label_one_vs_rest(spark, sf_dir):
    return _clean(spark, sf_dir).select("flow_id", lb.one_vs_rest(F.col("label"), "PortScan").alias("is_attack"))


@query(
    "label_benign",
    f"{WITH_CLEAN} SELECT flow_id, CASE WHEN label = 'BENIGN' THEN 1 ELSE 0 END AS benign FROM clean",
)
def label_benign(spark, sf_dir):
    return _clean(spark, sf_dir).select("flow_id", lb.benign_flag(F.col("label")).alias("benign"))


@query("label_codes", f"{_CODES} SELECT flow_id, label, CAST(by_name AS INT) AS code FROM clean JOIN codes USING (label)")
def label_codes(spark, sf_dir):
    df = _clean(spark, sf_dir)
    coded = lb.fit_codes(df, "label", "code").transform(df)
    return coded.select("flow_id", "label", F.col("code").cast("int").alias("code"))


@query(
    "label_index_freq",
    f"{_CODES} SELECT flow_id, label, CAST(by_count AS INT) AS code FROM clean JOIN codes USING (label)",
)
def label_index_freq(spark, sf_dir):
    df = _clean(spark, sf_dir)
    coded = lb.fit_codes(df, "label", "code", "frequencyDesc").transform(df)
    return coded.select("flow_id", "label", F.col("code").cast("int").alias("code"))


@query("label_decode", f"{_CODES} SELECT flow_id, CAST(by_count AS INT) AS code, label AS decoded FROM clean JOIN codes USING (label)")
def label_decode(spark, sf_dir):
    df = _clean(spark, sf_dir)
    indexer = lb.fit_codes(df, "label", "code", "frequencyDesc")
    decoded = lb.decode(indexer.transform(df).drop("label"), "code", "decoded", indexer.labels)
    return decoded.select("flow_id", F.col("code").cast("int").alias("code"), "decoded")


@query(
    "label_code_by_list",
    f"""{WITH_CLEAN} SELECT flow_id, CASE label WHEN 'BENIGN' THEN 0 WHEN 'DoS Hulk' THEN 1 WHEN 'PortScan' THEN 2
    WHEN 'Bot' THEN 3 ELSE -1 END AS code FROM clean""",
)
def label_code_by_list(spark, sf_dir):
    code = F.coalesce(lb.code_by_list(F.col("label"), _LIST), F.lit(-1))
    return _clean(spark, sf_dir).select("flow_id", code.alias("code"))


@query(
    "one_hot",
    """SELECT l_orderkey, CAST(l_returnflag = 'A' AS INT) AS "is_A", CAST(l_returnflag = 'N' AS INT) AS "is_N",
    CAST(l_returnflag = 'R' AS INT) AS "is_R" FROM lineitem""",
)
def one_hot(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_returnflag")
    return lb.one_hot(df, "l_returnflag").drop("l_returnflag")


@query(
    "one_hot_argmax",
    "SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS code FROM lineitem",
)
def one_hot_argmax(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = lb.class_names(df, "l_returnflag")
    return df.select("l_orderkey", lb.argmax(lb.one_hot_array(F.col("l_returnflag"), names)).alias("code"))


@query("round_to_class", f"{WITH_FLOWS} SELECT flow_id, CAST(round_even(f_k / 2, 0) AS INT) AS code FROM flows")
def round_to_class(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", lb.round_to_class(F.col("f_k") / 2).alias("code"))


@query("round_probability", f"{WITH_FLOWS} SELECT flow_id, CASE WHEN f_k / 100 > 0.5 THEN 1 ELSE 0 END AS code FROM flows")
def round_probability(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", lb.round_probability(F.col("f_k") / 100).alias("code"))


@query(
    "assemble_features",
    f"""{WITH_CLEAN} SELECT flow_id, f_value AS x1, f_k AS x2, f_dirty AS x3, CAST(3 AS INT) AS width FROM clean""",
)
def assemble_features(spark, sf_dir):
    assembler = VectorAssembler(inputCols=["f_value", "f_k", "f_dirty"], outputCol="features", handleInvalid="error")
    x = vector_to_array("features")
    return assembler.transform(_clean(spark, sf_dir)).select(
        "flow_id", x[0].alias("x1"), x[1].alias("x2"), x[2].alias("x3"), F.size(x).alias("width")
    )
