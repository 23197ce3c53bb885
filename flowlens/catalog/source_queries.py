"""Scans and sinks. Each writes a given table out and reads it back through the tested path."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.catalog.registry import query
from flowlens.catalog.views import FLOWS_SQL, ITEMS_SQL, WITH_CLEAN, flows, items
from flowlens.fixed_values import BENIGN
from flowlens.functions.labels import class_names
from flowlens.operators.cleaning import clean_flows, trim_headers
from flowlens.operators.features import label_means
from flowlens.operators.sampling import stratified_split
from flowlens.runtime import scratch_path, small_side
from flowlens.sources.csv import read_csv_text, read_csv_typed, write_csv
from flowlens.sources.dictionary import load_dictionary, save_dictionary
from flowlens.sources.matrix import read_matrix, read_split, read_text_matrix, write_matrix, write_text_matrix
from flowlens.sources.npy import read_npy, write_npy

_EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_EVENTS_SQL = "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _micros(df):
    """Timestamps as microseconds, which every engine shows alike."""
    return df.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query("scan_csv_text", _EVENTS_SQL)
def scan_csv_text(spark, sf_dir):
    raw = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("string")).withColumnRenamed("event_type", " event_type")
    text = read_csv_text(spark, write_csv(raw, scratch_path(spark, "csv")))
    numbers = {c: F.col(c).cast(t) for c, t in (("event_id", "bigint"), ("user_id", "bigint"), ("value", "double"))}
    return _micros(text.withColumns(numbers))


@query("scan_csv_typed", _EVENTS_SQL)
def scan_csv_typed(spark, sf_dir):
    raw = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    path = write_csv(raw, scratch_path(spark, "csv"))
    return _micros(read_csv_typed(spark, path, _EVENTS_SCHEMA.replace("timestamp", "string")))


@query(
    "scan_csv_latin1",
    f"SELECT * REPLACE (replace(label, '-', chr(183)) AS label) FROM ({FLOWS_SQL}) WHERE label IS NOT NULL AND label <> ' Label'",
)
def scan_csv_latin1(spark, sf_dir):
    df = flows(spark, sf_dir).where("label <> ' Label'")
    marked = df.withColumn("label", F.replace("label", F.lit("-"), F.lit("\u00b7")))
    path = write_csv(marked, scratch_path(spark, "latin1"), encoding="ISO-8859-1")
    return read_csv_typed(spark, path, marked.schema, encoding="ISO-8859-1")


@query("scan_part_files", ITEMS_SQL)
def scan_part_files(spark, sf_dir):
    df = items(spark, sf_dir)
    path = write_csv(df, scratch_path(spark, "parts"))
    return read_csv_typed(spark, path, df.schema)


@query(
    "scan_matrix",
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width,"
    " round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS sum_squares,"
    " round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings",
)
def scan_matrix(spark, sf_dir):
    values = vector_to_array(F.col("features"))
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    return read_matrix(spark, f"{sf_dir}/embeddings.parquet", "embedding").select(
        "vec_id",
        F.size(values).cast("bigint").alias("width"),
        F.round(squares, 6).alias("sum_squares"),
        F.round(values[0], 6).alias("first_value"),
    )


_NUMBERED_SQL = f"""{WITH_CLEAN} SELECT row_number() OVER (ORDER BY flow_id) - 1 AS row_id, f_value AS x1, f_k AS x2, f_dirty AS x3,
    CASE WHEN label = 'BENIGN' THEN 1.0 ELSE 0.0 END AS y1, CASE WHEN label = 'BENIGN' THEN 0.0 ELSE 1.0 END AS y2 FROM clean"""


def _xy(spark, sf_dir):
    """Clean flows with their one-hot class, benign or not."""
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    benign = (F.col("label") == BENIGN).cast("double")
    return df.withColumns({"y1": benign, "y2": 1 - benign})


def _joined(x, y):
    y = y.select("row_id", F.col("x").alias("y"))
    numbers = [F.col(side)[i].alias(f"{side}{i + 1}") for side, n in (("x", 3), ("y", 2)) for i in range(n)]
    return x.join(y, "row_id").select("row_id", *numbers)


@query("scan_text_matrix", _NUMBERED_SQL)
def scan_text_matrix(spark, sf_dir):
    """X and y written as lines of numbers, read back, and put together by line order."""
    df = _xy(spark, sf_dir)
    x = write_text_matrix(df, scratch_path(spark, "x"), "flow_id", ["f_value", "f_k", "f_dirty"])
    y = write_text_matrix(df, scratch_path(spark, "y"), "flow_id", ["y1", "y2"])
    return _joined(read_text_matrix(spark, x), read_text_matrix(spark, y))


@query("scan_npy_matrix", _NUMBERED_SQL)
def scan_npy_matrix(spark, sf_dir):
    """The same through binary files."""
    df = _xy(spark, sf_dir)
    x = write_npy(df, scratch_path(spark, "x"), "flow_id", ["f_value", "f_k", "f_dirty"])
    y = write_npy(df, scratch_path(spark, "y"), "flow_id", ["y1", "y2"])
    return _joined(read_npy(spark, x), read_npy(spark, y))


_LABEL_MEANS_SQL = f"""{WITH_CLEAN}
    SELECT label, 'f_value' AS feature, round(avg(f_value), 6) AS score FROM clean GROUP BY label
    UNION ALL SELECT label, 'f_k', round(avg(f_k), 6) FROM clean GROUP BY label
    UNION ALL SELECT label, 'f_dirty', round(avg(f_dirty), 6) FROM clean GROUP BY label"""


@query("save_dictionary", _LABEL_MEANS_SQL)
def save_dictionary_query(spark, sf_dir):
    scores = label_means(clean_flows(flows(spark, sf_dir), ["f_dirty"]), ["f_value", "f_k", "f_dirty"])
    path = save_dictionary(scores, scratch_path(spark, "dictionary"))
    return load_dictionary(spark, path).withColumn("score", F.round("score", 6))


@query(
    "load_dictionary",
    f"""{WITH_CLEAN}, d AS (SELECT label, avg(f_value) AS mean_value FROM clean GROUP BY label)
    SELECT label, count(*) AS n, round(avg(abs(f_value - mean_value)), 6) AS spread
    FROM clean JOIN d USING (label) GROUP BY label""",
)
def load_dictionary_query(spark, sf_dir):
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    path = save_dictionary(
        df.groupBy("label").agg(F.avg("f_value").alias("mean_value")), scratch_path(spark, "dictionary")
    )
    return (
        df.join(small_side(load_dictionary(spark, path)), "label")
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.abs(F.col("f_value") - F.col("mean_value"))), 6).alias("spread"),
        )
    )


@query("sink_csv", f"{WITH_CLEAN} SELECT flow_id, src_id, f_value, f_k, f_dirty, label FROM clean")
def sink_csv(spark, sf_dir):
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    path = write_csv(df, scratch_path(spark, "sink"), header=False)
    return trim_headers(spark.read.schema(df.schema).csv(path))


_SPLIT3_SQL = """SELECT *, CASE WHEN r <= floor(0.8 * n) THEN 'train' WHEN r <= floor(0.9 * n) THEN 'valid' ELSE 'test' END
    AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', flow_id))) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM clean)"""


@query(
    "sink_matrix",
    f"""{WITH_CLEAN}, parts AS ({_SPLIT3_SQL})
    SELECT flow_id, f_value AS x1, f_k AS x2, split,
        CAST((SELECT count(DISTINCT label) FROM clean c WHERE c.label < parts.label) AS BIGINT) AS hot
    FROM parts""",
)
def sink_matrix(spark, sf_dir):
    df = clean_flows(flows(spark, sf_dir), ["f_dirty"])
    classes = class_names(df, "label")
    split = stratified_split(df, "flow_id", {"train": 0.8, "valid": 0.1, "test": 0.1}, seed=42)
    path = write_matrix(split, scratch_path(spark, "matrix"), "flow_id", ["f_value", "f_k"], "label", classes)
    parts = [read_split(spark, path, name) for name in ("train", "valid", "test")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hot = (F.array_position("y", F.lit(1.0)) - 1).cast("bigint")
    return whole.select("flow_id", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), "split", hot.alias("hot"))
