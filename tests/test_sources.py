"""Raw files: blanks and repeats in headers, odd bytes, repeated header lines, row order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.fixed_values import ATTACK_FEATURES
from flowlens.functions.labels import merge_web_attacks, normalise_dash
from flowlens.operators.cleaning import clean_flows, without_header_rows
from flowlens.runtime import scratch_path
from flowlens.sources import csv, dictionary, matrix, npy

RAW = (
    b" Flow Duration, Flow Bytes/s,Fwd Header Length,Fwd Header Length, Label\n"
    b"10,Infinity,1,2,BENIGN\n"
    b" Flow Duration, Flow Bytes/s,Fwd Header Length,Fwd Header Length, Label\n"
    b"20,NaN,1,2,Web Attack \x96 XSS\n"
    b"30,,1,2,DoS Hulk\n"
    b"40,7.5,1,2,\n"
)


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes(RAW)
    return str(path)


def test_headers_are_trimmed_and_unique(spark, raw):
    df = csv.read_csv_text(spark, raw)
    assert df.columns == ["Flow Duration", "Flow Bytes/s", "Fwd Header Length2", "Fwd Header Length3", "Label"]
    assert df.count() == 5 and without_header_rows(df, "Label").count() == 4 - 1


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_web_attack_names_get_one_spelling(spark, raw, encoding):
    df = csv.read_csv_text(spark, raw, encoding)
    labels = {r[0] for r in df.select(normalise_dash(F.col("Label"))).collect()}
    assert "Web Attack - XSS" in labels and "DoS Hulk" in labels
    assert "Web-Attack" in {r[0] for r in df.select(merge_web_attacks(F.col("Label"))).collect()}


def test_cleaning_a_raw_file(spark, raw):
    names = ["Flow Duration", "Flow Bytes/s"]
    rows = clean_flows(csv.read_csv_text(spark, raw), names, "Label").orderBy("Flow Duration").collect()
    assert [(r["Flow Duration"], r["Flow Bytes/s"]) for r in rows] == [(10.0, 0.0), (20.0, 0.0), (30.0, 0.0)]


def test_types_are_inferred_on_request(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" a, Label\n1,x\n2,y\n")
    assert csv.read_csv_typed(spark, str(tmp_path / "t.csv")).dtypes == [("a", "int"), ("Label", "string")]


def test_text_matrix_keeps_line_order(spark, tmp_path):
    path = tmp_path / "x.np"
    path.write_text("".join(f"{i}.5 {-i}e-1\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = matrix.read_text_matrix(spark, str(path))
        assert df.rdd.getNumPartitions() > 1
        rows = df.orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_id"] for r in rows] == list(range(5000))
    assert all(r["x"] == [i + 0.5, -i / 10] for i, r in enumerate(rows))


def test_dictionary_round_trip(spark):
    path = dictionary.save_dictionary(dictionary.attack_features(spark), scratch_path(spark, "d"))
    loaded = dictionary.load_dictionary(spark, path)
    assert dictionary.as_dict(loaded) == ATTACK_FEATURES
    union = {r["feature"] for r in dictionary.feature_union(loaded).collect()}
    assert union == {f for fs in ATTACK_FEATURES.values() for f in fs} and len(union) == 22


@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2", "|b1", "|u1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_one_binary_file_is_read_in_many_tasks(spark, tmp_path, kind, order):
    x = np.asarray(np.random.default_rng(1).integers(0, 2 if kind == "|b1" else 100, (3000, 7)).astype(kind), order=order)
    np.save(tmp_path / "x.npy", x)
    df = npy.read_npy(spark, str(tmp_path / "x.npy"), partition_bytes=4096)
    assert df.rdd.getNumPartitions() == -(-3000 // (4096 // (7 * x.dtype.itemsize)))
    rows = df.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(3000))
    assert np.array_equal(np.array([r["x"] for r in rows]), x.astype(float))


def test_binary_files_of_a_folder_follow_each_other(spark, tmp_path, monkeypatch):
    np.save(tmp_path / "b.npy", np.arange(5.0))
    np.save(tmp_path / "a.npy", -np.arange(4))
    np.save(tmp_path / "c.npy", np.zeros((0, 1)))
    rows = npy.read_npy(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["x"] for r in rows] == [[-float(i)] for i in range(4)] + [[float(i)] for i in range(5)]
    monkeypatch.setattr(npy, "FILE_ROWS", 300)
    df = spark.range(5000).selectExpr("4999 - id as k", "id * 0.1D as u", "if(id = 7, null, -id) as v")
    path = npy.write_npy(df, scratch_path(spark, "npy"), "k", ["u", "v"])
    back = npy.read_npy(spark, path).orderBy("row_id").collect()
    assert len(back) == 5000 and all(r["x"][0] == (4999 - i) * 0.1 for i, r in enumerate(back))
    assert [i for i, r in enumerate(back) if math.isnan(r["x"][1])] == [4992]


def test_binary_files_without_numbers_are_refused(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.array(["a", "b"]))
    with pytest.raises(Exception, match="no matrix of numbers"):
        npy.read_npy(spark, str(tmp_path / "t.npy")).count()


def test_text_matrix_of_many_files_keeps_its_order(spark):
    df = spark.range(3000).selectExpr("2999 - id as k", "id * 0.1D as u", "if(id = 7, null, -1e-30D * id) as v").repartition(4)
    path = matrix.write_text_matrix(df, scratch_path(spark, "text"), "k", ["u", "v"])
    back = matrix.read_text_matrix(spark, path).orderBy("row_id").collect()
    assert [r["row_id"] for r in back] == list(range(3000))
    assert all(r["x"][0] == (2999 - i) * 0.1 for i, r in enumerate(back))
    assert [i for i, r in enumerate(back) if math.isnan(r["x"][1])] == [2992]
