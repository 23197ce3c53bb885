"""Plans stay what they should be at scale: pruned scans, no cross joins, no needless shuffles."""

import pytest
from pyspark.sql import functions as F

from flowlens.catalog.views import flows, items, wide
from flowlens.operators import cleaning, features, profile, sampling
from flowlens.plans import forests
from flowlens.runtime import materialise, scratch_path, scratch_root, small_side


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_projection_reaches_the_scan(spark, sf_dir):
    text = plan(cleaning.without_benign(flows(spark, sf_dir)).select("flow_id"))
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0] and "Exchange" not in text


def test_filter_reaches_the_scan(spark, sf_dir):
    text = plan(items(spark, sf_dir).where("label = 'A'").select("l_tax"))
    assert "EqualTo(l_returnflag,A)" in text


def test_splits_do_not_shuffle_the_table(spark, sf_dir):
    df = flows(spark, sf_dir)
    for split in (
        sampling.random_split(df, ["flow_id"], {"a": 0.5, "b": 0.5}, 1),
        sampling.stratified_split(df, "flow_id", {"a": 0.5, "b": 0.5}, 1),
        sampling.thin_benign(df, "flow_id", 1),
    ):
        text = plan(split)
        assert "Exchange hashpartitioning" not in text and "Sort" not in text and "Window" not in text


def test_copies_are_cut_before_the_shuffle(spark, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranked = items(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("l_tax").orderBy("l_quantity")))
    assert plan(ranked.where("r <= 6")).count("WindowGroupLimit") >= 2


def test_dedupe_and_counts_aggregate_before_the_shuffle(spark, sf_dir):
    for df in (
        profile.dedupe_rows(items(spark, sf_dir), ["l_tax", "label"]),
        profile.label_counts(items(spark, sf_dir)),
        features.joint_counts(wide(spark, sf_dir), ["Flow Duration", "Active Mean"]),
    ):
        text = plan(df)
        assert text.count("HashAggregate") >= 2 and "Cartesian" not in text and "NestedLoop" not in text


def test_small_side_is_proven_or_left_alone(spark):
    small, large = spark.range(10), spark.range(11)
    assert "hint" in small_side(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert small_side(large, 10) is large
    assert small_side(spark.range(0), 10).count() == 0


def test_scratch_is_the_configured_folder(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialise(spark.range(5)).count() == 5


def test_row_wise_functions_take_a_stream(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from flowlens.catalog.views import FLOWS
    from flowlens.functions.labels import merge_web_attacks

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    clean = cleaning.clean_flows(stream.selectExpr(*[f"{e} AS {n}" for e, n in FLOWS]), ["f_dirty"])
    labelled = clean.withColumn("label", merge_web_attacks(F.col("label")))
    job = (
        labelled.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    job.awaitTermination(120)
    want = cleaning.clean_flows(flows(spark, sf_dir), ["f_dirty"]).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        scratch_root(Session())


def test_forests_read_few_partitions_whatever_the_rows(spark):
    """Each partition sends all open nodes of all trees, so their number must not follow the rows."""
    rows = spark.range(60_000).select(F.col("id").alias("key"), F.rand(1).alias("x"))
    with forests.hold(rows, ["key"], at_once=12) as held:
        assert held.rdd.getNumPartitions() == 3
        assert held.count() == 60_000
    assert [forests.forest_partitions(n) for n in (1_000, 480_000, 4_800_000, 29_000_000)] == [1, 12, 20, 116]
    assert forests.forest_partitions(670_000, 4) == 3
