"""The stages of the pipeline: what each keeps, and that decisions take effect."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from flowlens.llm import jaccard, mixing
from flowlens.runtime import materialise


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
            clean = before.join(labels, "doc_id").where("length(text) > 0")
            assert clean.join(docs, "doc_id", "left_anti").count() <= 0.02 * clean.count()
        if name == "n-gram jaccard join":
            rows = docs.select("doc_id", "text").collect()
            assert brute.shingle_links([r["text"] for r in rows]) == []
            old = before.select("doc_id", "text").collect()
            root = brute.roots(len(old), brute.shingle_links([r["text"] for r in old]))
            assert len(rows) == len(set(root))
        if name == "mixing sources to target weights":
            want = mixing.mix_sizes(before).agg(F.sum("taken")).first()[0]
            assert docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    assert len(pipeline.STAGES) == 5 and docs.count() == sizes[-2]
    assert docs.where("n_pieces <> size(pieces)").count() == 0
    assert docs.where("NOT round_trip OR second_score > score").count() == 0


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    corpus = brute.corpus(spark)
    for docs in (corpus, corpus.limit(0)):
        for _, stage in pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf_dir))
        docs.count()


def test_near_copies_leave_one_of_each(spark):
    docs = brute.corpus(spark)
    left = jaccard.one_of_each(docs)
    assert left.where("doc_id = 7").count() == 1


def test_run_gives_tokens(spark, sf_dir):
    got = pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_pieces", "pieces", "score", "second_score", "round_trip"]
    assert got.count() > 0
