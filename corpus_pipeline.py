"""A corpus pipeline: reject low quality, cut repeated lines, thin near duplicates, mix sources, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import jaccard, kneser_ney, line_dedup, mixing, pieces
from flowlens.llm.queries import VOCABULARY
from flowlens.runtime import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not above their language's limit.

    Null and empty texts go. Every row is judged by its own text, so equal rows stay or go together, whatever their ids;
    null languages take the limit of all. An empty table gives none. Columns beyond those of documents go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.judge_perplexity(docs, labels).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier runs; those that lose all their words go.

    Null and empty texts stay as they are. Of equal rows one keeps its lines. A row is told by id and text, so null and
    repeated ids do no harm. An empty table gives none. Columns beyond those of documents go.
    """
    left = line_dedup.drop_repeated_lines(docs)
    stays = (F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.size("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return left.where(F.coalesce(stays, F.lit(True))).withColumn("n_chars", length).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word runs.

    Texts without words, null ones too, are no copies of anything and stay. Of equal rows one stays; a null id comes last.
    An empty table gives none. Columns beyond those of documents go.
    """
    return jaccard.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it.

    Texts without words, null ones too, weigh nothing and are taken as often as the block of their source that they lie in. A
    null source is a source, the last one. Equal rows are taken alike. An empty table gives none. Columns beyond those of documents go.
    """
    return mixing.mixed_documents(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, the scores of the two best segmentations, and whether decoding gives the text back.

    Null texts have null pieces and scores and -1 pieces, empty ones no pieces and score 0. Rows are coded one by one, so that
    repeated rows, ties of ids and the length of a text make no difference; an empty table gives none.
    """
    coded = pieces.encode_texts(docs.select(*COLUMNS), pieces.load_vocabulary(VOCABULARY), n=2, decoded_col="decoded")
    back = F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    second = F.get("scores", F.lit(1)).alias("second_score")
    return coded.select("doc_id", "lang", "source", F.size("pieces").cast("bigint").alias("n_pieces"), "pieces", "score", second, back)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("sentencepiece encoding and decoding", tokens),
]

#: The model, the candidate search and the mix have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
