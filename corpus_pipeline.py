"""The corpus pipeline: quality rules, line dedup, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage's result is written as Parquet and read again as the next stage's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions.materialize import new_path
from strayrow.llm import jaccard, line_dedup, packing, quality
from strayrow.llm.queries import table, tokenizer_file
from strayrow.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """A stage can run alone: the package goes to the workers first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship_package(spark), docs, sf_dir)

    return run_stage


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a quality rule rejects go."""
    return quality.keep_good(docs)


@shipped
def line_dedup_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many documents of a source go; ``n_chars`` follows the text.

    Documents that ``near_duplicates`` takes for copies count as one: else they would take each
    other's lines, and none would be left whole for it to keep.
    """
    copies = (jaccard.SHINGLE, jaccard.SIMILARITY)
    cleaned = line_dedup.drop_boilerplate(docs, "source", "text", copies=copies)
    if "n_chars" not in cleaned.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    return jaccard.keep_one(docs)


@shipped
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, their ids' checksum and place in a sequence."""
    pieces = packing.cut_pieces(docs, tokenizer_file("word_bpe_49k.json"))
    packed = packing.pack_pieces(pieces.withColumn("ids", F.crc32("ids")))
    return packed.select(
        "doc_id", "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_by_source),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and packing cannot be said in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
