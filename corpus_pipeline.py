"""A corpus pipeline over `documents`: stages that each read, as Parquet, what the one before kept.

run() writes each stage's rows to the shared folder before the next reads them. Every stage takes rows with nulls in
any column, empty and very long texts, rows that repeat an id or are equal in all columns, further columns of any name
and empty tables; what it does with them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import common
from framequarry.llm.jaccard_join import jaccard_groups, row_key
from framequarry.llm.line_dedup import line_dedup
from framequarry.llm.mixing import mix
from framequarry.llm.packing import best_fit_pack
from framequarry.llm.quality_net import fitted, quality_scores

LEAST_QUALITY = 0.7
#: Near-duplicates of the stage share so many percent of their shingles of so many words; op6 by itself has its own.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text's quality score reaches the threshold, by a network trained on the labels.

    Null texts are scored as empty ones; long texts are scored whole; equal rows stay or go together; without any label
    all scores are 0.5, so that nothing stays.
    """
    model = fitted(docs, common.documents(spark, sf_dir, "labels"))
    score = common.fresh("net_score", docs.columns)
    return quality_scores(docs, model, docs.columns, score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sites show; every row stays.

    Null texts stay null, and texts may become empty; a null source is no site; equal rows keep the same lines.
    """
    return line_dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the smallest id, of each group of near-duplicates.

    Rows of equal id and text are duplicates too, so one of them stays; rows of one id whose texts differ are judged by
    their texts. Null and empty texts, and those without words, are nobody's duplicates: all their rows stay. A null id
    is larger than any other.
    """
    groups = jaccard_groups(docs, k=STAGE_SHINGLE, percent=STAGE_PERCENT).where("kept")
    # the row travels as one column, so that its names never meet those used here
    d = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("k1"), F.lit(0).alias("k2"))
    d = d.join(groups.select(F.col("row_key").alias("k1"), (F.col("n_shingles") > 0).alias("words")).distinct(), "k1")
    many = common.repeated(d.where("words"), "k1", "k2")
    if many is not None:
        one = d.where("words").join(many.select("k1"), "k1").groupBy("k1").agg(F.first("row").alias("row"))
        d = d.join(many.select("k1"), "k1", "left_anti").select("row").unionAll(one.select("row"))
    return d.select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that all sources have equal shares, in shuffled order.

    A null source is one of the sources; each of equal rows has a draw of its own; null and empty texts are rows like
    others.
    """
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents placed in sequences; null and empty texts are an end token, every row is packed."""
    return best_fit_pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing),
]
#: A trained network and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
