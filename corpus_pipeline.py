"""From raw documents to packed sequences: language, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm import common, langid, neardup, packing, secrets
from scanfold.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the labelled ones teach, go.

    Null and empty texts have no letter. Rows that repeat are judged alike, also without an id; very long texts are judged
    whole; an empty table stays empty.
    """
    return langid.LanguageModel.fit(docs, limits=True).kept(docs, least=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document with the smallest id stays; documents are told apart by row, not by id.

    Texts without words (null, empty or blank ones) are in no group, and rows without an id are in none either: all of
    them stay. Rows that repeat whole, id included, are a group. An empty table stays empty.
    """
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"row_{k}") not in docs.columns)
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd")
    classes = neardup.near_duplicates(numbered, row_col=row, words=5, percent=80)
    gone = classes.where(~F.col("first")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked; every document stays, and so do null and empty texts and repeated rows.

    A live one is masked in all its copies; very long texts are searched whole; an empty table stays empty.
    """
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a null or empty text is its end id alone, and rows that repeat are packed each.

    A very long text takes as many sequences as it needs; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]
#: A learned language model and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = common.written(stage(spark, docs, sf_dir), f"stage-{name}", keep=name == STAGES[-1][0]), docs
        common.dropped(before)
    return docs
