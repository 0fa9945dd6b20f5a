"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of docs.

Every stage takes nulls in any column, empty and very long texts, empty tables and further columns of any name (these pass through; the last stage
replaces copy_no).  What it does with repeated rows and ties is in its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, jaccard_join, language_id, line_dedup, source_mix
from quarry.llm.tables import dropped, unused, written
from quarry.sources.shipping import ship

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: no letter, no text, or a posterior under one half.

    Repeated rows are judged alike.  If no row has a language to learn from, nothing is identified and all go.
    """
    ship(spark)
    found = language_id.train_and_identify(docs)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in their first document only; documents left without a line go.

    The first document is that of the smallest doc_id; all rows of that doc_id keep the line.  Rows with a null doc_id keep theirs.
    """
    ship(spark)
    return line_dedup.clean(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest doc_id (then of the smallest hash of its text).

    A row is judged by its own text: rows that repeat a doc_id with unlike texts all stay, equal rows stay once.  Rows without a word, and rows without a
    doc_id, are linked with nothing and stay.
    """
    ship(spark)
    own, th, one, rows = unused(docs, "near_id", "near_text", "near_one", "near_rows")
    kept = jaccard_join.representatives(docs.select("doc_id", "text")).toDF(own, th, rows)
    joined = docs.join(kept, (docs.doc_id == F.col(own)) & (F.xxhash64(docs.text) == F.col(th)), "left")
    blank = ~F.coalesce(docs.text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    joined = joined.filter(F.col(own).isNotNull() | docs.doc_id.isNull() | blank).withColumn(one, F.coalesce(rows, F.lit(1)) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = joined.filter(F.col(one)).select(*columns)
    return once.union(joined.filter(~F.col(one)).dropDuplicates([own, th]).select(*columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, whatever their doc_id; others that repeat it stay."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, shuffled; copy_no numbers a document's copies.

    Rows of one doc_id draw the same number.
    """
    ship(spark)
    return source_mix.mix(docs).select(*[c for c in docs.columns if c != "copy_no"], "copy_no")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL expresses neither language ID nor connected components of similar documents; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                dropped(before)  # its reader is written
            before = docs
    return docs
