"""Prompt assembly: retrieval rows, grouped by file in order of first appearance, as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The prompt's wording.
HEADER = "基于以下参考文档回答用户的问题。如果文档中没有相关信息，请说明无法找到相关信息。\n\n"
FILE_LINE = ("=== 文件 ", ": ", " ===\n")
PART_LINE = ("[片段 ", "] (相关度: ", "%)\n", "\n\n")
FOOTER = ("用户问题：", "\n\n请提供准确、完整的回答：")


def percent(score: Column) -> Column:
    """A score as a percentage with one decimal, by whole thousandths."""
    t = F.round(score * 1000).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (F.abs(t) % 10).cast("string"))


def parts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (file_id, file_name, chunk_index, content, relevance_score, rank) as one `body` text for each `by`; rank orders the results."""
    own = Window.partitionBy(*by, "file_id")
    r = rows.withColumn("_first", F.min("rank").over(own)).withColumn("_name", F.min_by("file_name", "rank").over(own))
    r = r.withColumn("_no", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")))
    name = F.when(F.coalesce("_name", F.lit("")) != "", F.col("_name")).otherwise(F.col("file_id"))
    head = F.concat(F.lit(FILE_LINE[0]), F.col("_no").cast("string"), F.lit(FILE_LINE[1]), name, F.lit(FILE_LINE[2]))
    part = F.concat(F.lit(PART_LINE[0]), (F.col("chunk_index") + 1).cast("string"), F.lit(PART_LINE[1]), percent(F.col("relevance_score")), F.lit(PART_LINE[2]), F.col("content"), F.lit(PART_LINE[3]))
    first, last = F.col("rank") == F.col("_first"), F.col("rank") == F.max("rank").over(own)
    line = F.concat(F.when(first, head).otherwise(""), part, F.when(last, "\n").otherwise(""))
    # the rows of one result list: top-k many
    out = r.select(*by, F.struct("_no", "rank", line.alias("line")).alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return out.select(*by, F.array_join(F.transform("m", lambda x: x["line"]), "").alias("body"))


def build(rows: DataFrame, query: str) -> DataFrame:
    """One row `prompt`; the query itself without results."""
    body = parts(rows).select("body")
    text = F.concat(F.lit(HEADER), F.col("body"), F.lit(FOOTER[0]), F.lit(query), F.lit(FOOTER[1]))
    return body.select(F.when(F.col("body") == "", F.lit(query)).otherwise(text).alias("prompt"))
