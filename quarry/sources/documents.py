"""Document sources and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.errors import TOO_LARGE, require

RESULT_SCHEMA = "chunk_id string, file_id string, file_name string, chunk_index int, content string, relevance_score double"


def text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_id, file_name, content) of whole text files."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.sha2(F.input_file_name(), 256).alias("file_id"), name.alias("file_name"), F.col("value").alias("content"))


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return rows.parquet(path)
    # a stream reads folders only
    return rows.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def inline(spark: SparkSession, content: str, file_id: str, file_name: str = "", most: int = 10 << 20) -> DataFrame:
    """One document given as an argument."""
    require(len(content.encode()) <= most, TOO_LARGE, f"content exceeds {most} bytes")
    return spark.createDataFrame([(file_id, file_name or file_id, content)], "file_id string, file_name string, content string")


def within_limit(docs: DataFrame, content: str = "content", most: int = 10 << 20) -> DataFrame:
    return docs.filter(F.octet_length(content) <= most)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text `json`."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def result_list(rows: DataFrame, order: Column) -> DataFrame:
    """One row: a result list (top-k many rows) as an indented JSON array."""
    numbered = F.struct(order.alias("_o"), F.struct(*rows.columns).alias("r"))
    listed = rows.agg(F.array_sort(F.collect_list(numbered)).alias("m"))
    return listed.select(F.to_json(F.transform("m", lambda x: x["r"]), {"pretty": "true"}).alias("json"))


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Retrieval rows from a JSON array in each text; a text that is none gives no row."""
    return texts.select(F.inline(F.from_json(column, f"array<struct<{RESULT_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")))
