"""PDF: decoding, sniffing, and tables and sections from extracted rows.

Extraction itself needs a reader, given as a function bytes -> list of pages, a page a list of rows, a row a list of cells;
with the optional pypdf installed `pypdf_pages` is one.  Everything after it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import column, trimmed
from quarry.operators.markdown import fitted, linearized

PAGE_MARK = r"(?md)^\[第(\d+)页\]$"


def is_pdf(c: Column | str) -> Column:
    """Whether content looks like a base64 PDF."""
    t = column(c)
    return t.startswith("base64:") | t.startswith("data:application/pdf") | t.startswith("JVBER")


def decoded(c: Column | str) -> Column:
    """The bytes of a base64 PDF; null unless standard or URL-safe base64 gives a PDF header."""
    t = column(c)
    t = F.when(t.startswith("base64:"), F.substring(t, F.lit(8), F.length(t))).otherwise(F.regexp_replace(t, r"(?s)\A.*?base64,", ""))
    t = trimmed(t)
    raw = F.coalesce(F.try_to_binary(t, F.lit("base64")), F.try_to_binary(F.translate(t, "-_", "+/"), F.lit("base64")))
    return F.when(F.substring(raw, 1, 5) == F.lit(bytearray(b"%PDF-")), raw)


def cleaned(c: Column | str) -> Column:
    t = F.regexp_replace(column(c), r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(t, r"[ \t]{3,}", "  "))


def pypdf_pages(raw: bytes) -> list[list[list[str]]]:
    from io import BytesIO

    from pypdf import PdfReader  # optional

    return [[line.split("  ") for line in (page.extract_text() or "").split("\n")] for page in PdfReader(BytesIO(raw)).pages]


def page_rows(files: DataFrame, pages: Callable[[bytes], list[list[list[str]]]] = pypdf_pages, content: str = "content", doc_id: str = "path") -> DataFrame:
    """(doc_id, page, row, cells) of files, such as spark.read.format('binaryFile') gives; unreadable files give no row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, at, rows, out = [], [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = pages(raw)
                except Exception:
                    continue
                for p, page in enumerate(found, 1):
                    for r, cells in enumerate(page):
                        ids.append(doc), at.append(p), rows.append(r), out.append(cells)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int32()), pa.array(rows, pa.int32()), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "page", "row", "cells"])

    return files.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content)).mapInArrow(run, "doc_id string, page int, row int, cells array<string>")


def page_tables(rows: DataFrame) -> DataFrame:
    """(doc_id, page, first_row, headers, rows, raw_text, context, linearized): runs of three or more rows of three or more cells."""
    wide = F.size("cells") >= 3
    w = Window.partitionBy("doc_id", "page").orderBy("row")
    runs = rows.withColumn("run", F.sum(F.when(wide, 0).otherwise(1)).over(w)).filter(wide)
    # the rows of one table of one page
    t = runs.groupBy("doc_id", "page", "run").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("m")).filter(F.size("m") >= 3)
    t = t.withColumn("headers", F.get("m", F.lit(0))["cells"])
    t = t.withColumn("rows", F.transform(F.slice("m", F.lit(2), F.size("m") - 1), lambda x: fitted(x["cells"], F.size("headers"))))
    bar = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |\n"))
    raw = F.concat(bar(F.col("headers")), F.array_join(F.transform("rows", bar), ""))
    ctx = F.concat(F.lit("PDF 第"), F.col("page").cast("string"), F.lit("页表格"))
    return t.select("doc_id", "page", F.get("m", F.lit(0))["row"].alias("first_row"), "headers", "rows", raw.alias("raw_text"), ctx.alias("context"), linearized(F.col("headers"), F.col("rows"), ctx).alias("linearized"))


def page_text(rows: DataFrame) -> DataFrame:
    """(doc_id, content): the pages' lines under page marks, cleaned."""
    line = F.array_join("cells", " ")
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("m"))
    pages = pages.select("doc_id", "page", F.concat(F.lit("[第"), F.col("page").cast("string"), F.lit("页]\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("t"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))  # the pages of one document
    return docs.select("doc_id", cleaned(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("content"))


def page_sections(c: Column | str) -> Column:
    """array<struct(title, level, content)>: the text under each page mark, without empty pages."""
    t = column(c)
    marks, parts = F.regexp_extract_all(t, F.lit(PAGE_MARK), F.lit(1)), F.split(t, PAGE_MARK)
    zipped = F.arrays_zip(marks.alias("n"), F.slice(parts, F.lit(2), F.size(marks)).alias("text"))
    rows = F.transform(zipped, lambda x: F.struct(F.concat(F.lit("第"), x["n"], F.lit("页")).alias("title"), F.lit(1).alias("level"), trimmed(x["text"]).alias("content")))
    return F.filter(rows, lambda x: x["content"] != "")


def title(c: Column | str) -> Column:
    """The first line that is neither blank nor a page mark."""
    lines = F.transform(F.split(column(c), "\n"), trimmed)
    return F.coalesce(F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_MARK)), F.lit(0)), F.lit(""))
