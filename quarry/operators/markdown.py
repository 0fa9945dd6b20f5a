"""Markdown: front matter, sections, tables and images, as columns and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import WS, char_count, column, trimmed, word_count

FRONT_MATTER = r"(?sd)\A---\n(.+?)\n---"
HEADING = rf"(?md)^(#{{1,6}}){WS}+(.+)$"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
SEPARATOR = rf"\A\|[\t\n\f\r :]*-+[\t\n\f\r :]*(\|[\t\n\f\r :]*-+[\t\n\f\r :]*)*\|\z"

# Labels of tables and images in text for embedding.
TABLE_LABEL, COLUMNS_LABEL, IMAGE_LABEL = "[表格: ", "列: ", "[图片"


def body(c: Column | str) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(column(c), FRONT_MATTER, "")


def front_matter(c: Column | str) -> Column:
    """struct(title, author, tags, language); '' or an empty list where there is none, the last of a repeated key."""
    lines = F.split(F.regexp_extract(column(c), FRONT_MATTER, 1), "\n")
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(trimmed(F.split(x, ":", 2)[0])).alias("k"), trimmed(F.split(x, ":", 2)[1]).alias("v")),
    )

    def last(*keys: str) -> Column:
        own = F.filter(pairs, lambda p: p["k"].isin(*keys))
        return F.coalesce(F.get(own, F.size(own) - 1)["v"], F.lit(""))

    tagged = F.filter(pairs, lambda p: p["k"] == "tags")
    tags = F.flatten(F.transform(tagged, lambda p: F.transform(F.split(p["v"], ","), lambda t: trimmed(F.btrim(t, F.lit("[]"))))))
    return F.struct(last("title").alias("title"), last("author").alias("author"), F.filter(tags, lambda t: t != "").alias("tags"), last("language", "lang").alias("language"))


def title(c: Column | str) -> Column:
    """The front matter's title, else the first heading's text if that is of level 1."""
    own = front_matter(c)["title"]
    b = body(c)
    first = F.when(F.length(F.regexp_extract(b, HEADING, 1)) == 1, trimmed(F.regexp_extract(b, HEADING, 2))).otherwise("")
    return F.when(own != "", own).otherwise(first)


def sections(c: Column | str) -> Column:
    """array<struct(title, level, content, start, end)>: a heading's text runs to the next heading; offsets in code points of the body."""
    b = body(c)
    whole, marks, titles = (F.regexp_extract_all(b, F.lit(HEADING), F.lit(i)) for i in (0, 1, 2))
    parts = F.split(b, HEADING)
    size = F.size(whole)
    zipped = F.arrays_zip(whole.alias("whole"), marks.alias("mark"), titles.alias("title"), F.slice(parts, 2, F.greatest(size, F.lit(0))).alias("text"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["whole"]) + F.length(x["text"])
        own = F.struct(x["title"].alias("title"), F.length(x["mark"]).alias("level"), trimmed(x["text"]).alias("content"), a["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(a["all"], F.array(own)).alias("all"))

    kind = "array<struct<title:string,level:int,content:string,start:int,end:int>>"
    zero = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(kind).alias("all"))
    return F.aggregate(zipped, zero, step)["all"]


def images(c: Column | str) -> Column:
    """array<struct(alt_text, url)> in order."""
    t = column(c)
    return F.arrays_zip(F.regexp_extract_all(t, F.lit(IMAGE), F.lit(1)).alias("alt_text"), F.regexp_extract_all(t, F.lit(IMAGE), F.lit(2)).alias("url"))


def is_table_row(line: Column | str) -> Column:
    t = trimmed(line)
    return t.startswith("|") & t.endswith("|") & (F.length(t) >= 2)


def is_separator(line: Column | str) -> Column:
    return trimmed(line).rlike(SEPARATOR)


def cells(line: Column | str) -> Column:
    """The cells of a row; all pipes at its ends go, and with them empty cells there."""
    return F.transform(F.split(F.btrim(trimmed(line), F.lit("|")), r"\|"), trimmed)


def fitted(row: Column, width: Column) -> Column:
    """row with exactly width cells."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), width)


def linearized(headers: Column, rows: Column, context: Column) -> Column:
    """A table as text: a label, the headers, and `header: cell` pairs row by row."""
    label = F.when(context != "", F.concat(F.lit(TABLE_LABEL), context, F.lit("]\n"))).otherwise("")
    head = F.concat(F.lit(COLUMNS_LABEL), F.array_join(headers, " | "), F.lit("\n"))
    lines = F.transform(rows, lambda r: F.concat(F.array_join(F.zip_with(headers, r, lambda h, v: F.concat(h, F.lit(": "), v)), ", "), F.lit("\n")))
    return trimmed(F.concat(label, head, F.array_join(lines, "")))


def tables(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, table_no, headers, rows, raw_text, context, start_pos, end_pos, linearized): every pipe table of the bodies.

    Lines are exploded; runs of row-like lines are islands of a window over the document's lines.  The first line of a run
    that a separator follows heads the run's one table.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(body(text), "\n")).alias("i", "line"))
    in_doc = Window.partitionBy("doc_id").orderBy("i")
    above = [F.lag("t", k).over(in_doc) for k in (1, 2, 3)]
    usable = [F.when((x != "") & ~(x.startswith("|") & ~x.startswith("#")), x) for x in above]
    lines = (
        lines.withColumns({"t": trimmed("line"), "row": is_table_row("line"), "sep": is_separator("line")})
        .withColumns(
            {
                "head": F.coalesce(F.lead("sep").over(in_doc), F.lit(False)),
                "run": F.sum(F.when(F.col("row"), 0).otherwise(1)).over(in_doc),
                "pos": F.sum(F.length("line") + 1).over(in_doc) - F.length("line") - 1,
                "above": F.coalesce(*usable, F.lit("")),
            }
        )
        .filter("row")
    )
    in_run = Window.partitionBy("doc_id", "run")
    lines = lines.withColumn("first", F.min(F.when(F.col("head"), F.col("i"))).over(in_run)).filter("i >= first")
    member = F.struct("i", "line", "pos", "above")
    found = lines.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(member)).alias("m"))  # the lines of one table
    top = F.get("m", F.lit(0))
    found = found.withColumns({"headers": cells(top["line"]), "n": F.size("m")})
    ctx = top["above"]
    found = found.select(
        "doc_id",
        top["i"].alias("i"),
        "headers",
        F.transform(F.slice("m", F.lit(3), F.greatest(F.col("n") - 2, F.lit(0))), lambda x: fitted(cells(x["line"]), F.size("headers"))).alias("rows"),
        F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("raw_text"),
        F.when(ctx.startswith("#"), F.ltrim(ctx, F.lit("# "))).otherwise(ctx).alias("context"),
        top["pos"].alias("start_pos"),
        (F.element_at("m", -1)["pos"] + F.length(F.element_at("m", -1)["line"]) + 1).alias("end_pos"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1
    return found.withColumns({"table_no": number, "linearized": linearized(F.col("headers"), F.col("rows"), F.col("context"))}).drop("i")


def _replace_first(t: Column, old: Column, new: Column) -> Column:
    at = F.instr(t, old)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), new, F.substring(t, at + F.length(old), F.length(t)))).otherwise(t)


def with_images_named(c: Column | str) -> Column:
    """Image references as their label and alternative text."""
    t = F.regexp_replace(column(c), r"!\[\]\(([^)]+)\)", f"{IMAGE_LABEL}]")
    return F.regexp_replace(t, IMAGE, f"{IMAGE_LABEL}: $1]")


def enhanced(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `enhanced`: tables linearised in place (each its first occurrence), images named."""
    # the tables of one document, in order
    own = tables(docs, text, doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "raw_text", "linearized"))).alias("_tables"))
    joined = docs.join(own.withColumnRenamed("doc_id", "_id"), F.col(doc_id) == F.col("_id"), "left").drop("_id")
    none = F.array().cast("array<struct<table_no:int,raw_text:string,linearized:string>>")
    flat = F.aggregate(F.coalesce("_tables", none), F.col(text), lambda t, x: _replace_first(t, x["raw_text"], x["linearized"]))
    return joined.withColumn("enhanced", with_images_named(flat)).drop("_tables")


def metadata(c: Column | str) -> Column:
    """struct(title, author, tags, language, word_count, char_count, image_count)."""
    fm = front_matter(c)
    return F.struct(
        title(c).alias("title"), fm["author"].alias("author"), fm["tags"].alias("tags"), fm["language"].alias("language"),
        word_count(c).alias("word_count"), char_count(c).alias("char_count"), F.size(images(body(c))).alias("image_count"),
    )
