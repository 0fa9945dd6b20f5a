"""Line dedup by distinct-site spread.

A line's spread is the number of sites (sources) that carry it.  Lines are hashed
(trimmed, 128 bits); HyperLogLog sketches of sites by line hash are built in each task and
merged by aggregation, so a line on a third of all rows is one small sketch a
task.  Lines whose estimate lies within `margin` of the threshold are counted
exactly; the others keep the estimate's verdict.  A line with spread of at least
`min_sites` is boilerplate: it stays in the document with the smallest doc_id
that has it and goes from all others, so nothing vanishes from the corpus.

Lines are cut at \n; blank lines are never removed.  A document that loses all its lines
with text is dropped by `clean` (its text is kept elsewhere).  Null and empty
texts pass unchanged.  A null source counts as a site of its own.  Rows that
repeat a doc_id are treated alike, by hash of the line.  Other columns pass through, whatever their names, but n_removed_lines and
n_left_lines are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tables import unused

MIN_SITES = 10
MARGIN = 0.25
LG_K = 10


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def line_hash(line: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("2"), line).alias("b"))


def _lines(docs: DataFrame, text: str) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trimmed)), lambda x: x != "")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Rows (_line, spread, exact, first_doc) of the lines on at least min_sites sites."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    occ = docs.select(F.col(doc_id).alias("_doc"), site.alias("_site"), F.explode(F.transform(_lines(docs, text), line_hash)).alias("_line"))
    sketched = (
        occ.groupBy("_line")
        .agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"), F.min("_doc").alias("first_doc"))
        .withColumn("_estimate", F.hll_sketch_estimate("_sketch"))
        .drop("_sketch")
        .filter(F.col("_estimate") >= min_sites * (1 - margin))
        .withColumn("_near", F.col("_estimate") <= min_sites * (1 + margin))
    )
    # distinct (line, site) rows are dealt by both, then counted in each task: a line on very many sites is one row a task
    exact = occ.groupBy("_line", "_site").agg(F.lit(1).alias("_one")).groupBy("_line").agg(F.count(F.lit(1)).alias("_count"))
    judged = sketched.join(exact, "_line").withColumn("_exact", F.when(F.col("_near"), F.col("_count"))).withColumn("spread", F.coalesce("_exact", "_estimate"))
    return judged.filter(F.col("spread") >= min_sites).select("_line", "spread", F.col("_exact").isNotNull().alias("exact"), "first_doc")


def removals(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Rows (_doc, _gone): for each document that loses lines, their hashes."""
    found = boilerplate(docs, min_sites, margin, text, source, doc_id)
    occ = docs.select(F.col(doc_id).alias("_doc"), F.explode(F.transform(_lines(docs, text), line_hash)).alias("_line"))
    # a hot line's occurrences are an inner join's large side, which Spark splits
    hits = occ.join(found.select("_line", "first_doc"), "_line").filter(~F.col("_doc").eqNullSafe(F.col("first_doc")))
    return hits.groupBy("_doc").agg(F.collect_set("_line").alias("_gone"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, text: str = "text", source: str = "source", doc_id: str = "doc_id", drop_empty: bool = True, n_chars: str | None = "n_chars") -> DataFrame:
    """docs with `text` cleaned, and n_removed_lines, n_left_lines."""
    gone = removals(docs, min_sites, margin, text, source, doc_id)
    columns = [c for c in docs.columns if c not in ("n_removed_lines", "n_left_lines")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    _doc, _gone, _kept = unused(docs, "doc_of", "gone", "kept")
    gone = gone.withColumnsRenamed({"_doc": _doc, "_gone": _gone})
    joined = docs.join(gone, docs[doc_id] == gone[_doc], "left").drop(_doc)
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(_gone), line_hash(trimmed(x))))
    text_lines = lambda a: F.size(F.filter(a, lambda x: trimmed(x) != ""))
    hit = F.col(_gone).isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(_kept, F.when(hit, kept))
    out = out.withColumns(
        {
            "n_removed_lines": F.when(hit, (F.size(lines) - F.size(_kept)).cast("long")).otherwise(F.lit(0).cast("long")),
            "n_left_lines": text_lines(F.when(hit, F.col(_kept)).otherwise(F.coalesce(lines, F.array().cast("array<string>")))).cast("long"),
        }
    ).withColumn(text, F.when(hit, F.array_join(_kept, "\n")).otherwise(F.col(text)))
    if n_chars and n_chars in columns:
        out = out.withColumn(n_chars, F.when(hit, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    out = out.drop(_kept, _gone)
    if drop_empty:
        out = out.filter((F.col("n_removed_lines") == 0) | (F.col("n_left_lines") > 0))
    return out.select(*[F.col(f"`{c}`") for c in columns], "n_removed_lines", "n_left_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean(docs, drop_empty=False).select("doc_id", "n_removed_lines", "n_left_lines", F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
t AS (SELECT *, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first_doc FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= {MIN_SITES}),
j AS (SELECT t.*, b.k IS NOT NULL AND b.first_doc <> t.doc_id AS gone FROM t LEFT JOIN b ON t.k = b.k),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed_lines, count(*) FILTER (NOT gone AND k <> '') AS n_left_lines,
             coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') AS y FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_left_lines, 0) AS n_left_lines,
       CASE WHEN d.text IS NOT NULL THEN length(g.y) END AS chars_left, CASE WHEN d.text IS NOT NULL THEN md5(g.y) END AS text_md5
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
