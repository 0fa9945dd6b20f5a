"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a Column over one document, every rule is a row (name, metric,
lowest, highest) of RULES, and `verdict` folds the table into one boolean
expression.  No user function, no shuffle, no state: each document is judged in
the task that reads it.

Null text counts as a text without words; documents under `min_words` fail the
base test, so null, empty and blank texts have base_failed = true, kept = false.
Ties and repeated rows are judged row by row.  Other columns pass through `judge`; those named as a metric, base_failed or
kept are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is was for on as this "
    "de la le les et des est un une que pour dans "
    "der die und das den von zu mit ist ein sich "
    "el los las en por con del se una"
).split()

#: name, metric, lowest allowed, highest allowed (None: open).
RULES = (
    ("word_count", "n_words", 50, 100_000),
    ("word_length", "mean_word_chars", 2.5, 12.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)

BLANK = r"[ \t-\r]+"
#: Names of the arrays between the two layers; no input column has them.
WORDS, LINES = "quality_rules:words", "quality_rules:lines"


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list."""

    def of(w: Column) -> Column:
        n = F.size(w)
        # xxhash64 of the three words; 64 bits keep windows of one text apart
        marks = F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )
        return F.when(n < 3, F.lit(0)).otherwise(_bind(marks, covered))

    def covered(marks: Column) -> Column:
        tagged = F.array_sort(F.transform(marks, lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0)).otherwise(_bind(tagged, spread))

    def spread(s: Column) -> Column:
        twin = lambda x, j: (F.get(s, j - 1)["m"] == x["m"]) | (F.get(s, j + 1)["m"] == x["m"])
        starts = F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
        # consecutive windows overlap: each adds what it covers beyond the one before
        fold = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), fold)["n"]

    return _bind(words, of)


def metrics(text: str = "text") -> dict[str, Column]:
    """Columns by metric, in two layers: arrays first, then numbers."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {
        WORDS: F.filter(F.split(t, BLANK), lambda w: w != ""),
        LINES: F.filter(F.split(t, "\n"), lambda x: F.rtrim(F.regexp_replace(x, BLANK, " ")) != ""),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and ratios that the rules read."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    found = docs.withColumns(metrics(text)).withColumns(
        {
            "n_words": F.size(WORDS).cast("long"),
            "word_chars": F.aggregate(WORDS, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_stop": F.size(F.filter(WORDS, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size(LINES).cast("long"),
            "n_dup_lines": (F.size(LINES) - F.size(F.array_distinct(LINES))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(WORDS)).cast("long"),
            "n_bullets": F.size(F.filter(LINES, lambda x: x.rlike(r"^[ \t]*[-*•]"))).cast("long"),
            "n_ellipses": F.size(F.filter(LINES, lambda x: x.rlike(r"(\.\.\.|…)[ \t]*$"))).cast("long"),
        }
    )
    return found.drop(WORDS, LINES).withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbols_per_word": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "bullet_line_ratio": ratio("n_bullets", "n_lines"),
            "ellipsis_line_ratio": ratio("n_ellipses", "n_lines"),
        }
    )


def verdict(rules=RULES) -> Column:
    """The table as one predicate: every rule holds."""
    ok = F.lit(True)
    for _, metric, lowest, highest in rules:
        if lowest is not None:
            ok = ok & (F.col(metric) >= lowest)
        if highest is not None:
            ok = ok & (F.col(metric) <= highest)
    return ok


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with all metrics, base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules(rules=RULES) -> str:
    both = [(m, ">=", low) for _, m, low, _ in rules if low is not None] + [(m, "<=", high) for _, m, _, high in rules if high is not None]
    return " AND ".join(f"{m} {op} {v}" for m, op, v in both)


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words,
             coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda y: lower(y) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop,
             len(list_filter(l, lambda y: regexp_matches(y, '^[ \t]*[-*•]'))) AS n_bullets,
             len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…)[ \t]*$'))) AS n_ellipses,
             coalesce(r.n_repeat_words, 0) AS n_repeat_words
      FROM a LEFT JOIN r ON a.doc_id = r.doc_id),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
             coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
             coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
             coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio,
             coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept
FROM q
"""
