"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (target share / present share, times
`budget`).  A document's number of copies is the Poisson quantile of a uniform
number hashed from its doc_id and the seed, so a rerun or a lost executor gives
the same copies.  A rate of any size is drawn: beyond PART it is the sum of as many equal parts, each at most PART and
each inverted at a uniform number of its own (a sum of Poisson numbers is one).
Copies are exploded and dealt to partitions and ordered by a
hash of (doc_id, copy, seed): a global shuffle in one exchange, with no hot key,
since the exchange key is that hash and never the source.

Shares are measured in characters of text.  Default targets flatten the present
mix: weight = sqrt(characters); `weights` maps sources to weights instead, and a
source without a weight gets zero copies.  Weights are summed as decimals, in any order alike.  Rows of one doc_id draw the same
number.  A null source is a source of its own; null or empty texts belong to their source
and are drawn at its rate; a source without any character has rate `budget`.
An empty table gives no rows.  Other columns pass through; copy_no, n_copies and shuffle_key replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tables import unused

SEED = 17
#: A rate beyond this is drawn in parts: exp(-rate) must stay within the range of doubles.
PART = 500.0
#: Copies in one array at most.
BLOCK = 4096


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of an md5, the same in any engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts], F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def parts(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until beyond rate + 12 deviations + 20."""
    ks = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    first = F.exp(-rate)
    zero = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(ks, zero, step)["all"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each source: its rate.  Sums are partial in every task, so a hot source adds one row a task."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("_chars"))
    if weights is None:
        weight = F.sqrt(F.col("_chars").cast("double"))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.when(F.col("_source").isNotNull(), F.try_element_at(table, F.col("_source"))).cast("double"), F.lit(0.0))
    sizes = sizes.withColumn("_weight", weight.cast("decimal(38,9)"))
    total = sizes.agg(F.sum("_chars").alias("_all_chars"), F.sum("_weight").cast("double").alias("_all_weight"))
    rate = F.when(F.col("_chars") == 0, F.lit(budget)).otherwise(
        F.coalesce(F.try_divide(F.col("_weight").cast("double") * F.col("_all_chars") * budget, F.col("_all_weight") * F.col("_chars")), F.lit(0.0))
    )
    # `total` is an aggregate without keys: one row, whatever the input
    return sizes.crossJoin(F.broadcast(total)).select("_source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = SEED, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs replicated and shuffled, with copy_no (from 1), n_copies and shuffle_key."""
    kept = [c for c in docs.columns if c.lower() not in ("copy_no", "n_copies", "shuffle_key")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    own_source, steps, n_parts, block = unused(docs, "own_source", "steps", "n_parts", "block")
    table = rates(docs, weights, budget, source, text).select(
        F.col("_source").alias(own_source), poisson_steps(F.col("rate") / parts(F.col("rate"))).alias(steps), parts(F.col("rate")).alias(n_parts)
    )
    # one row a source: Spark broadcasts it while it is small, and else splits a hot source's partition
    drawn = docs.join(table, docs[source].eqNullSafe(table[own_source]), "inner")
    below = lambda u: F.size(F.filter(steps, lambda c: c < u))
    more = F.transform(F.sequence(F.lit(2), n_parts), lambda j: below(uniform(F.col(doc_id), j, seed=seed)))
    copies = below(uniform(F.col(doc_id), seed=seed)) + F.when(F.col(n_parts) > 1, F.aggregate(more, F.lit(0), lambda a, x: a + x)).otherwise(0)
    out = drawn.withColumn("n_copies", copies).drop(steps, n_parts, own_source).filter("n_copies > 0")
    # copies by blocks: a document with very many never has them all in one array
    out = out.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / BLOCK).cast("int"))))
    first = F.col(block) * BLOCK + 1
    out = out.withColumn("copy_no", F.explode(F.sequence(first, F.least("n_copies", first + BLOCK - 1)))).drop(block)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col("copy_no").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    return out.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*[F.col(f"`{c}`") for c in kept], "copy_no", "n_copies", "shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", F.length("text").cast("long").alias("chars"), "copy_no", "n_copies", "shuffle_key")


ORACLE_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
z AS (SELECT sum(chars) AS all_chars, sum(sqrt(chars)) AS all_weight FROM s),
r AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE sqrt(chars) * all_chars / (all_weight * chars) END AS rate FROM s, z),
m AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS n, rate / greatest(1, ceil(rate / {PART})) AS rate FROM r),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM m),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
d AS (SELECT doc_id, d.source, length(text) AS chars, unnest(range(1, n + 1)) AS j FROM documents d JOIN m ON m.source IS NOT DISTINCT FROM d.source),
u AS (SELECT doc_id, source, chars, (('0x' || substring(md5(doc_id::VARCHAR || CASE WHEN j > 1 THEN ':' || j ELSE '' END || ':{SEED}'), 1, 12))::BIGINT + 0.5) / {float(1 << 48)} AS u FROM d),
e AS (SELECT u.doc_id, u.source, u.chars, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c < u.u) AS x FROM u),
n AS (SELECT doc_id, source, chars, sum(x)::INT AS n_copies FROM e GROUP BY ALL)
SELECT doc_id, source, chars, copy_no, n_copies,
       ('0x' || substring(md5(doc_id::VARCHAR || ':' || copy_no::VARCHAR || ':{SEED}'), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy_no FROM n)
"""
