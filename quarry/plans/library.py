"""Registered queries: each operator over the standard tables, with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import ChunkingConfig, RerankConfig
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunking, embedding, markdown, pdf, prompt, providers, rerank, search
from quarry.sources import documents as sources
from quarry.sources import store
from quarry.streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectors and retrieval


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _probe(spark, d, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


DIST = "1 - list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[])"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query(f"SELECT vec_id AS chunk_id, round({DIST}, 6) + 0.0 AS distance FROM embeddings e ORDER BY {DIST}, vec_id LIMIT 10")
def knn_cosine_flat(spark, d):
    return _rounded(search.knn(_vectors(spark, d), _probe(spark, d), 10).select("chunk_id", "distance"), "distance")


@query(f"SELECT vec_id AS chunk_id, label, round({DIST}, 6) + 0.0 AS distance FROM embeddings e WHERE label IN (1, 3, 5) ORDER BY {DIST}, vec_id LIMIT 10")
def knn_filtered(spark, d):
    rows = search.knn(_vectors(spark, d), _probe(spark, d), 10, where=F.col("label").isin(1, 3, 5))
    return _rounded(rows.select("chunk_id", "label", "distance"), "distance")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, e.vec_id AS chunk_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], v::DOUBLE[]) AS distance FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM p)
SELECT query_id, chunk_id, rank, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 5
""")
def knn_join(spark, d):
    queries = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = search.knn_join(_vectors(spark, d), queries, 5)
    return _rounded(rows.select("query_id", "chunk_id", "rank", "distance"), "distance")


@query(f"""
SELECT label AS user_id, vec_id AS chunk_id, round(x, 6) + 0.0 AS distance FROM
(SELECT label, vec_id, {DIST} AS x, row_number() OVER (PARTITION BY label ORDER BY {DIST}, vec_id) AS r FROM embeddings e) WHERE r <= 3
""")
def knn_per_tenant(spark, d):
    rows = _vectors(spark, d).withColumn("distance", V.cosine_distance("vector", search.vector_literal(_probe(spark, d))))
    w = Window.partitionBy("label").orderBy("distance", "chunk_id")
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return _rounded(rows.select(F.col("label").alias("user_id"), "chunk_id", "distance"), "distance")


@query(f"""
SELECT vec_id AS chunk_id, round(1 - x / 2, 6) AS relevance_score FROM
(SELECT vec_id, {DIST} AS x FROM embeddings e ORDER BY x, vec_id LIMIT 50) WHERE 1 - x / 2 >= 0.6
""")
def knn_min_score(spark, d):
    rows = search.scored(search.knn(_vectors(spark, d), _probe(spark, d), 50), 0.6)
    return rows.select("chunk_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(f"SELECT vec_id AS chunk_id, round(1 - ({DIST}) / 2, 6) AS relevance_score FROM embeddings e")
def relevance_score(spark, d):
    rows = _vectors(spark, d).withColumn("distance", V.cosine_distance("vector", search.vector_literal(_probe(spark, d))))
    return search.scored(rows).select("chunk_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(f"""
SELECT vec_id AS chunk_id, round(1 - x / 2, 6) AS relevance_score FROM
(SELECT vec_id, {DIST} AS x FROM embeddings e ORDER BY x, vec_id LIMIT 20) ORDER BY x, vec_id LIMIT 5
""")
def recall_then_rerank(spark, d):
    k = rerank.recall_k(RerankConfig(enabled=True, recall_k=0), 5)
    rows = search.scored(search.knn(_vectors(spark, d), _probe(spark, d), k))
    return rerank.by_score(rows, 5).select("chunk_id", F.round("relevance_score", 6).alias("relevance_score"))


@query("SELECT vec_id AS chunk_id, (100000 - vec_id) / 100000.0 AS relevance_score FROM embeddings ORDER BY vec_id LIMIT 5")
def rerank_by_model_scores(spark, d):
    rows = _vectors(spark, d).select("chunk_id", F.col("chunk_id").alias("position"))
    given = rows.select("position").union(rows.select(-1 - F.col("position")))  # half of the positions are out of range
    scores = given.select("position", ((100000 - F.abs("position")) / 100000.0).alias("score"))
    return rerank.apply_scores(rows, scores, 5).select("chunk_id", "relevance_score")


@query()
def ann_ivf(spark, d):
    index = search.IvfIndex(_vectors(spark, d), cells=16)
    queries = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _rounded(index.search_join(queries, 5, probes=6).select("query_id", "chunk_id", "rank", "distance"), "distance")


@query()
def vector_codec(spark, d):
    return _vectors(spark, d).select("chunk_id", F.length(V.to_bytes("vector")).alias("n_bytes"), (V.from_bytes(V.to_bytes("vector")) == F.col("vector")).alias("same"))


TERMS = "the of"


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'of')) AS f2 FROM t),
a AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM c),
s AS (SELECT doc_id, ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))
           + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, a WHERE f1 > 0 AND f2 > 0)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20
""")
def bm25_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.bm25(docs, TERMS, 20, "text", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings QUALIFY rank <= 15),
b AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings QUALIFY rank <= 30),
u AS (SELECT chunk_id, 0.7 / (60 + rank) AS s FROM a UNION ALL SELECT chunk_id, 0.3 / (60 + rank) FROM b)
SELECT chunk_id, round(sum(s), 9) AS score FROM u GROUP BY chunk_id ORDER BY sum(s) DESC, chunk_id LIMIT 10
""")
def rrf_merge(spark, d):
    rows = _vectors(spark, d)
    a = search.ranked(rows.orderBy("label", "chunk_id").limit(15), F.col("label"), F.col("chunk_id"))
    b = search.ranked(rows.orderBy(F.desc("chunk_id")).limit(30), F.desc("chunk_id"))
    return search.rrf(a, b, 10).select("chunk_id", F.round("score", 9).alias("score"))


@query(rf"""
WITH v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY {DIST}, vec_id) AS rank FROM embeddings e JOIN documents ON doc_id = vec_id QUALIFY rank <= 15),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents JOIN embeddings ON doc_id = vec_id),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS f FROM t),
a AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f > 0) AS d FROM c),
s AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) DESC, doc_id) AS rank
      FROM c, a WHERE f > 0 QUALIFY rank <= 45),
u AS (SELECT chunk_id, 0.7 / (60 + rank) AS s FROM v UNION ALL SELECT chunk_id, 0.3 / (60 + rank) FROM s)
SELECT chunk_id, round(sum(s), 9) AS score FROM u GROUP BY chunk_id ORDER BY sum(s) DESC, chunk_id LIMIT 5
""")
def hybrid_search(spark, d):
    rows = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id")
    return search.hybrid(rows, "the", _probe(spark, d), 5).select("chunk_id", F.round("score", 9).alias("score"))


# ---- text

TRIM = r"'^[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'"
VOTES = r"""(regexp_matches(t, '(?m)^#{1,6}[\t\n\f\r ]')::INT + regexp_matches(t, '(?m)^```')::INT + regexp_matches(t, '(?m)^\*[\t\n\f\r ]')::INT
 + regexp_matches(t, '(?m)^-[\t\n\f\r ]')::INT + regexp_matches(t, '(?m)^[0-9]+\.[\t\n\f\r ]')::INT + regexp_matches(t, '\[.*\]\(.*\)')::INT
 + regexp_matches(t, '\*\*.*\*\*')::INT + regexp_matches(t, '__.*__')::INT)"""
BOTH = "(SELECT 'd' || doc_id AS id, text AS x FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)"


def _both(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("x"))
    return docs.union(table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html"))


@query(f"""
SELECT id, CASE WHEN starts_with(t, '<!DOCTYPE') OR starts_with(t, '<html') OR starts_with(t, '<HTML') THEN 'html' WHEN {VOTES} >= 2 THEN 'markdown' ELSE 'text' END AS format
FROM (SELECT id, regexp_replace(x, {TRIM}) AS t FROM {BOTH})
""")
def detect_format(spark, d):
    return _both(spark, d).select("id", T.detect_format("x").alias("format"))


@query(f"SELECT id, {VOTES} AS votes FROM (SELECT id, regexp_replace(x, {TRIM}) AS t FROM {BOTH})")
def md_votes(spark, d):
    return _both(spark, d).select("id", T.markdown_votes("x").alias("votes"))


@query(f"SELECT page_id, regexp_replace(regexp_extract(html, '(?i)<title[^>]*>(.*?)</title>', 1), {TRIM}) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title("html").alias("title"))


def _html_sql() -> str:
    t = "html"
    for tag in ("script", "style", "noscript"):
        t = f"regexp_replace({t}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:{'|'.join(T.BLOCK_TAGS)})[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for name, char in T.ENTITIES:
        t = f"replace({t}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace({t}, '[\\t\\n\\f\\r ]{{3,}}', ' ', 'g'), {TRIM})"


@query(f"SELECT page_id, {_html_sql()} AS content FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text("html").alias("content"))


CJK = r"length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g'))"
WORDS = rf"({CJK} + len(list_filter(regexp_split_to_array(t, '[ \n\t\r]+'), lambda x: regexp_matches(x, '[A-Za-z0-9][^\x{{4e00}}-\x{{9fff}}]*$'))))::INT"
TOKENS = rf"(floor({CJK} / 1.5) + floor(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / 4.0) + 1)::INT"


@query(f"SELECT page_id, {WORDS} AS word_count, length(t)::INT AS char_count FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def html_counts(spark, d):
    return table(spark, d, "pages").withColumn("t", T.html_text("html")).select("page_id", T.word_count("t").alias("word_count"), T.char_count("t").alias("char_count"))


@query(f"SELECT doc_id, {WORDS} AS word_count, length(t)::INT AS char_count, {TOKENS} AS token_count FROM (SELECT doc_id, text AS t FROM documents)")
def doc_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("word_count"), T.char_count("text").alias("char_count"), T.token_estimate("text").alias("token_count"))


HASH = f"sha256(regexp_replace(text, {TRIM}))"


@query(f"SELECT doc_id, {HASH} AS hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("SELECT doc_id, octet_length(encode(text)) <= 4096 AS ok FROM documents")
def size_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", T.size_ok("text", 4096).alias("ok"))


@query(f"SELECT {HASH} AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_docs(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


PRINTABLE = "".join(map(chr, range(32, 127)))


@query("SELECT n_nationkey, regexp_replace(n_name || '" + PRINTABLE.replace("'", "''") + "', '([,.<>{}\\[\\]\"'':;!@#$%^&*()\\-+=~|/\\\\ ])', '\\\\\\1', 'g') AS escaped FROM nation")
def tag_escape(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.escape_tag(F.concat("n_name", F.lit(PRINTABLE))).alias("escaped"))


def _escape_sql() -> str:
    t = "n_name || ' {a}\\b:c'"
    for x in T.QUERY_SPECIALS:
        t = f"replace({t}, '{x}', '\\{x}')"
    return t


@query(f"SELECT n_nationkey, {_escape_sql()} AS escaped FROM nation")
def query_escape(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.escape_query(F.concat("n_name", F.lit(" {a}\\b:c"))).alias("escaped"))


@query("SELECT c_custkey, 'rag_user_' || c_custkey || ':idx' AS index_name, 'rag_user_' || c_custkey || ':' AS prefix FROM customer")
def index_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.index_name("c_custkey").alias("index_name"), T.index_name("c_custkey", "rag_user_%d:").alias("prefix"))


# ---- embedding and cache


@query(r"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
h AS (SELECT item_id, ('0x' || substring(md5(w), 1, 7))::BIGINT AS h FROM w)
SELECT item_id, (h % 64)::INT AS place, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value FROM h GROUP BY 1, 2 HAVING sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) <> 0
""")
def hashed_embedding(spark, d):
    v = table(spark, d, "benchmark").select("item_id", F.posexplode(V.hashed_embedding("text", 64)).alias("place", "value"))
    return v.filter("value <> 0").select("item_id", "place", F.col("value").cast("double").alias("value"))


CACHE_SQL = f"d AS (SELECT doc_id, text, {HASH} AS hash FROM documents), c AS (SELECT DISTINCT hash FROM d WHERE doc_id % 3 = 0)"


def _cache(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = docs.filter("doc_id % 3 = 0").select(T.content_hash("text").alias("hash")).distinct().withColumn("vector", F.lit([1.0]).cast("array<float>"))
    return docs, known


@query(f"WITH {CACHE_SQL} SELECT d.doc_id, c.hash IS NOT NULL AS hit FROM d LEFT JOIN c ON d.hash = c.hash")
def cache_split(spark, d):
    hits, misses = embedding.split_by_cache(*_cache(spark, d))
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query(f"WITH {CACHE_SQL} SELECT d.doc_id, d.hash, c.hash IS NOT NULL AS cached, CASE WHEN c.hash IS NOT NULL THEN 1 ELSE 64 END::INT AS dim FROM d LEFT JOIN c ON d.hash = c.hash")
def cached_embed_merge(spark, d):
    rows, _ = embedding.embed_cached(*_cache(spark, d), lambda c: V.hashed_embedding(c, 64))
    return rows.select("doc_id", "hash", "cached", F.size("vector").alias("dim"))


@query(f"WITH {CACHE_SQL} SELECT count(*) FILTER (c.hash IS NOT NULL) AS hits, count(*) FILTER (c.hash IS NULL) AS misses, round(count(*) FILTER (c.hash IS NOT NULL) * 100.0 / count(*), 6)::DOUBLE AS hit_rate FROM d LEFT JOIN c ON d.hash = c.hash")
def cache_stats(spark, d):
    s = embedding.cache_stats(cache_split(spark, d))
    return s.select("hits", "misses", F.round("hit_rate", 6).cast("double").alias("hit_rate"))


NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@query(f"""
SELECT user_id AS hash, max(ts) AS last_access FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL 30 MINUTE > {NOW} ORDER BY max(ts) DESC, user_id LIMIT 50
""")
def lru_keep(spark, d):
    entries = table(spark, d, "events").groupBy(F.col("user_id").alias("hash")).agg(F.max("ts").alias("last_access"))
    entries = entries.withColumn("expires_at", F.col("last_access") + F.expr("INTERVAL 30 MINUTES"))
    return embedding.kept_entries(entries, 50, _now()).select("hash", "last_access")


@query("SELECT doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10)::INT AS batch_no FROM documents")
def embedding_batches(spark, d):
    return embedding.batches(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 10, "source").select("doc_id", "batch_no")


# ---- chunking


@query(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {TRIM})), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, unnest(range(len(l)))::INT AS chunk_index, unnest(l) AS content FROM p
""")
def split_paragraphs(spark, d):
    return chunking.split_at(table(spark, d, "documents"), "\n")


FIXED = "f AS (SELECT doc_id, text, unnest(range(0, floor((length(text) - 1) / 1000)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0), g AS (SELECT doc_id, i::INT AS chunk_index, substring(text, i * 1000 + 1, 1000) AS content FROM f)"


@query(f"WITH {FIXED} SELECT * FROM g")
def split_fixed(spark, d):
    return chunking.split_fixed(table(spark, d, "documents"), 1000)


@query(f"""
WITH {FIXED} SELECT doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN content ELSE right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), 200) || chr(10) || content END AS content FROM g
""")
def overlap_chunks(spark, d):
    return chunking.with_overlap(split_fixed(spark, d), 200)


@query(f"SELECT doc_id, 0 AS chunk_index, text AS content, 0 AS start_pos, length(text)::INT AS end_pos, {TOKENS.replace('(t,', '(text,')} AS token_count FROM documents WHERE length(text) <= 1000")
def single_chunk_docs(spark, d):
    return chunking.chunk(table(spark, d, "documents").filter(F.char_length("text") <= 1000))


@query()
def chunk_document(spark, d):
    return chunking.chunk(table(spark, d, "documents"))


@query()
def chunk_structured(spark, d):
    return chunking.chunk_structured(_markdown(spark, d), ChunkingConfig(max_chunk_size=200, min_chunk_size=50, overlap_size=50))


# ---- Markdown, synthesised from region and nation

MD_SQL = """
n AS (SELECT n_regionkey, string_agg('| ' || n_name || ' | ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' ||' ELSE ' | |' END, chr(10) ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey),
md AS (SELECT r_regionkey AS doc_id, '---' || chr(10) || 'title: ' || r_name || ' report' || chr(10) || 'author: team ' || r_regionkey || chr(10) || 'tags: [geo, r' || r_regionkey || ']' || chr(10)
  || 'lang: en' || chr(10) || '---' || chr(10) || '# Region ' || r_name || chr(10) || chr(10) || 'Nations of **' || r_name || '**.' || chr(10) || '![map](http://x/' || r_regionkey || '.png)' || chr(10)
  || '## Nations' || chr(10) || chr(10) || 'Table of nations' || chr(10) || chr(10) || '| name | key | note |' || chr(10) || '|---|:---:|---|' || chr(10) || rows || chr(10) || chr(10) || '## End' || chr(10)
  || 'text [link](u) ![](http://y) tail' || chr(10) AS text FROM region JOIN n ON r_regionkey = n_regionkey),
mb AS (SELECT doc_id, text, regexp_replace(text, '(?s)^---\\n(.+?)\\n---', '') AS b FROM md)
"""
HEAD = r"'(?m)^(#{1,6})[\t\n\f\r ]+(.+)$'"


def _markdown(spark, d) -> DataFrame:
    end = F.when(F.col("n_nationkey") % 2 == 0, " ||").otherwise(" | |")
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), end)
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("m"))
    rows = rows.select("n_regionkey", F.array_join(F.transform("m", lambda x: x["l"]), "\n").alias("rows"))
    key = F.col("r_regionkey").cast("string")
    text = F.concat(
        F.lit("---\ntitle: "), "r_name", F.lit(" report\nauthor: team "), key, F.lit("\ntags: [geo, r"), key, F.lit("]\nlang: en\n---\n# Region "), "r_name",
        F.lit("\n\nNations of **"), "r_name", F.lit("**.\n![map](http://x/"), key, F.lit(".png)\n## Nations\n\nTable of nations\n\n| name | key | note |\n|---|:---:|---|\n"), "rows",
        F.lit("\n\n## End\ntext [link](u) ![](http://y) tail\n"),
    )
    return table(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), text.alias("text"))


@query(f"""
WITH {MD_SQL}, s AS (SELECT doc_id, regexp_extract_all(b, {HEAD}, 1) AS m, regexp_extract_all(b, {HEAD}, 2) AS t, regexp_split_to_array(b, {HEAD}) AS p FROM mb)
SELECT doc_id, unnest(t) AS title, unnest(list_transform(m, lambda x: length(x)))::INT AS level, unnest(list_transform(p[2:], lambda x: regexp_replace(x, {TRIM}))) AS content FROM s
""")
def md_sections(spark, d):
    return _markdown(spark, d).select("doc_id", F.inline(markdown.sections("text"))).select("doc_id", "title", "level", "content")


@query(f"WITH {MD_SQL} SELECT doc_id, unnest(regexp_extract_all(b, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1)) AS alt_text, unnest(regexp_extract_all(b, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS url FROM mb")
def md_images(spark, d):
    return _markdown(spark, d).select("doc_id", F.inline(markdown.images(markdown.body("text"))))


@query(f"WITH {MD_SQL} SELECT doc_id, regexp_extract(text, 'title: (.*)', 1) AS title, regexp_extract(text, 'author: (.*)', 1) AS author, 'geo,r' || doc_id AS tags, 'en' AS language FROM md")
def md_frontmatter(spark, d):
    fm = _markdown(spark, d).select("doc_id", markdown.front_matter("text").alias("f"))
    return fm.select("doc_id", "f.title", "f.author", F.array_join("f.tags", ",").alias("tags"), "f.language")


MD_TABLE = f"""
ml AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS l, unnest(range(len(string_split(b, chr(10))))) AS i FROM mb),
mt AS (SELECT doc_id, i, l, list_transform(string_split(trim(l, '|'), '|'), lambda x: trim(x)) AS c FROM ml WHERE starts_with(l, '|')),
mh AS (SELECT doc_id, min(i) AS h FROM mt GROUP BY doc_id),
mr AS (SELECT mt.doc_id, i, l, list_resize(c, 3, '') AS c FROM mt JOIN mh USING (doc_id) WHERE i >= h + 2),
mx AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS raw_text, count(*) - 2 AS n_rows FROM mt GROUP BY doc_id),
my AS (SELECT doc_id, '[表格: Table of nations]' || chr(10) || '列: name | key | note' || chr(10) || string_agg('name: ' || c[1] || ', key: ' || c[2] || ', note: ' || c[3], chr(10) ORDER BY i) AS linearized FROM mr GROUP BY doc_id)
"""


@query(f"WITH {MD_SQL}, {MD_TABLE} SELECT doc_id, 'name|key|note' AS headers, n_rows, raw_text, 'Table of nations' AS context FROM mx")
def md_tables(spark, d):
    t = markdown.tables(_markdown(spark, d))
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("long").alias("n_rows"), "raw_text", "context")


@query(f"WITH {MD_SQL}, {MD_TABLE} SELECT doc_id, regexp_replace(linearized, {TRIM}) AS linearized FROM my")
def md_linearize(spark, d):
    return markdown.tables(_markdown(spark, d)).select("doc_id", "linearized")


@query(f"""
WITH {MD_SQL}, {MD_TABLE} SELECT doc_id, replace(replace(replace(text, raw_text, regexp_replace(linearized, {TRIM})), '![map](http://x/' || doc_id || '.png)', '[图片: map]'), '![](http://y)', '[图片]') AS enhanced
FROM md JOIN mx USING (doc_id) JOIN my USING (doc_id)
""")
def md_enhance(spark, d):
    return markdown.enhanced(_markdown(spark, d)).select("doc_id", "enhanced")


# ---- PDF, from rows that a reader would give


@query("SELECT id, starts_with(c, 'base64:') OR starts_with(c, 'data:application/pdf') OR starts_with(c, 'JVBER') AS is_pdf, CASE WHEN id % 4 < 3 THEN '%PDF-1.4 ' || id END AS head FROM (SELECT r_regionkey AS id, CASE r_regionkey % 4 WHEN 0 THEN 'base64:' WHEN 1 THEN 'data:application/pdf;base64,' WHEN 2 THEN 'JVBER' ELSE 'plain' END AS c FROM region)")
def pdf_decode(spark, d):
    k = F.col("r_regionkey")
    raw = F.base64(F.encode(F.concat(F.lit("%PDF-1.4 "), k.cast("string")), "utf-8"))
    c = F.when(k % 4 == 0, F.concat(F.lit("base64:"), raw)).when(k % 4 == 1, F.concat(F.lit("data:application/pdf;base64,"), raw)).when(k % 4 == 2, raw).otherwise("plain")
    rows = table(spark, d, "region").select(k.alias("id"), c.alias("c"))
    return rows.select("id", pdf.is_pdf("c").alias("is_pdf"), F.decode(pdf.decoded("c"), "utf-8").alias("head"))


def _pdf_rows(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    cells = F.when(F.col("n_nationkey") % 7 == 6, F.array("n_name")).otherwise(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")))
    return n.select(F.lit("a").alias("doc_id"), (F.floor(F.col("n_nationkey") / 14) + 1).cast("int").alias("page"), (F.col("n_nationkey") % 14).alias("row"), cells.alias("cells"))


@query("""
SELECT (n_nationkey // 14 + 1)::INT AS page, min(n_nationkey % 14)::INT AS first_row, count(*)::INT - 1 AS n_rows, 'PDF 第' || (n_nationkey // 14 + 1) || '页表格' AS context
FROM nation WHERE n_nationkey % 7 <> 6 GROUP BY n_nationkey // 14, n_nationkey // 7 HAVING count(*) >= 3
""")
def pdf_tables(spark, d):
    return pdf.page_tables(_pdf_rows(spark, d)).select("page", "first_row", F.size("rows").alias("n_rows"), "context")


@query("""
SELECT '第' || (n_nationkey // 14 + 1) || '页' AS title, 1 AS level,
string_agg(CASE WHEN n_nationkey % 7 = 6 THEN n_name ELSE n_name || ' ' || n_nationkey || ' ' || n_regionkey END, chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_nationkey // 14
""")
def pdf_sections(spark, d):
    return pdf.page_text(_pdf_rows(spark, d)).select(F.inline(pdf.page_sections("content")))


# ---- prompt, store, JSON

RESULTS_SQL = "res AS (SELECT doc_id AS rank, 'd' || doc_id AS chunk_id, source AS file_id, CASE WHEN source = 'src1' THEN '' ELSE source || '.txt' END AS file_name, (doc_id % 5)::INT AS chunk_index, text AS content, (1000 - doc_id * 7) / 1000.0 AS relevance_score FROM documents)"


def _results(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("rank"), F.concat(F.lit("d"), k.cast("string")).alias("chunk_id"), F.col("source").alias("file_id"), F.when(F.col("source") == "src1", "").otherwise(F.concat("source", F.lit(".txt"))).alias("file_name"),
        (k % 5).cast("int").alias("chunk_index"), F.col("text").alias("content"), ((1000 - k * 7) / 1000.0).alias("relevance_score"),
    )


@query(f"""
WITH {RESULTS_SQL}, top AS (SELECT * FROM res ORDER BY rank LIMIT 20), o AS (SELECT *, min(rank) OVER (PARTITION BY file_id) AS f FROM top), p AS (SELECT *, dense_rank() OVER (ORDER BY f) AS no, first(file_name) OVER (PARTITION BY file_id ORDER BY rank) AS name FROM o),
g AS (SELECT no, '=== 文件 ' || no || ': ' || CASE WHEN min(name) <> '' THEN min(name) ELSE min(file_id) END || ' ===' || chr(10)
  || string_agg('[片段 ' || (chunk_index + 1) || '] (相关度: ' || (round(relevance_score * 1000)::BIGINT // 10) || '.' || (round(relevance_score * 1000)::BIGINT % 10) || '%)' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) || chr(10) AS t FROM p GROUP BY no)
SELECT '{prompt.HEADER}' || string_agg(t, '' ORDER BY no) || '用户问题：what is it?' || chr(10) || chr(10) || '请提供准确、完整的回答：' AS prompt FROM g
""".replace("\n\n'", "' || chr(10) || chr(10)", 1))
def build_prompt(spark, d):
    return prompt.build(_results(spark, d).orderBy("rank").limit(20), "what is it?")


@query(f"WITH {RESULTS_SQL} SELECT chunk_id, file_id, chunk_index, content FROM res")
def json_round_trip(spark, d):
    rows = _results(spark, d)
    listed = sources.as_json(rows.drop("rank")).select(F.concat(F.lit("["), "json", F.lit("]")).alias("json"))
    return sources.from_json(listed).select("chunk_id", "file_id", "chunk_index", "content")


@query("""
WITH v AS (SELECT o_custkey AS file_id, o_orderkey AS chunk_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders)
SELECT file_id, chunk_id FROM v WHERE r = 1
""")
def upsert_latest(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("version"))
    return store.latest(rows, ["file_id"]).select("file_id", "chunk_id")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS v FROM documents")
def upsert_replace(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    old, new = docs.select("doc_id", F.lit(1).alias("v")), docs.filter("lang = 'fr'").select("doc_id", F.lit(2).alias("v"))
    return store.upsert(old, new, ["doc_id"])


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src4') GROUP BY source")
def delete_by_file(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    gone = docs.filter(F.col("source").isin("src1", "src4")).select("source")
    return store.delete_files(docs, gone, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FIXED} SELECT source AS file_id, count(*) AS total_chunks, count(*) FILTER (length(content) > 0) AS indexed FROM g JOIN documents USING (doc_id) GROUP BY source")
def index_summary(spark, d):
    chunks = split_fixed(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return chunks.groupBy(F.col("source").alias("file_id")).agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.length("content") > 0).alias("indexed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN FALSE ELSE o_orderkey % 3 <> 2 OR o_orderkey % 2 = 1 OR o_orderkey % 7 BETWEEN 1 AND 5 END AS migrate FROM orders")
def needs_migration(spark, d):
    k = F.col("o_orderkey")
    version = F.when(k % 5 != 0, k % 3)
    algorithm = F.when(k % 2 == 1, "HNSW").otherwise("FLAT")
    dimension = F.when((k % 7).between(1, 5), 32).when(k % 7 == 6, 64).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", store.needs_migration(version, algorithm, dimension, 2, "FLAT", 64).alias("migrate"))


@query("SELECT c_custkey, 'rag_v2_' || c_custkey || ':' || c_name AS key FROM customer")
def key_rewrite(spark, d):
    key = F.concat(F.lit("rag_v1_"), F.col("c_custkey").cast("string"), F.lit(":"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", store.rewritten_key(key, "rag_v1_", "rag_v2_").alias("key"))


# ---- providers and tasks, over events


def _calls(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("provider"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))


CALLS = "calls AS (SELECT user_id % 20 AS provider, event_id AS seq, event_type <> 'error' AS ok, value AS latency FROM events)"


@query(f"""
WITH {CALLS} SELECT provider, count(*) AS total_requests, count(*) FILTER (ok) AS success_requests, count(*) FILTER (NOT ok) AS failed_requests,
round(count(*) FILTER (ok) * 100.0 / count(*), 6)::DOUBLE AS success_rate, round(sum(latency) / count(*) FILTER (ok), 6) AS avg_latency,
CASE WHEN count(*) FILTER (ok) * 100.0 / count(*) >= 95 THEN 'healthy' ELSE 'degraded' END AS status FROM calls GROUP BY provider
""")
def provider_stats(spark, d):
    s = providers.stats(_calls(spark, d))
    return s.select("provider", "total_requests", "success_requests", "failed_requests", F.round("success_rate", 6).cast("double").alias("success_rate"), F.round("avg_latency", 6).alias("avg_latency"), "status")


@query(f"""
WITH {CALLS}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY provider ORDER BY seq) AS g FROM calls), f AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY provider, g ORDER BY seq) AS fails FROM i)
SELECT provider, seq FROM f WHERE fails = 3
""")
def breaker_open(spark, d):
    return providers.breaker_openings(_calls(spark, d), 3).select("provider", "seq")


@query("""
WITH w AS (SELECT n_nationkey AS name, (n_nationkey % 5 + 1) AS weight FROM nation), r AS (SELECT name, sum(weight) OVER (ORDER BY name) - weight AS lo, sum(weight) OVER (ORDER BY name) AS hi FROM w)
SELECT event_id AS request, name FROM events JOIN r ON event_id % 75 >= lo AND event_id % 75 < hi
""")
def weighted_pick(spark, d):
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("name"), (F.col("n_nationkey") % 5 + 1).alias("weight"))
    requests = table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("event_id") % 75).alias("draw"))
    return providers.weighted_pick(requests, own).select("request", "name")


@query("SELECT event_id AS request, (event_id % 7)::INT AS provider_no FROM events")
def round_robin(spark, d):
    return providers.round_robin(table(spark, d, "events").select(F.col("event_id").alias("request")), 7)


@query("SELECT r_regionkey, least(0.1 * pow(2.0, r_regionkey), 1.0) AS delay FROM region")
def retry_backoff(spark, d):
    return table(spark, d, "region").select("r_regionkey", providers.backoff(F.col("r_regionkey"), 0.1, 2.0, 1.0).alias("delay"))


@query("SELECT s_suppkey AS name, (s_suppkey % 3)::INT AS priority FROM supplier ORDER BY 2, 1 LIMIT 5")
def priority_order(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") % 3).cast("int").alias("priority"))
    return providers.by_priority(own).limit(5)


@query("SELECT user_id AS task_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def task_status(spark, d):
    return tasks.current_status(table(spark, d, "events"), "user_id", "event_id", "event_type").select(F.col("user_id").alias("task_id"), "status")


@query(f"""
SELECT event_id FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT event_id FROM events WHERE value < 50) AND ts < {NOW} - INTERVAL 5 MINUTE
""")
def stale_claims(spark, d):
    e = table(spark, d, "events")
    claims, acks = e.filter("event_type = 'click'"), e.filter("value < 50")
    return tasks.stale_claims(claims, acks, _now(), 300, "event_id", "ts").select("event_id")


@query(f"SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id HAVING max(ts) > {NOW} - INTERVAL 24 HOUR")
def task_ttl(spark, d):
    newest = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return tasks.unexpired(newest, _now())


@query()
def stream_breaker(spark, d):
    """The calls as a stream, through stateful breakers, into a Parquet table in the shared folder."""
    calls = sources.stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema).select(
        F.col("user_id").cast("string").alias("provider"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") != "error").alias("ok")
    )
    return tasks.written(tasks.breaker_stream(calls))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, embedded once for each distinct content, searched by vector and keyword, fused."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.choose(docs).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("doc_id").alias("file_id"), "chunk_index", "content")
    empty = spark.createDataFrame([], "hash string, vector array<float>")
    rows, _ = embedding.embed_cached(chunks, empty, lambda c: V.hashed_embedding(c, 64), "content")
    rows = rows.persist()  # an index: both legs and the lookup read it
    ask = table(spark, d, "benchmark").orderBy("item_id").first()["text"]
    vector = list(spark.range(1).select(V.hashed_embedding(F.lit(ask), 64)).first()[0])
    found = search.hybrid(rows, ask, vector, 5)
    return found.select("chunk_id", "file_id", "chunk_index", "content", F.round("score", 9).alias("score"))


QUERIES["index_and_search"] = flagship
