"""Retrieval: exact and approximate cosine search, keyword search, fusion, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import keywords
from quarry.functions.vectors import cosine_distance, relevance
from quarry.operators import nearest

RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75


def vector_literal(v: list[float]) -> Column:
    return F.lit([float(x) for x in v])


def knn(rows: DataFrame, query: list[float] | Column, k: int, vector: str = "vector", key: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query, with `distance`; the filter comes before the ranking.  One top-k pass, no shuffle of rows."""
    q = query if isinstance(query, Column) else vector_literal(query)
    found = rows if where is None else rows.filter(where)
    return found.withColumn("distance", cosine_distance(vector, q)).filter(F.col("distance").isNotNull()).orderBy("distance", key).limit(k)


def knn_join(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector", key: str = "chunk_id", query_vector: str = "query_vector", query_id: str = "query_id") -> DataFrame:
    """The k rows nearest to every query of a stated, small query set, as rows' columns but for the vector, query_id, distance and rank.

    A vector of length zero has the distance NaN, after all others; where there is none, there is no distance, and it is last.
    """
    near = nearest.nearest(rows, queries.select(query_id, query_vector).toArrow(), k, vector, key, query_vector, query_id, odd=True)
    return first_of(near, k, key, query_id)


def first_of(pairs: DataFrame, k: int, key: str, query_id: str) -> DataFrame:
    """The first k pairs of every query by distance and key, with `rank`."""
    w = Window.partitionBy(query_id).orderBy(F.asc_nulls_last("distance"), key)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def in_files(files: list[str] | None, column: str = "file_id") -> Column:
    return F.lit(True) if not files else F.col(column).isin(files)


def scored(hits: DataFrame, min_score: float = 0.0, content: str | None = None) -> DataFrame:
    """hits with relevance_score = 1 - distance / 2, those under min_score (if above 0) and with empty content gone."""
    out = hits.withColumn("relevance_score", relevance("distance"))
    if content:
        out = out.filter(F.coalesce(F.col(content), F.lit("")) != "")
    return out.filter(F.col("relevance_score") >= min_score) if min_score > 0 else out


def query_terms(text: str) -> list[str]:
    """The distinct search terms of a query, in order (the Python twin of `keywords`)."""
    import regex

    return list(dict.fromkeys(regex.findall(r"[一-鿿]|[\p{L}\p{N}--[一-鿿]]+", text.lower(), flags=regex.V1)))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def bm25(rows: DataFrame, query: str, k: int, content: str = "content", key: str = "chunk_id", match_all: bool = True, where: Column | None = None) -> DataFrame:
    """The k rows with the best Okapi BM25 score for the query's terms, with `score`.

    Term frequencies are counted within each row's token list; only document frequencies and lengths are
    aggregated, to one row.
    """
    terms = query_terms(query)
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    counted = term_counts(rows if where is None else rows.filter(where), terms, content)
    totals = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *document_counts(len(terms)))
    return best(counted, totals, len(terms), k, key, match_all)


def term_counts(rows: DataFrame, terms: list[str], content: str = "content") -> DataFrame:
    """rows with their number of terms _n, and _f0, _f1, ... of each of `terms`."""
    tokens = rows.withColumn("_t", keywords(F.coalesce(F.col(content), F.lit(""))))
    return tokens.withColumns({"_n": F.size("_t"), **{f"_f{i}": _occurrences(w) for i, w in enumerate(terms)}}).drop("_t")


def document_counts(n: int) -> list[Column]:
    """Aggregates _d0, _d1, ...: the rows that hold each of n terms."""
    return [F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(n)]


def best(counted: DataFrame, totals: DataFrame, n: int, k: int, key: str = "chunk_id", match_all: bool = True) -> DataFrame:
    """The k best of counted rows (_n, _f0, ...) by the totals, one row (_docs, _mean, _d0, ...)."""
    hit = [F.col(f"_f{i}") > 0 for i in range(n)]
    wanted = counted.filter(reduce(lambda a, b: (a & b) if match_all else (a | b), hit)).crossJoin(F.broadcast(totals))  # totals: one row

    def part(i: int) -> Column:
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.ln(F.lit(1.0) + (F.col("_docs") - d + 0.5) / (d + 0.5))
        return idf * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_n") / F.col("_mean")))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(n)])
    mine = [c for c in wanted.columns if c.startswith("_")]
    return wanted.withColumn("score", score).drop(*mine).orderBy(F.desc("score"), key).limit(k)


def ranked(leg: DataFrame, *order: Column) -> DataFrame:
    """A leg's few rows with their rank from 1."""
    return leg.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(vector_leg: DataFrame, text_leg: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3), key: str = "chunk_id") -> DataFrame:
    """(key, score) of two legs (key, rank): the sum of weight / (60 + rank) over both, the best k.  A weight of 0 means its default."""
    w1, w2 = weights[0] or 0.7, weights[1] or 0.3
    a = vector_leg.select(F.col(key), (F.lit(w1) / (RRF_K + F.col("rank"))).alias("s"))
    b = text_leg.select(F.col(key), (F.lit(w2) / (RRF_K + F.col("rank"))).alias("s"))
    return a.union(b).groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(rows: DataFrame, query: str, query_vector: list[float] | Column, k: int, weights: tuple[float, float] = (0.7, 0.3), where: Column | None = None, vector: str = "vector", content: str = "content", key: str = "chunk_id", min_score: float = 0.0, text_leg: DataFrame | None = None) -> DataFrame:
    """rows found by vector (3 k) and by keyword (9 k), fused to 3 k and cut to k, with `score`, and distance where the vector leg has it.

    min_score applies to the vector leg's relevance.  A query without a term is a vector search.  text_leg: the keyword leg
    (key, score), if an index has it; else the contents of rows are counted.
    """
    near = scored(knn(rows, query_vector, 3 * k, vector, key, where), min_score)
    if not query_terms(query):
        return ranked(near, F.col("distance"), F.col(key)).withColumn("score", F.col("relevance_score")).orderBy("rank").limit(k).drop("rank")
    text = bm25(rows, query, 9 * k, content, key, True, where) if text_leg is None else text_leg
    legs = (ranked(near.select(key, "distance"), F.col("distance"), F.col(key)), ranked(text.select(key, "score"), F.desc("score"), F.col(key)))
    fused = rrf(*legs, 3 * k, weights, key).orderBy(F.desc("score"), key).limit(k)
    # at most k rows: the rest of each is looked up
    return rows.join(F.broadcast(fused), key).join(F.broadcast(legs[0].select(key, "distance")), key, "left").orderBy(F.desc("score"), key)


class IvfIndex:
    """Approximate search: vectors in cells around k-means centres; a query reads the cells nearest to it.

    The centres are fitted on at most `sample` vectors; every vector is put into a cell.  Written with `partitionBy('cell')`,
    a search reads only its cells.
    """

    def __init__(self, rows: DataFrame, cells: int = 16, vector: str = "vector", sample: int = 10_000, seed: int = 3, key: str = "chunk_id"):
        import numpy as np

        few = rows.select(vector, key).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key)), key).limit(sample).select(vector).collect()
        x = np.array([r[0] for r in few], float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        r = np.random.default_rng(seed)
        c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(12):
            own = (x @ c.T).argmax(axis=1)
            c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centres, self.vector, self.key = c, vector, key
        self.rows = rows.withColumn("cell", self.cell(F.col(vector)))

    def cell(self, v: Column) -> Column:
        return nearest.placed(v, self.centres)["cell"]

    def search(self, query: list[float], k: int, probes: int = 4) -> DataFrame:
        import numpy as np

        q = np.array(query, float)
        near = np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()
        return knn(self.rows, query, k, self.vector, self.key, F.col("cell").isin(near))

    def search_join(self, queries: DataFrame, k: int, probes: int = 4, query_vector: str = "query_vector", query_id: str = "query_id") -> DataFrame:
        """The k rows nearest to every query, with `distance` and `rank`, as `knn_join` finds them; what has no distance is left out.

        The cells nearest to a query are read first.  Another is read if its farthest vector's angle to the centre lets it hold
        something nearer than the k-th found.
        """
        import numpy as np

        n = len(self.centres)
        angles = self.rows.select(nearest.placed(F.col(self.vector), self.centres).alias("p")).filter("p.angle is not null")
        widest = {r["cell"]: r["_r"] for r in angles.groupBy("p.cell").agg(F.max("p.angle").alias("_r")).collect()}  # one row a cell
        radius = np.array([widest.get(i, -np.inf) for i in range(n)])
        asked = queries.select(query_id, query_vector).toArrow()  # a stated, small query set
        vectors = nearest.Vectors(asked.column(query_vector), self.centres.shape[1])
        given = vectors.kind == nearest.GIVEN
        angle = np.zeros((len(asked), n))
        angle[given] = nearest.angles(nearest.apart(vectors, self.centres))[vectors.of[given]]
        first = (angle.argsort(axis=1, kind="stable").argsort(axis=1) < probes) & given[:, None]

        def read(cells) -> DataFrame:
            return nearest.nearest(self.rows, asked, k, self.vector, self.key, query_vector, query_id, "_place", cells)

        near = first_of(read(first), k, self.key, "_place")
        bound = near.groupBy("_place").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("_far")).toArrow()  # one row a query
        far = np.full(len(asked), np.pi)
        far[bound.column("_place").to_numpy()] = nearest.angles(bound.column("_far").to_numpy().astype(float))
        far[np.isnan(far)] = np.pi
        more = ~first & given[:, None] & (angle - radius <= far[:, None] + 1e-6)
        return first_of(read(first).unionByName(read(more)).drop("_place"), k, self.key, query_id)
