"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

Texts are lower-cased and cut into words.  An item of L words gets the window class
c = 8, 4, 2 or 1: the largest with LEAST[c] <= L.  Wherever 2c - 1 intact words of an item stand in a document,
one of the document's disjoint c-word windows lies wholly inside them; LEAST[8] leaves three words more, as a near copy may have
changed words at its ends.  Every window of the item (at
all L - c + 1 places) and every disjoint window of every document gets a 64-bit SimHash: the majority of
its words' hashes at each bit, counted by bit-sliced adders in generated code.

Two fingerprints within RADIUS = 3 bits agree in one of four 16-bit parts; an equi-join on
(class, part, value) therefore meets all of them, and bit_count filters.  Each meeting implies
where the item would start; the item-sized window there is compared with the item exactly: weighted
Jaccard similarity of 5-word shingles, weight = characters, at least 0.75.  Windows of
eight words also cover copies with inner words replaced: 0.75 leaves fewer than L / 35
of those, and L / 8 - 1 windows; an end's changed word costs one shingle of L - 4, so at equal weights 0.75 leaves up to
(L - 4) / 7, and from 18 words on 15 stay intact.

Only DataFrame functions run.  The items' fingerprints are broadcast if a count says they are
at most BROADCAST_ROWS, else both sides are shuffled.  Null, empty and blank texts and items meet nothing;
items under five words are one shingle.  A row is known by its doc_id and a hash of its text: rows that repeat a doc_id
(or have a null one) are searched each by its own text, `search` reports an id's best place over all of them, and
`decontaminate` drops the rows whose own text holds an item.  Other columns pass through `decontaminate`, whatever their names; an empty
table of documents or items finds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 5
RADIUS = 3
SIMILARITY = 0.75
#: Places tried on either side of an implied start: a word may have been put in or left out.
SHIFT = 2
CLASSES = (8, 4, 2, 1)
#: Words an item needs for a class.
LEAST = {8: 18, 4: 7, 2: 3, 1: 1}
BROADCAST_ROWS = 200_000
BLANK = r"[ \t-\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")


def simhash(rows: DataFrame, c: int) -> DataFrame:
    """rows (…, w: an array of c hashes) with w replaced by its fingerprint fp: the bits that more than half of the hashes set.

    Bit-sliced counting: full adders on 64-bit words add up all 64 columns of bits at once.
    """
    keep = [x for x in rows.columns if x != "w"]
    col, xor, both = F.col, lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseAND(b)
    rows = rows.select(*keep, *[F.coalesce(F.get("w", F.lit(k)), F.lit(0)).alias(f"w{k}") for k in range(c)])  # never null, so that no filter is inferred

    def full(rows: DataFrame, ins: tuple[str, str, str], out: tuple[str, str]) -> DataFrame:
        x, y, z = map(col, ins)
        return rows.withColumns({out[0]: xor(xor(x, y), z), out[1]: both(x, y).bitwiseOR(both(z, xor(x, y)))})

    def half(rows: DataFrame, ins: tuple[str, str], out: tuple[str, str]) -> DataFrame:
        x, y = map(col, ins)
        return rows.withColumns({out[0]: xor(x, y), out[1]: both(x, y)})

    if c == 8:
        rows = full(rows, ("w0", "w1", "w2"), ("s1", "c1"))
        rows = full(rows, ("w3", "w4", "w5"), ("s2", "c2"))
        rows = full(rows, ("w6", "w7", "s1"), ("s3", "c3"))
        rows = half(rows, ("s2", "s3"), ("ones", "c4"))
        rows = full(rows, ("c1", "c2", "c3"), ("t1", "f1"))
        rows = half(rows, ("t1", "c4"), ("twos", "f2"))
        rows = half(rows, ("f1", "f2"), ("fours", "eights"))
        fp = col("eights").bitwiseOR(both(col("fours"), col("ones").bitwiseOR(col("twos"))))
    elif c == 4:
        rows = full(rows, ("w0", "w1", "w2"), ("s1", "c1"))
        rows = half(rows, ("s1", "w3"), ("ones", "c2"))
        rows = half(rows, ("c1", "c2"), ("twos", "fours"))
        fp = col("fours").bitwiseOR(both(col("twos"), col("ones")))
    else:
        fp = both(col("w0"), col("w1")) if c == 2 else col("w0")
    return rows.select(*keep, fp.alias("fp"))


def _windows(rows: DataFrame, c: int, step: int) -> DataFrame:
    """rows (…, h) exploded to (…, at, w): arrays of c hashes from word `at`, every `step` words."""
    keep = [x for x in rows.columns if x != "h"]
    # a filter on the size would compute the hashes a second time
    starts = F.when(F.size("h") >= c, F.sequence(F.lit(0), F.size("h") - c, F.lit(step)))
    return rows.select(*keep, F.posexplode(F.transform(starts, lambda i: F.slice("h", i + 1, c))).alias("_i", "w")).select(*keep, (F.col("_i") * step).alias("at"), "w")


def _parts(rows: DataFrame, c: int) -> DataFrame:
    """rows (…, fp) once for each 16-bit part, with the join key."""
    keys = F.array(*[(F.lit((c * 4 + p) << 16).cast("long") + F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(0xFFFF))) for p in range(4)])
    return rows.withColumn("key", F.explode(keys))


def _shingles(w: Column, n: Column) -> Column:
    """Distinct runs of K words of the n words w; all of them as one if they are fewer."""
    starts = F.sequence(F.lit(0), F.greatest(n - K, F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, K), " ")))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


def _bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def similarity(p: Column, q: Column) -> Column:
    """Weighted Jaccard similarity of the shingles of two word lists."""
    ratio = lambda a, b: _weight(F.array_intersect(a, b)) / _weight(F.array_union(a, b))
    shingles = lambda w: _shingles(w, F.size(w))
    return _bind(p, lambda x: _bind(q, lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(_bind(shingles(x), lambda a: _bind(shingles(y), lambda b: ratio(a, b))))))


def _verify(cands: DataFrame, docs: DataFrame, items: DataFrame, text: str, doc_id: str, item_text: str) -> DataFrame:
    # the places to compare in one document with one item, together: its text is cut once
    places = cands.groupBy("doc", "th", "item_id").agg(F.collect_set("start").alias("starts"))
    d = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    full = items.select("item_id", F.col(item_text).alias("_item"))
    near = places.join(d, places["doc"].eqNullSafe(d["_id"]) & (places["th"] == d["_th"])).join(full, "item_id")
    compare = lambda dw, iw: F.transform("starts", lambda s: F.struct(s.alias("start"), similarity(F.slice(dw, s + 1, F.size(iw)), iw).alias("similarity")))
    all_ = _bind(words(F.col("_text")), lambda dw: _bind(words(F.col("_item")), lambda iw: compare(dw, iw)))
    return near.select("doc", "th", "item_id", F.inline(F.filter(all_, lambda x: x["similarity"] >= SIMILARITY)))


def places(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text") -> DataFrame:
    """(doc, th, item_id, start, similarity): every place found, by doc_id and the text's hash."""
    hashed = lambda t: F.transform(words(F.col(t)), lambda w: F.xxhash64(w))
    h = items.select("item_id", hashed(item_text).alias("h")).filter(F.size("h") > 0)
    of_size = reduce(lambda a, c: F.when(F.size("h") >= LEAST[c], c).otherwise(a), sorted(CLASSES), F.lit(1))
    h = h.withColumn("c", of_size)
    found = []
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("th"), hashed(text).alias("h"))
    for c in sorted(r["c"] for r in h.select("c").distinct().collect()):  # at most four numbers
        wanted = simhash(_windows(h.filter(F.col("c") == c).drop("c"), c, 1), c).select("item_id", F.col("at").alias("offset"), "fp")
        wanted = _parts(wanted, c).select("item_id", "offset", F.col("fp").alias("item_fp"), "key")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        met = _parts(simhash(_windows(d, c, c), c), c).join(wanted, "key")
        met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
        found.append(met.select("doc", "th", "item_id", (F.col("at") - F.col("offset")).alias("start")))
    if not found:
        none = [F.lit(0).cast("long").alias("th"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")]
        return docs.select(F.col(doc_id).alias("doc"), *none).filter(F.lit(False))
    shifts = F.array(*[F.lit(k) for k in range(-SHIFT, SHIFT + 1)])
    cands = reduce(DataFrame.union, found).distinct().withColumn("_k", F.explode(shifts)).select("doc", "th", "item_id", (F.col("start") + F.col("_k")).alias("start")).filter("start >= 0").distinct()
    return _verify(cands, docs, items, text, doc_id, item_text)


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text") -> DataFrame:
    """(doc, item_id, start_word, similarity): the best place of each item found in each document."""
    best = places(docs, items, text, doc_id, item_text).groupBy("doc", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("m"))
    return best.select("doc", "item_id", (-F.col("m.col2")).alias("start_word"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that contain an item."""
    hits = places(docs, items, text, doc_id).select("doc", "th").distinct()
    return docs.join(hits, docs[doc_id].eqNullSafe(hits["doc"]) & (F.xxhash64(docs[text]) == hits["th"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs, items).select(F.col("doc").alias("doc_id"), "item_id", F.col("start_word").cast("long").alias("start_word"), F.round("similarity", 6).alias("similarity"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS j FROM b WHERE len(w) >= 5),
c AS (SELECT DISTINCT doc_id, item_id, i - j + e AS start FROM unnest(range(-2, 3)) AS t(e),
        ((SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM ds) JOIN
        (SELECT item_id, j, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM bs) USING (g)) WHERE i - j + e >= 0),
v AS (SELECT c.*, d.w[start + 1 : start + len(b.w)] AS dw, b.w AS bw FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, start,
        list_distinct(list_transform(range(0, greatest(len(dw) - 4, 1)), lambda k: array_to_string(dw[k + 1 : k + 5], ' '))) AS p,
        list_distinct(list_transform(range(0, greatest(len(bw) - 4, 1)), lambda k: array_to_string(bw[k + 1 : k + 5], ' '))) AS q FROM v),
m AS (SELECT doc_id, item_id, start,
        coalesce(list_sum(list_transform(list_intersect(p, q), lambda x: length(x))), 0)
        / list_sum(list_transform(list_distinct(list_concat(p, q)), lambda x: length(x))) AS similarity FROM s)
SELECT doc_id, item_id, arg_min(start, (-similarity, start)) AS start_word, round(max(similarity), 6) AS similarity
FROM m WHERE similarity >= 0.75 GROUP BY doc_id, item_id
"""
