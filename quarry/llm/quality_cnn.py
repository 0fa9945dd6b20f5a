"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it.  Bytes are embedded, learned filters
slide over each chunk, ReLU and max-pooling leave a vector for a chunk, and the mean and the
maximum of a document's chunk vectors go through a logistic unit: one probability that
its quality label is 1.

Training is plain backpropagation with Adam on the driver, over at most `sample` labelled documents
(those with the smallest hash of doc_id among the rows learned from); every text is scored
whole.  Of a text longer than LEARNED characters, training takes as many, in chunks spread evenly over all of it: the sample's size
on the driver is bounded.  Filters are evaluated at every STRIDE-th byte.  Executors get the weights, some tens of kB, and see a bounded number of chunks at once.

Null and empty texts are one chunk of padding and get the network's answer to it.  Labels without a value
are left out; a doc_id with several labels has their smallest.  Without any
training row the score is 0.5 throughout.  Repeated rows are scored alike; a repeated doc_id is learned from once, by its smallest text (ties are equal
texts).  Columns other than doc_id, held_out and text are left out; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.text_arrays import slices, utf8

CHUNK = 512
STEP = 448
WIDTH = 8
STRIDE = 4
DIM = 8
FILTERS = 24
SAMPLE = 4000
#: Characters that training takes of one text.
LEARNED = 1 << 18
EPOCHS = 6
BATCH = 64
RATE = 4e-3
SEED = 11
#: Chunks in memory at once.
AT_ONCE = 512


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each chunk, its document); chunks step by STEP until the end is covered."""
    length = np.diff(at)
    n = np.maximum(1, -(-(length - (CHUNK - STEP)) // STEP))
    doc = np.repeat(np.arange(len(length)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return at[:-1][doc] + k * STEP, doc


def chunk_bytes(data: np.ndarray, at: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(chunk, CHUNK) bytes, 0 beyond the end of a document."""
    where = first[:, None] + np.arange(CHUNK)
    inside = where < at[1:][doc][:, None]
    out = np.zeros(where.shape, np.uint8)
    out[inside] = data[where[inside]]
    return out


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "filter": (r.normal(0, 1, (WIDTH * DIM, FILTERS)) / np.sqrt(WIDTH * DIM / 4)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.w["embed"][0] = 0

    def pooled(self, chunks: np.ndarray, keep: bool = False):
        """Each filter's highest value over a chunk, after ReLU; with the places if wanted."""
        x = self.w["embed"][chunks]
        n = len(chunks)
        even = x.reshape(n, -1, WIDTH * DIM) @ self.w["filter"]
        odd = np.ascontiguousarray(x[:, STRIDE : CHUNK - STRIDE]).reshape(n, -1, WIDTH * DIM) @ self.w["filter"]
        if not keep:
            return np.maximum(np.maximum(even.max(axis=1), odd.max(axis=1)) + self.w["bias"], 0)
        both = np.concatenate([even, odd], axis=1)
        place = both.argmax(axis=1)
        top = np.take_along_axis(both, place[:, None], 1)[:, 0] + self.w["bias"]
        start = np.where(place < even.shape[1], place * WIDTH, (place - even.shape[1]) * WIDTH + STRIDE)
        return np.maximum(top, 0), start, x

    def combined(self, pool: np.ndarray, doc: np.ndarray, n: int):
        edges = np.flatnonzero(np.diff(doc, prepend=-1))
        count = np.diff(np.append(edges, len(doc)))
        mean = np.add.reduceat(pool, edges, axis=0) / count[:, None]
        most = np.maximum.reduceat(pool, edges, axis=0)
        z = np.concatenate([mean, most], 1) @ self.w["out"] + self.w["out_bias"]
        return mean, most, count, 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def scores(self, column: pa.Array) -> np.ndarray:
        data, at = utf8(column)
        first, doc = cut(data, at)
        pool = np.concatenate([self.pooled(chunk_bytes(data, at, first[i : i + AT_ONCE], doc[i : i + AT_ONCE])) for i in range(0, len(first), AT_ONCE)])
        return self.combined(pool, doc, len(column))[3]

    def gradients(self, column: pa.Array, labels: np.ndarray) -> dict[str, np.ndarray]:
        data, at = utf8(column)
        first, doc = cut(data, at)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        parts = [chunk_bytes(data, at, first[i : i + AT_ONCE], doc[i : i + AT_ONCE]) for i in range(0, len(first), AT_ONCE)]
        kept = [self.pooled(p, True)[:2] for p in parts]
        pool, start = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        mean, most, count, p = self.combined(pool, doc, len(column))
        dz = ((p - labels) / len(labels)).astype(np.float32)
        g["out"] = np.concatenate([mean, most], 1).T @ dz
        g["out_bias"][0] = dz.sum()
        dmean, dmost = (dz[:, None] * self.w["out"][i * FILTERS : (i + 1) * FILTERS] for i in (0, 1))
        winners = pool == most[doc]
        dpool = (dmean / count[:, None])[doc] + dmost[doc] * winners / np.maximum(1, np.add.reduceat(winners, np.flatnonzero(np.diff(doc, prepend=-1)), axis=0, dtype=np.float32))[doc]
        dpool *= pool > 0
        g["bias"] = dpool.sum(axis=0)
        chunks = np.concatenate(parts)
        window = np.arange(WIDTH)
        for f in range(FILTERS):
            live = np.flatnonzero(dpool[:, f])
            seen = chunks[live[:, None], start[live, f][:, None] + window]
            d = dpool[live, f]
            g["filter"][:, f] = (self.w["embed"][seen].reshape(len(live), -1) * d[:, None]).sum(axis=0)
            # by place in the window: the sum of d over chunks with a byte there
            for j in range(WIDTH):
                g["embed"] += np.bincount(seen[:, j], d, 256).astype(np.float32)[:, None] * self.w["filter"][j * DIM : (j + 1) * DIM, f]
        g["embed"][0] = 0
        return g


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    net = Network(seed)
    if not texts:
        net.w["out"][:] = 0
        return net
    r = np.random.default_rng(seed)
    column, y = pa.array(texts, pa.large_string()), np.array(labels, np.float64)
    net.w["out_bias"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    t, steps = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), BATCH):
            some = order[i : i + BATCH]
            g = net.gradients(column.take(pa.array(some)), y[some])
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for k, v in net.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                v -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Network:
    """labels: (doc_id, quality) rows to learn from."""
    few = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a fixed number of ids
    n = LEARNED // CHUNK
    start = lambda i: F.floor(i * (F.length("_text") - CHUNK) / (n - 1)).cast("int") + 1
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring("_text", start(i), F.lit(CHUNK))), "")
    own = docs.select("doc_id", F.col(text).alias("_text")).filter("_text is not null").join(F.broadcast(few), "doc_id")
    own = own.select("doc_id", "quality", F.when(F.length("_text") <= LEARNED, F.col("_text")).otherwise(spread).alias("_text"))
    rows = own.groupBy("doc_id", "quality").agg(F.min("_text").alias("_text")).collect()  # at most `sample` rows of bounded size
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["_text"] for r in rows], [int(r["quality"]) for r in rows])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs (doc_id, held_out, text) as (doc_id, held_out, score, predicted)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            parts = [net.scores(part) for _, part in slices(b.column(2))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold != 1)
    net = train(docs, labels)
    return score(docs.withColumn("held_out", F.coalesce(fold == 1, F.lit(False))), net)
