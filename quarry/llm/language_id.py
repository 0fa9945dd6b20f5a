"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and
for every single byte, so that any text can be segmented).  A word's probability
in a language is the sum over all its segmentations of the product of the pieces'
probabilities, by the forward algorithm; a text's is the product over its words.
Words are maximal runs of letters (ASCII letters and bytes from 0x80; the text is
lower-cased first), with the vocabulary's word mark in front, of any length: the recursion goes
on in chunks and is scaled after each, so that no probability leaves the range of doubles.
The predicted language has the highest posterior, the score, under the
prior of the training languages, their shares of the training documents; ties go to the first language by name.

Training: expected piece counts by forward-backward (EM) on a bounded sample, the
first `sample_docs` training documents of every language by hash of doc_id.  The words of these documents are
counted into a table in the shared folder, and each round's expected counts are summed by Spark: the driver holds the
probabilities alone.  There a word of over TRAIN_BYTES bytes is learned from in parts.  All texts are scored whole.

Null texts and texts without a letter: `und`, score 0.  Empty tables and tables
without a training row give `und` throughout.  Repeated rows are scored alike (a doc_id's rows are all in
the sample, or none), ties of the hash go by doc_id, and other columns pass through `identify`, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tables import dropped, written
from quarry.llm.text_arrays import gathered, slices, utf8, words

SAMPLE_DOCS = 400
ROUNDS = 4
TRAIN_BYTES = 48
#: Bytes of a word between two scalings, and words together.
CHUNK, AT_ONCE = 16, 8192
#: Added to every piece's expected count; a byte alone gets it too.
SMOOTH = 0.05

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
MARK = "▁".encode()


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Trie:
    """child[node, class of byte] and the piece that ends at a node (or -1)."""

    child: np.ndarray
    piece: np.ndarray
    kind: np.ndarray
    length: np.ndarray

    @property
    def n_pieces(self) -> int:
        return len(self.length)

    @property
    def longest(self) -> int:
        return int(self.length.max())


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).lower().encode()
        body = raw.removeprefix(MARK)
        if not NOT_LETTER[np.frombuffer(body, np.uint8)].any():
            found.add(raw)
    pieces = sorted(found)
    used = sorted({b for p in pieces for b in p})
    kind = np.zeros(256, np.int32)
    kind[used] = np.arange(len(used))
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for n, p in enumerate(pieces):
        at = 0
        for b in p:
            if (to := children[at].get(b)) is None:
                to = children[at][b] = len(children)
                children.append({})
                ends.append(-1)
            at = to
        ends[at] = n
    child = np.full((len(children), len(used)), -1, np.int32)
    for at, row in enumerate(children):
        for b, to in row.items():
            child[at, kind[b]] = to
    return Trie(child, np.array(ends, np.int32), kind, np.array([len(p) for p in pieces]))


def marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each word and one more) of the words data[start:end], each behind the mark."""
    mark = np.frombuffer(MARK, np.uint8)
    length = end - start + len(mark)
    first = np.concatenate(([0], np.cumsum(length)))
    flat = np.empty(int(first[-1]), np.uint8)
    inside = np.arange(len(flat)) - np.repeat(first[:-1], length)
    body = inside >= len(mark)
    flat[~body] = np.tile(mark, len(start))
    flat[body] = data[(np.repeat(start - len(mark), length) + inside)[body]]
    return flat, first


def pieces_at(t: Trie, flat: np.ndarray, first: np.ndarray, base: int, size: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each place from base to base + size - 1 the pieces that begin there in any word: (length, words, pieces) by length."""
    own = np.flatnonzero(np.diff(first) > base)
    n = np.minimum(np.diff(first)[own] - base, size)
    word = np.repeat(own, n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at, stop = first[:-1][word] + base + place, first[1:][word]
    node = np.zeros(len(at), np.int32)
    alive = np.arange(len(at))
    rows: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size)]
    for k in range(t.longest):
        alive = alive[at[alive] + k < stop[alive]]
        if not len(alive):
            break
        to = t.child[node[alive], t.kind[flat[at[alive] + k]]]
        alive, to = alive[to >= 0], to[to >= 0]
        node[alive] = to
        piece = t.piece[to]
        hit, piece = alive[piece >= 0], piece[piece >= 0]
        order = np.argsort(place[hit], kind="stable")
        hit, piece = hit[order], piece[order]
        cuts = np.searchsorted(place[hit], np.arange(size + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            rows[i].append((k + 1, word[hit[cuts[i] : cuts[i + 1]]], piece[cuts[i] : cuts[i + 1]]))
    return rows


def scaled(t: Trie, p: np.ndarray, reach: int) -> tuple[np.ndarray, float]:
    """(p times unit to the power of each piece's bytes, unit): products over `reach` bytes stay within the range of doubles."""
    unit = float(min(p.min() ** -0.5, 10 ** (280 / reach))) if p.size else 1.0
    return p * (unit ** t.length.astype(float))[:, None], unit


def _forward(t: Trie, flat: np.ndarray, first: np.ndarray, p: np.ndarray, unit: float) -> np.ndarray:
    """log probability of each word in each language; p: scaled probability by piece and language."""
    length, n, k = np.diff(first), len(first) - 1, p.shape[1]
    out, shift = np.empty((n, k)), np.zeros((n, k))
    alpha = np.zeros((n, CHUNK + t.longest, k))
    alpha[:, 0] = 1
    for base in range(0, int(length.max()) + 1, CHUNK):
        for s, found in enumerate(pieces_at(t, flat, first, base, CHUNK)):
            for size, word, piece in found:
                alpha[word, s + size] += alpha[word, s] * p[piece]
        done = np.flatnonzero((length >= base) & (length < base + CHUNK))
        out[done] = np.log(alpha[done, length[done] - base]) + shift[done] - (length[done] * np.log(unit))[:, None]
        rest = np.flatnonzero(length >= base + CHUNK)
        if not len(rest):
            break
        ahead = alpha[rest, CHUNK:].copy()
        top = ahead.max(axis=1)
        alpha[rest] = 0
        alpha[rest, : t.longest] = ahead / top[:, None]
        shift[rest] += np.log(top)
    return out


def word_logs(t: Trie, data: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log probability of each word in each language; words go in order of length, some at a time."""
    out = np.empty((len(start), p.shape[1]))
    big, unit = scaled(t, p, CHUNK + t.longest)
    order = np.argsort(end - start, kind="stable")
    size = np.cumsum((end - start)[order])
    at = 0
    while at < len(order):
        most = int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right"))
        some = order[at : max(at + 1, min(at + AT_ONCE, most))]
        out[some] = _forward(t, *marked(data, start[some], end[some]), big, unit)
        at += len(some)
    return out


def lowered(column: pa.Array) -> pa.Array:
    """Lower-cased by Unicode's rules, nulls as empty texts."""
    return pa.array([x.lower() if x else "" for x in column.to_pylist()], pa.large_string())


def letters(column: pa.Array):
    """The words of lower-cased texts."""
    return words(column, NOT_LETTER, lower=False)


def training_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end) of the words of lower-cased texts, in parts of at most TRAIN_BYTES bytes."""
    w = letters(column)
    parts = -(-(w.end - w.start) // TRAIN_BYTES)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(w.start, parts) + k * TRAIN_BYTES
    return w.data, start, np.minimum(start + TRAIN_BYTES, np.repeat(w.end, parts))


def text_logs(t: Trie, column: pa.Array, p: np.ndarray) -> np.ndarray:
    """Sum of word logs by text and language (0 for a text without words)."""
    w = letters(column)
    out = np.zeros((len(column), p.shape[1]))
    if len(w.start):
        _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        logs = word_logs(t, w.data, w.start[first], w.end[first], p)
        doc = w.doc()
        edges = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[edges]] = np.add.reduceat(logs[back], edges, axis=0)
    return out


def _sample(known: DataFrame, sizes: dict[str, int], sample_docs: int) -> list[tuple]:
    """(language, id) of the first sample_docs ids of every language by hash."""
    # first the part of a language's ids in which twice the sample is expected: few enough to choose from here
    share = F.create_map(*[F.lit(x) for lg, n in sizes.items() for x in (lg, (2 * sample_docs + 100) / n)])
    h = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.select("_lang", "_id", h.alias("_h")).filter(F.col("_h") <= F.try_element_at(share, F.col("_lang"))).distinct().collect()
    out: dict[str, list] = {}
    for r in sorted(few, key=lambda r: (r["_h"], r["_id"])):
        out.setdefault(r["_lang"], []).append((r["_lang"], r["_id"]))
    return [x for rows in out.values() for x in rows[:sample_docs]]


def fit(spark: SparkSession, train: DataFrame, path: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS):
    """(languages, log prior, piece probabilities); train: rows to learn from."""
    known = train.select(F.col(lang).alias("_lang"), F.col(doc_id).alias("_id"), F.col(text).alias("_text")).dropna()
    sizes = {r["_lang"]: r["_n"] for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).collect()}  # one row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros(0), np.zeros((0, 0))
    ids = T.StructType([known.schema["_lang"], known.schema["_id"]])
    chosen = spark.createDataFrame(_sample(known, sizes, sample_docs), ids)
    rows = known.join(F.broadcast(chosen), ["_lang", "_id"]).select("_lang", "_text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["_lang", "_word", "_n"]
            )

        counts: Counter = Counter()
        for b in batches:
            for lg, x in zip(b.column(0).to_pylist(), b.column(1)):
                data, start, end = training_words(lowered(pa.array([x.as_py()], pa.large_string())))
                raw = data.tobytes()
                counts.update((lg, raw[s:e]) for s, e in zip(start.tolist(), end.tolist()))
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    table = written(rows.mapInArrow(counted, "_lang string, _word binary, _n long").groupBy("_lang", "_word").agg(F.sum("_n").alias("_n")))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p = trie(path), sent.value
        p = np.full((t.n_pieces, len(names)), 1.0 / t.n_pieces) if p is None else p
        big, _ = scaled(t, p, TRAIN_BYTES + len(MARK))
        counts = np.zeros_like(p)
        for b in gathered(batches, 1):
            code = np.array([names.index(x) for x in b.column(0).to_pylist()])
            n = b.column(2).to_numpy().astype(float)
            data, at = utf8(b.column(1))
            for i in range(0, len(n), AT_ONCE):
                j = min(len(n), i + AT_ONCE)
                _expect(t, *marked(data, at[i:j], at[i + 1 : j + 1]), big, code[i:j], n[i:j], counts)
        i = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(counts.ravel()[i]), pa.array(np.full(len(i), len(p)))], names=["_i", "_x", "_pieces"])

    p = None
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)
        # pieces x languages at most
        sums = table.select("_lang", "_word", "_n").mapInArrow(expected, "_i long, _x double, _pieces long").groupBy("_i").agg(F.sum("_x").alias("_x"), F.max("_pieces").alias("_pieces")).toArrow()
        sent.destroy()
        if not len(sums):
            # labelled texts, but no letter in any
            return [], np.zeros(0), np.zeros((0, 0))
        counts = np.full(int(sums["_pieces"][0].as_py()) * len(names), SMOOTH)
        counts[sums["_i"].to_numpy()] += sums["_x"].to_numpy()
        counts = counts.reshape(-1, len(names))
        p = counts / counts.sum(axis=0)
    dropped(table)
    n = np.array([sizes[x] for x in names], float)
    return names, np.log(n / n.sum()), p


def _expect(t: Trie, flat: np.ndarray, first: np.ndarray, p: np.ndarray, code: np.ndarray, n: np.ndarray, counts: np.ndarray) -> None:
    """Adds each piece's expected number in the words, word w counted n[w] times in its language; p is scaled."""
    length = np.diff(first)
    longest = int(length.max())
    own = [[(w, s + size, q, p[q, code[w]]) for size, w, q in found] for s, found in enumerate(pieces_at(t, flat, first, 0, longest))]
    alpha, beta = np.zeros((len(n), longest + 1)), np.zeros((len(n), longest + 1))
    alpha[:, 0] = 1
    beta[np.arange(len(n)), length] = 1
    for s, found in enumerate(own):
        for w, e, _, r in found:
            alpha[w, e] += alpha[w, s] * r
    for s in range(len(own) - 1, -1, -1):
        for w, e, _, r in own[s]:
            beta[w, s] += r * beta[w, e]
    total = alpha[np.arange(len(n)), length]
    for s, found in enumerate(own):
        for w, e, q, r in found:
            np.add.at(counts, (q, code[w]), n[w] * alpha[w, s] * r * beta[w, e] / total[w])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def identify(docs: DataFrame, model, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (which replace columns of those names)."""
    path = path or vocabulary_path()
    names, prior, p = model
    rest = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((names, prior, p.astype(np.float64)))  # pieces x languages of a fixed vocabulary
    at = [f.name for f in rest].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, p = sent.value
        t = trie(path) if names else None
        for b in gathered(batches, at, 2 << 20):
            lang, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for first, raw in slices(b.column(at), 2 << 20) if names else ():
                logs = text_logs(t, lowered(raw), p) + prior
                logs -= logs.max(axis=1, keepdims=True)
                post = np.exp(logs)
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                ok = np.array([has_letter(x) for x in raw.to_pylist()], bool)
                lang[first : first + len(raw)][ok] = np.array(names, object)[best[ok]]
                score[first : first + len(raw)][ok] = post[np.arange(len(raw)), best][ok]
            kept = [b.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def fold(doc_id: str | Column, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def train_and_identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learns from the rows of docs with crc32(doc_id) mod 4 other than 2 and labels all of them."""
    path = path or vocabulary_path()
    # a null doc_id has no remainder and isn't learned from
    model = fit(docs.sparkSession, docs.filter(fold("doc_id", 4) != 2), path)
    return identify(docs, model, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return train_and_identify(docs).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
