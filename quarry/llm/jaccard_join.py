"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles (hashed to 64 bits).  The hash range is cut
into m blocks; a block's sketch is the XOR of the keys of the shingles in it, that is,
a (sparse) bit vector's parity.  A shingle in one set only changes one block, so the
number of differing blocks is at most the symmetric difference, which at similarity
t is at most (1 - t) / (1 + t) * (|A| + |B|): for t = 3/4 a third of the smaller set.

Pigeonhole: if more than n / 3 of a set's blocks are not empty, every partner equals it
in one of those.  Sets are put into size bands of ratio 1.5 (m is 0.6 of the band's
smallest size), and a set whose partners may lie in the next band joins that too.  A set with too
few full blocks (short ones, mostly) is also entered under another hash, and so on until
one gives it enough: of two sets, one has enough on a level where both are entered, so
no linked pair is lost.

A set is known by a 64-bit hash of it, its node: equal sets are one node from the start, whatever
their documents' ids.  Sketches travel packed, (bucket, bytes), and meet in one bucket by sort.  Runs of equal
sketches up to `WIDE` + 1 sets give all their pairs; longer runs give neighbours by size
and are written down as wide.  A pair's equal blocks are counted; as a set with f
full blocks equals a partner in at least f - (|A| + |B|) / 7 of them, pairs with fewer, their wide runs
counted in, are no candidates, nor are pairs whose dense sketches (2,048 parity bits of the whole set, and 16,384 of a large one) differ in
more bits than that.  All candidates' texts are compared exactly.
Sets that by the pigeonhole may have partners in wide runs only meet on their rarest shingles as well (an exact
prefix filter), where they are of two components as yet; there the dense sketches, all bits of them, decide before a
pair is written, and what they can't rule out is compared.

Nulls, empty and blank texts: n_shingles 0, a component of their own.  Texts of one to
four words: one shingle, the whole sequence.  Every row is judged by its own text: rows that repeat a doc_id with
other texts are linked each by itself, whatever their order.  A null doc_id's row is reported and is no link's end.  Columns other than doc_id and
text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.components import components, cut
from quarry.llm.tables import dropped, written
from quarry.llm.text_arrays import gathered, mix, shingles, slices, utf8, words

K = 5
RATIO = 1.5
SHARE = 0.6
WIDE = 8
HUB = 200
BITS = 2048
#: Sets of so many shingles have more parity bits besides.
LARGE, MORE_BITS = 1500, 16384
#: Words of parity that are compared before all others.
FOLDED = 8
_U = np.uint64
_HALF = _U(32)
_KEY = _U(0x5851F42D4C957F2D)


def band_edges(most: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges, np.int64)


EDGES = band_edges()
BLOCKS = np.maximum(1, np.ceil(EDGES * SHARE)).astype(np.int64)


def _sketches(s: np.ndarray, key: np.ndarray, doc: np.ndarray, m: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketch of each full block, its set); s sorted within each set; m, salt by element."""
    with np.errstate(over="ignore"):
        block = ((s >> _HALF) * m.astype(_U)) >> _HALF
        new = np.ones(len(s), bool)
        new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        parity = np.bitwise_xor.reduceat(key, at) if len(at) else key[:0]
        return mix(parity + mix(salt[at] + block[at])), doc[at]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sketches, their entries; set and full blocks by entry): set i is entry 2 i in its band, 2 i + 1 in the next."""
    size = np.array([len(x) for x in sets], np.int64)
    full = np.zeros(2 * len(sets), np.int64)
    if not size.sum():
        return np.zeros(0, _U), np.zeros(0, np.int64), size, full
    s = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    key = mix(s ^ _KEY)
    band = np.maximum(0, np.searchsorted(EDGES, size, "right") - 1)
    up = np.where(3 * EDGES[band + 1] <= 4 * size, band + 1, -1)
    out, owner = [], []
    for role, space in enumerate((band, up)):
        take = (space >= 0) & (size > 0)
        part = take[doc]
        d = doc[part]
        sk, own = _sketches(s[part], key[part], d, BLOCKS[space][d], space[d].astype(_U) << _U(8))
        out.append(sk)
        owner.append(2 * own + role)
        full[role::2] = np.bincount(own, minlength=len(sets))
        for i in np.flatnonzero(take & (full[role::2] <= size // 3)).tolist():
            for level in range(1, 256):
                h = np.sort(mix(sets[i] + _U(level)))
                one = np.zeros(len(h), np.int64)
                sk, _ = _sketches(h, mix(h ^ _KEY), one, np.full(len(h), BLOCKS[space[i]]), np.full(len(h), (int(space[i]) << 8) + level, _U))
                out.append(sk)
                owner.append(np.full(len(sk), 2 * i + role))
                if len(sk) > size[i] // 3:
                    break
    return np.concatenate(out), np.concatenate(owner), size, full


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [x for _, part in slices(column) for x in shingles(words(part), K)]


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([int(x.sum(dtype=_U) ^ mix(np.array([len(x)], _U))[0]) for x in sets], _U)


def _parity(s: np.ndarray, bits: int) -> bytes:
    """The set's bits, each flipped by every shingle that hashes to it."""
    at = (mix(s ^ _U(0x2545F4914F6CDD1D)) % _U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def shingle_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, node, bits, more) of docs (doc_id, text): th: a hash of the text; equal nodes mean equal sets; bits: parity; more: that of large sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = _sets(b.column(2))
            bits = pa.array([_parity(x, BITS) if len(x) else None for x in sets], pa.binary())
            more = pa.array([_parity(x, MORE_BITS) if len(x) >= LARGE else None for x in sets], pa.binary())
            cols = [pa.array([len(x) for x in sets], pa.int64()), pa.array(_set_keys(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, bits, more], names=["doc_id", "th", "n_shingles", "node", "bits", "more"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, node long, bits binary, more binary")


def _far(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with the parity words x, y (rows) differ in too many bits."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) > (n + m) // 7


def _blobs(column: pa.Array, words_: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Parity words by row of a binary column without nulls."""
    data, _ = utf8(column if rows is None else column.take(pa.array(rows)))
    return data.view("<u8").reshape(-1, words_)


def _sketch(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, bits, more) of some nodes, one row each."""
    own = counts.filter("n_shingles > 0 and doc_id is not null").join(nodes, "node", "left_semi")
    return own.groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.min("bits").alias("bits"), F.min("more").alias("more"))


def near(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose dense sketches may be of similar sets."""
    left, right = (sketch.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"p{x}"), F.col("more").alias(f"m{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            ok = (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & ~_far(n, m, _blobs(b.column(4), BITS // 64), _blobs(b.column(5), BITS // 64))
            both = np.flatnonzero(ok & (n >= LARGE) & (m >= LARGE))
            if len(both):
                ok[both] = ~_far(n[both], m[both], _blobs(b.column(6), MORE_BITS // 64, both), _blobs(b.column(7), MORE_BITS // 64, both))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(i).take(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb", "ma", "mb").mapInArrow(run, "a long, b long")


def packed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n sketches, bytes): the sketches of some sets that fall into a bucket."""

    def pack(sets: list[np.ndarray]) -> pa.RecordBatch:
        # equal sets of a batch travel once
        nodes, first = np.unique(_set_keys(sets), return_index=True)
        sets, nodes = [sets[i] for i in first.tolist()], nodes.view(np.int64)
        sk, owner, size, full = sketches(sets)
        bucket = (((sk >> _HALF) * _U(buckets)) >> _HALF).astype(np.int64)
        order = np.lexsort((owner, bucket))
        sk, owner, bucket = sk[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
            entry, n = np.unique(owner[a:z], return_counts=True)
            d = entry // 2
            each = [n, size[d], 2 * full[entry] + entry % 2]
            rows.append(b"".join([len(d).to_bytes(4, "little"), nodes[d].tobytes(), *[_planes(x, "<u4") for x in each], sk[a:z].astype("<u4").tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 0):
            for _, part in slices(b.column(0), 4 << 20):
                sets = [x for x in _sets(part) if len(x)]
                if sets:
                    yield pack(sets)

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "bucket long, packed binary")


def _unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sketches, by entry: how many sketches, node, shingles, 2 x full blocks + role)."""
    d = int.from_bytes(blob[:4], "little")
    nodes = np.frombuffer(blob, "<i8", d, 4)
    n, *each = (_from_planes(blob, "<u4", d, 4 + 8 * d + 4 * d * i) for i in range(3))
    return np.frombuffer(blob, "<u4", -1, 4 + 20 * d), [n, nodes, *each]


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The numbers' lowest bytes, then their next, and so on: the shuffle's compression packs the zeros."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(blob: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind)


def _runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: rows (a, b, equal blocks, least number) of pairs, and (a, a, - wide runs, spare blocks) of the sets in wide runs."""
    parts = [_unpack(x) for x in blobs]
    # sketch and entry in one number, sorted in place
    met = np.empty(sum(len(p[0]) for p in parts), _U)
    at = entries = 0
    for sk, (n, *_) in parts:
        part = met[at : at + len(sk)]
        part[:] = sk
        part <<= _HALF
        part |= np.repeat(np.arange(entries, entries + len(n), dtype=np.uint32), n)
        at, entries = at + len(sk), entries + len(n)
    cols = [np.concatenate([p[1][i] for p in parts]) for i in range(1, 4)]
    del parts
    met.sort()
    sk = met.view("<u4")[1::2]
    same = np.zeros(len(sk), bool)
    same[1:] = sk[1:] == sk[:-1]
    same[:-1] |= same[1:].copy()
    # only what has met something is looked at further
    sk, entry = sk[same], met.view("<u4")[::2][same]
    del met
    doc, size, full = (x[entry].astype(np.int64) for x in cols)
    # equal sets of a run are one node
    order = np.lexsort((doc, size, sk))
    sk, doc, size, full = (x[order] for x in (sk, doc, size, full))
    first = np.ones(len(sk), bool)
    first[1:] = (sk[1:] != sk[:-1]) | (doc[1:] != doc[:-1])
    sk, doc, size, role, full = sk[first], doc[first], size[first], full[first] % 2, full[first] // 2
    at = np.flatnonzero(np.concatenate(([True], sk[1:] != sk[:-1]))) if len(sk) else np.zeros(0, np.int64)
    length = np.diff(np.append(at, len(sk)))
    wide = np.repeat(length > WIDE + 1, length)
    rows = [np.zeros((0, 3), np.int64)]
    for step in range(1, min(WIDE + 1, len(sk))):
        # two sets of one band meet there, not in the next band again
        ok = (sk[step:] == sk[:-step]) & (4 * size[:-step] >= 3 * size[step:]) & (doc[step:] != doc[:-step]) & (role[step:] + role[:-step] < 2)
        if step > 1:
            ok &= ~wide[step:]
        x, y = doc[:-step][ok], doc[step:][ok]
        need = np.maximum(full[:-step], full[step:]) - (size[:-step] + size[step:]) // 7
        rows.append(np.column_stack([np.minimum(x, y), np.maximum(x, y), need[ok]]))
    if wide.any():
        # a wide run's smallest node is its hub
        hub = np.repeat(np.minimum.reduceat(np.where(role == 0, doc, np.iinfo(np.int64).max), at), length)
        first = np.lexsort((np.arange(len(doc)), doc))
        hub_at = first[np.minimum(np.searchsorted(doc[first], hub), len(doc) - 1)]
        ok = wide & (hub != np.iinfo(np.int64).max) & (doc != hub) & (4 * np.minimum(size, size[hub_at]) >= 3 * np.maximum(size, size[hub_at]))
        rows.append(np.column_stack([np.minimum(doc, hub)[ok], np.maximum(doc, hub)[ok], np.zeros(int(ok.sum()), np.int64)]))
    rows = np.concatenate(rows)
    pairs, n = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
    # of each set in wide runs: how many, and how many full blocks it can spare
    order = np.argsort(doc[wide], kind="stable")
    doc, spare = doc[wide][order], (full - size // 3)[wide][order]
    at = np.flatnonzero(np.diff(doc, prepend=-1 if not len(doc) else doc[0] - 1))
    spare = np.minimum.reduceat(spare, at) if len(at) else spare
    return np.column_stack([pairs[:, :2], n, pairs[:, 2]]), np.column_stack([doc[at], doc[at], -np.diff(np.append(at, len(doc))), spare])


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (a, b, n, need): two nodes with n equal sketches, which need `need`; and, with n < 0, a node a = b in - n wide runs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bucket's sketches are sorted in memory, 8 bytes each; each bucket costs a document some bytes
    buckets = max(min(parts, 16), parts // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        kept: list[np.ndarray] = []

        def out(blobs):
            return np.concatenate(_runs(blobs))

        def batch(rows):
            rows = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], names=["a", "b", "n", "need"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != at:
                    if held:
                        kept.append(out(held))
                    held, at = [], bucket
                    if sum(map(len, kept)) > 200_000:
                        yield batch(kept)
                        kept = []
                held.append(blob.as_py())
        if held:
            kept.append(out(held))
        if kept:
            yield batch(kept)

    dealt = packed(docs, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, n long, need long")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets are similar enough; texts: (node, text).

    Every b travels to its a; the partners of a hub are dealt over salts, about HUB to each, each with a copy of the hub.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > HUB)
    salts = F.coalesce(F.ceil(F.col("_m") / HUB), F.lit(1))
    salted = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("_salt"))
    routes = salted.select("a", F.col("b").alias("node"), "_salt").union(salted.select("a", F.col("a").alias("node"), "_salt").distinct())
    rows = routes.join(texts, "node").select("a", "_salt", F.when(F.col("node") == F.col("a"), 0).otherwise(1).alias("_order"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for b in batches:
            found = []
            for first, part in slices(b.column(3)):
                rows = (b.column(i).slice(first, len(part)).to_pylist() for i in range(3))
                sets = shingles(words(part), K)
                for a, order, node, s, key in zip(*rows, sets, _set_keys(sets).view(np.int64).tolist()):
                    if key != node:
                        continue  # another text of a repeated doc_id
                    if order == 0:
                        hub, own = a, s
                    elif hub == a:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 4 * both >= 3 * (len(own) + len(s) - both):
                            found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.repartition("a", "_salt").sortWithinPartitions("a", "_salt", "_order")
    return dealt.select("a", "_order", "node", "text").mapInArrow(run, "a long, b long")


def _rare(texts: DataFrame, weak: DataFrame) -> DataFrame:
    """(x, b): the rarest shingles b of the weak sets x (nodes that may have a partner in wide runs only).

    With shingles ordered by frequency among the weak sets, two linked sets share one of the first n - ceil(3 n / 4) + 1
    of each (prefix filtering); what many sets have in common comes last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(1)):
                sets = shingles(words(part), K)
                own = b.column(0).slice(first, len(part)).to_numpy()
                right = np.flatnonzero(_set_keys(sets).view(np.int64) == own)
                size = np.array([len(sets[i]) for i in right], np.int64)
                if len(right):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[right], size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate([sets[i] for i in right.tolist()]).view(np.int64))], names=["x", "size", "b"])

    # a repeated doc_id's equal texts give the same rows
    rows = written(texts.join(weak, "node", "left_semi").select("node", "text").mapInArrow(run, "x long, size long, b long").distinct())
    often = rows.groupBy("b").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # one set's shingles in a window: its rarest come first, those of it alone before all
    rank = F.row_number().over(Window.partitionBy("x").orderBy("df", "b"))
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("x"))
    left = rows.join(often, "b").withColumns({"rank": rank, "alone": alone}).filter("rank + alone <= size - ceil(3 * size / 4) + 1").select("x", "b")
    out = written(left)
    dropped(rows)
    return out


def _met(sets: list[np.ndarray], root: np.ndarray, size: np.ndarray, bits: np.ndarray, more: dict[int, np.ndarray]) -> np.ndarray:
    """Pairs of rows of one bucket that share a shingle, are of two components and whose dense sketches may be of similar sets."""
    b, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.lexsort((root[row], b))
    b, row = b[order], row[order]
    r, n = root[row], size[row]
    found = [np.zeros((0, 2), np.int64)]
    ends = np.concatenate((np.flatnonzero(np.diff(b)) + 1, [len(b)]))
    # each entry is compared with those after it in its shingle's group that are of another component
    last = ends[np.searchsorted(ends, np.arange(len(b)), "right")]
    change = np.concatenate((np.flatnonzero((np.diff(b) != 0) | (np.diff(r) != 0)) + 1, [len(b)]))
    at, here = change[np.searchsorted(change, np.arange(len(b)), "right")], np.arange(len(b))
    while len(here):
        live = at < last[here]
        here, at = here[live], at[live]
        for z in range(0, len(here), 1 << 16):
            i, j = here[z : z + (1 << 16)], at[z : z + (1 << 16)]
            ok = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
            i, j = row[i[ok]], row[j[ok]]
            for words_ in (FOLDED, BITS // 64):
                near_ = ~_far(size[i], size[j], bits[i, :words_], bits[j, :words_])
                i, j = i[near_], j[near_]
            for x, y in {(int(min(p)), int(max(p))) for p in zip(i, j)}:
                if x not in more or y not in more or not _far(size[[x]], size[[y]], more[x][None], more[y][None])[0]:
                    found.append(np.array([[x, y]]))
        at = at + 1
    return np.unique(np.concatenate(found), axis=0)


def _rare_pairs(rare: DataFrame, roots: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs (a, b) of two components that share a rare shingle and are within reach by their dense sketches.

    Shingles are dealt to buckets; a set is sent once to each bucket that one of its rare shingles falls into, with its sketches, so
    a pair beyond reach is never a row.
    """
    parts = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rare.join(roots.select(F.col("id").alias("x"), F.col("root").alias("r")), "x", "left").withColumn("r", F.coalesce("r", "x"))
    mixed = left.groupBy("b").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("b")
    left = left.join(mixed, "b", "left_semi")
    # the rare shingles of one set in one bucket: at most a quarter of its shingles
    sent = left.groupBy("x", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("bucket")).agg(F.first("r").alias("r"), F.collect_list("b").alias("bs"))
    rows = sent.join(sketch.withColumnRenamed("node", "x"), "x").select("bucket", "x", "r", "n_shingles", "bs", "bits", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x, r, n = (t.column(i).to_numpy() for i in (1, 2, 3))
            bs = [np.array(v.values) for v in t.column(4).combine_chunks()]
            large = {i: np.frombuffer(v.as_py(), "<u8") for i, v in enumerate(t.column(6)) if v.is_valid}
            p = _met(bs, r, n, _blobs(t.column(5).combine_chunks(), BITS // 64), large)
            a, b = x[p[:, 0]], x[p[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            bucket = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i < j:
                    if bucket[i] != at and held:
                        yield out()
                        held = []
                    at = bucket[i]
                    held.append(b.slice(i, j - i))
        if held:
            yield out()

    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of every row, and (node, least) of every set: the smallest (doc_id, th, rows) of its group."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(shingle_counts(docs))
    own = counts.filter("n_shingles > 0 and doc_id is not null").groupBy("node", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    classes = own.groupBy("node").agg(F.min(F.struct("doc_id", "th", "rows")).alias("rep"))
    found = written(candidates(docs).groupBy("a", "b", (F.col("n") < 0).alias("wide")).agg(F.sum("n").alias("n"), F.min("need").alias("need")))
    wide = found.filter("wide").select("a", (-F.col("n")).alias("n_wide"), "need")
    # more than a third as many full blocks in narrow runs as it has shingles: a set has met all its partners there
    weak = wide.filter("n_wide >= need").select(F.col("a").alias("node"))
    of_wide = wide.select("a", "n_wide")
    pairs = found.filter("not wide").join(of_wide.withColumnRenamed("n_wide", "wa"), "a", "left")
    pairs = pairs.join(of_wide.select(F.col("a").alias("b"), F.col("n_wide").alias("wb")), "b", "left")
    pairs = pairs.filter(F.col("n") + F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) >= F.col("need")).select("a", "b")
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(weak).distinct()
    sketch = written(_sketch(counts, some))
    pairs = written(near(pairs, sketch))
    # from here on only texts with a candidate are read: of each node one document's, and that once
    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(weak).distinct()
    wanted = classes.join(some, "node", "left_semi").select("node", F.col("rep.doc_id").alias("doc_id"))
    texts = docs.join(wanted, "doc_id").groupBy("doc_id", "node", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = written(texts.select("node", "text"))
    links = written(verified(texts, pairs))
    roots = components(links)
    rare = _rare(texts, weak)
    rest = written(_rare_pairs(rare, roots, sketch))
    if not rest.isEmpty():
        more = cut(verified(texts, rest))
        if not more.isEmpty():
            roots = components(links.union(more))
    dropped(found, sketch, pairs, texts, links, rare, rest)
    members = roots.select(F.col("id").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = members.join(classes, "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    of_node = classes.join(linked.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("least"))
    return counts.select("doc_id", "n_shingles", "node"), of_node


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    rows, of_node = _grouped(docs)
    own = of_node.select(F.col("node").alias("_node"), F.col("least.doc_id").alias("component_id"))
    # exact copies share one node's row; many of them are a join's split side, not a group
    joined = rows.join(own, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, th, rows): of each group of linked texts one, that of the smallest doc_id and then of the smallest hash th of the text; rows: how many rows are alike in both."""
    return _grouped(docs)[1].select("least.*").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
