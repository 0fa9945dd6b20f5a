"""Nearest neighbours of a stated query set in numpy: every task scores blocks of its rows against all queries.

A matrix product finds the candidates of each query with a margin far above its rounding; their distances are then summed term by term,
so equal vectors have equal distances wherever they are read, and ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quarry.sources.shipping import ship

#: Rows of a block; pairs scored at once; the margin of the matrix product.
BLOCK = 1 << 14
PAIRS = 1 << 21
MARGIN = 1e-9
#: Kinds of vectors, in the order of their distances: any other, of length zero or without a finite one (distance NaN), none (no distance).
GIVEN, ZERO, NONE = 0, 1, 2


class Vectors:
    """An Arrow list column as the distinct vectors x (double) and their squared norms; of each row its vector and its kind."""

    def __init__(self, column: pa.Array, dim: int | None = None):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        n = len(column)
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        self.dim = int(size.max(initial=0)) if dim is None else dim
        ok = size == self.dim
        flat = column.filter(pa.array(ok & column.is_valid().to_numpy(zero_copy_only=False))).flatten()
        self.kind = np.where(ok & column.is_valid().to_numpy(zero_copy_only=False), GIVEN, NONE)
        rows = np.flatnonzero(self.kind == GIVEN)
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), self.dim).any(axis=1)
        raw = np.ascontiguousarray(flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(rows), self.dim))
        self.kind[rows[holes]] = NONE
        _, head, own = np.unique(raw.view(np.dtype((np.void, max(1, raw.itemsize * self.dim)))).reshape(-1) if self.dim else np.zeros(len(rows)), return_index=True, return_inverse=True)
        self.x = raw[head].astype(np.float64)
        self.square = summed(self.x, self.x)
        self.of = np.zeros(n, np.int64)
        self.of[rows] = own.reshape(-1)
        self.kind[rows] = np.where((self.kind[rows] == GIVEN) & ~((self.square > 0) & (self.square < np.inf))[self.of[rows]], ZERO, self.kind[rows])

    def unit(self, which: np.ndarray) -> np.ndarray:
        return self.x[which] / np.sqrt(self.square[which])[:, None]


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the dot products, summed in order."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def distance(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Cosine distances row by row; aa, bb: squared norms."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip(summed(a, b) / np.sqrt(aa * bb), -1, 1)


def _runs(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of of's values sorted (ties as given), and where each of n values begins among them, with one more."""
    return np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(n + 1))


def best(rows: Vectors, some: np.ndarray, asked: Vectors, which: np.ndarray, k: int, odd: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, distance, whether there is one) of the k nearest of some rows, which stand in order of their keys, to each of the queries `which`.

    odd: rows and queries of length zero (distance NaN, after all others) and without a vector (no distance, last) count too.
    """
    kind = rows.kind[some]
    plain = some[kind == GIVEN]
    last = [some[kind == ZERO][:k], some[kind == NONE][:k]]
    used, own = np.unique(rows.of[plain], return_inverse=True)
    order, start = _runs(own.reshape(-1), len(used))
    # of equal vectors only the k smallest keys can be among the nearest
    held = np.minimum(np.diff(start), k)
    unit = rows.unit(used)
    queries = which[asked.kind[which] == GIVEN]
    step = max(1, PAIRS // max(1, len(used)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        if len(used):
            near = asked.unit(asked.of[q]) @ unit.T
            kth = -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(used) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(near >= kth[:, None] - MARGIN)
            x, y = used[j], asked.of[q[i]]
            d = distance(rows.x[x], asked.x[y], rows.square[x], asked.square[y])
            n = held[j]
            i, d = np.repeat(i, n), np.repeat(d, n)
            inner = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            place = order[np.repeat(start[:-1][j], n) + inner]
            sort = np.lexsort((place, d, i))
            i, d, place = i[sort], d[sort], place[sort]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield q[i[keep]], plain[place[keep]], d[keep], np.ones(int(keep.sum()), bool)
        if odd and len(plain) < k:
            few = np.concatenate(last)[: k - len(plain)]
            yield np.repeat(q, len(few)), np.tile(few, len(q)), np.full(len(q) * len(few), np.nan), np.tile(rows.kind[few] == ZERO, len(q))
    if not odd:
        return
    for kinds, q in (((GIVEN, ZERO), which[asked.kind[which] == ZERO]), ((), which[asked.kind[which] == NONE])):
        there = np.isin(kind, kinds)
        few = np.concatenate([some[there][:k], some[~there][:k]])[:k]
        if len(q) and len(few):
            yield np.repeat(q, len(few)), np.tile(few, len(q)), np.full(len(q) * len(few), np.nan), np.tile(np.isin(rows.kind[few], kinds), len(q))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches joined to `most` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def nearest(rows: DataFrame, queries: pa.Table, k: int, vector: str, key: str, query_vector: str, query_id: str, place: str | None = None, cells: np.ndarray | None = None, odd: bool = False) -> DataFrame:
    """(rows' other columns, query_id, distance, and the query's number as `place`, if named) of the k rows nearest to every query in each block of rows.

    cells: for each query and value of rows' column `cell` whether to read it; else all rows are read.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((queries.select([query_vector, query_id]), cells))
    names = [c for c in rows.columns if c != vector]
    id_type = pa_to_spark(queries.schema.field(query_id).type)
    schema = StructType([f for f in rows.schema.fields if f.name != vector]).add(query_id, id_type).add("distance", DoubleType())
    if place:
        schema = schema.add(place, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = sent.value
        asked = Vectors(table.column(query_vector))
        ids = table.column(query_id).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        everyone = np.arange(len(table))
        for b in blocks(batches):
            b = b.take(pc.sort_indices(b, sort_keys=[(key, "ascending")], null_placement="at_start"))
            own = Vectors(b.column(b.schema.get_field_index(vector)), asked.dim)
            if wanted is None:
                parts = [(np.arange(b.num_rows), everyone)]
            else:
                cell = b.column(b.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)
                parts = [(np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])) for c in np.unique(cell).tolist()]
            plain = b.select(names)
            for some, which in parts:
                if not len(which):
                    continue
                for q, r, d, there in best(own, some, asked, which, k, odd):
                    out = plain.take(pa.array(r))
                    more = [ids.take(pa.array(q)), pa.array(d, pa.float64(), mask=~there)] + ([pa.array(q)] if place else [])
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], names=schema.names)

    # parts enough for all cores; each reads whole blocks
    dealt = rows.repartition(3 * spark.sparkContext.defaultParallelism, F.xxhash64(key))
    return dealt.mapInArrow(run, schema)


def apart(rows: Vectors, centres: np.ndarray) -> np.ndarray:
    """Distances of the distinct vectors to each centre, NaN for a vector of length zero; the same for equal vectors."""
    square = summed(centres, centres)
    return np.stack([distance(rows.x, c[None], rows.square, n) for c, n in zip(centres, square)], axis=1)


def angles(d: np.ndarray) -> np.ndarray:
    """Cosine distances as angles."""
    return np.arccos(np.clip(1 - d, -1, 1))


def placed(v: Column, centres: np.ndarray) -> Column:
    """(cell, angle): the centre nearest to a vector, the first of equal ones, and the angle to it; cell 0 without an angle for no vector or one of length zero."""

    @F.pandas_udf("cell int, angle double")
    def place(column: pd.Series) -> pd.DataFrame:
        own = Vectors(pa.array(column.tolist(), pa.list_(pa.float64())), centres.shape[1])
        given = own.kind == GIVEN
        cell, angle = np.zeros(len(column), np.int32), np.full(len(column), np.nan)
        if given.any():
            wide = apart(own, centres)
            wide[np.isnan(wide)] = np.inf
            cell[given] = wide.argmin(axis=1)[own.of[given]]
            angle[given] = angles(wide.min(axis=1))[own.of[given]]
        return pd.DataFrame({"cell": cell, "angle": np.where(np.isnan(angle), None, angle)})

    return place(v)


def pa_to_spark(kind: pa.DataType):
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)
