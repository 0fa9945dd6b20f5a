"""Token counts by byte-pair merging with a heap and a linked list.

Texts are cut at the tokenizer's special strings (one token each, as its library
counts them), then by its pre-tokenisation pattern.  A pre-token starts as one
symbol a byte; the adjacent pair of lowest rank is popped from a heap and merged
in a doubly linked list until no ranked pair is left.  The count is the initial
symbols less the merges: no identifier is made.  A long run without blanks costs
n log n.  Counts of pre-tokens met before come from a table kept in the Python
worker, emptied when it holds `CACHED` entries; it changes speed only.

Null and empty texts have n_bytes = n_tokens = 0.  Every row is counted on its
own, whatever its doc_id; further columns pass through `count`.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 512
CACHED = 1_000_000
#: Longer pre-tokens are counted anew each time, so the table's memory is bounded.
CACHED_CHARS = 40

#: The vocabulary's pre-tokenisation, white space spelled as the Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Token counts by pre-token."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbol: dict[str, int] = {}
        number = lambda s: symbol.setdefault(s, len(symbol))
        self.of_byte = [number(c) for c in byte_letters()]
        # pair -> (rank, the merged symbol) in one number: what the heap orders by
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[number(a), number(b)] = (rank, number(a + b))
        specials = [regex.escape(x["content"]) for x in file.get("added_tokens", ())]
        self.special = regex.compile("|".join(specials)) if specials else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = self.merged(piece.encode("utf-8"))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n

    def merged(self, raw: bytes) -> int:
        n = count = len(raw)
        if n < 2:
            return n
        of_byte, ranks = self.of_byte, self.ranks.get
        symbols = [of_byte[b] for b in raw]
        heap = []
        for i in range(n - 1):
            found = ranks((symbols[i], symbols[i + 1]))
            if found is not None:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, left, right, new = pop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks((new, symbols[k]))
                if found is not None:
                    push(heap, (found[0], i, new, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = ranks((symbols[h], new))
                if found is not None:
                    push(heap, (found[0], h, symbols[h], new, found[1]))
        return count

    def text(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (which replace columns of those names), without the text."""
    path = path or vocabulary_path()
    rest = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for b in batches:
            n_bytes, n_tokens = [], []
            for x in b.column(len(rest)):
                x = x.as_py() or ""
                n_bytes.append(len(x.encode("utf-8")))
                n_tokens.append(of.text(x))
            kept = [b.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=schema.names
            )

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(text).alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
