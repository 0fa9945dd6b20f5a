"""Chunking: recursive splitting, merging of small pieces, overlap; structure-aware for Markdown.

Short documents stay in generated code; longer ones are cut in Arrow batches by `chunk`.  Positions are code points.
Chunk ids are hashes of user, file, number and content, so that a replay writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import ChunkingConfig
from quarry.functions.text import column, detect_format, token_estimate
from quarry.operators import markdown

# Where texts are cut, best places first.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", "；", ";", " ")
# Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"


def pieces(text: str, size: int) -> Iterator[str]:
    """text cut at its best separators until every piece has at most `size` characters; separators and blank pieces go."""
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= size:
            yield part
            continue
        level = next((i for i in range(level, len(SEPARATORS)) if SEPARATORS[i] in part), None)
        if level is None:
            yield from (part[i : i + size] for i in range(0, len(part), size))
        else:
            smaller = (x.strip(BLANKS) for x in part.split(SEPARATORS[level]))
            todo.extend((x, level + 1) for x in reversed([x for x in smaller if x]))


def merged(parts: Iterable[str], least: int, most: int) -> list[str]:
    """Neighbours joined by a line end while the first is shorter than `least` and both fit into `most`; a short last piece joins the one before."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) < least and len(out[-1]) + 1 + len(part) <= most:
            out[-1] += "\n" + part
        else:
            out.append(part)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + 1 + len(out[-1]) <= most:
        last = out.pop()
        out[-1] += "\n" + last
    return out


def overlapped(parts: list[str], n: int) -> list[str]:
    """Each piece but the first behind the last n characters of the piece before."""
    return parts[:1] + [f"{before[-n:]}\n{part}" for before, part in zip(parts, parts[1:])]


def chunk_text(text: str, config: ChunkingConfig | None = None) -> list[tuple[str, int, int]]:
    """(content, start, end) of a text's chunks."""
    c = config or ChunkingConfig()
    if len(text) <= c.max_chunk_size:
        return [(text, 0, len(text))]
    out, cursor = [], 0
    for content in overlapped(merged(pieces(text, c.max_chunk_size), c.min_chunk_size, c.max_chunk_size), c.overlap_size):
        cursor = min(cursor, len(text))
        found = text.find(content[:50].split("\n", 1)[0], cursor)
        start = found if found >= 0 else cursor
        out.append((content, start, min(start + len(content), len(text))))
        cursor = start + len(content) // 2
    return out


def blocks(text: str) -> list[tuple[str, bool]]:
    """(block, is a table): a table begins at one of its labels and ends before a blank line or a heading."""
    out: list[tuple[list[str], bool]] = []
    inside = False
    for line in text.split("\n"):
        t = line.strip(BLANKS)
        inside = t.startswith((markdown.TABLE_LABEL.rstrip(), markdown.COLUMNS_LABEL)) or (inside and bool(t) and not t.startswith("#"))
        if not out or out[-1][1] != inside:
            out.append(([], inside))
        out[-1][0].append(line)
    joined = [("\n".join(lines), table) for lines, table in out]
    return [(b, table) for b, table in joined if b]


def chunk_section(text: str, start: int, end: int, config: ChunkingConfig) -> list[tuple[str, int, int]]:
    """A section's chunks: a table is never cut."""
    if len(text) <= config.max_chunk_size:
        return [(text, start, end)]
    if markdown.TABLE_LABEL.rstrip() not in text and markdown.COLUMNS_LABEL not in text:
        return chunk_text(text, config)
    out: list[tuple[str, int, int]] = []
    for block, table in blocks(text):
        if table:
            out.append((block, start, end))
        elif body := block.strip(BLANKS):
            out.extend(chunk_text(body, config))
    return out or chunk_text(text, config)


SCHEMA = "doc_id {kind}, chunk_index int, content string, start_pos int, end_pos int"


def _cut(rows: DataFrame, one, kind: str) -> DataFrame:
    """one(values of a row after the id) gives (content, start, end) triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            cols = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
            at, out = [], []
            for i, row in enumerate(zip(*cols)):
                for k, (content, start, end) in enumerate(one(*row)):
                    at.append(i)
                    out.append((k, content, start, end))
            each = list(zip(*out)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(each, kinds)]], names=["doc_id", "chunk_index", "content", "start_pos", "end_pos"])

    return rows.mapInArrow(run, SCHEMA.format(kind=kind))


def _finished(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", token_estimate("content"))


def chunk(docs: DataFrame, config: ChunkingConfig | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content, start_pos, end_pos, token_count) of docs; null texts count as empty."""
    c = config or ChunkingConfig()
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = F.char_length("text") <= c.max_chunk_size
    whole = rows.filter(short).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(0).alias("start_pos"), F.char_length("text").alias("end_pos"))
    return _finished(whole.unionByName(_cut(rows.filter(~short), lambda t: chunk_text(t, c), kind)))


def chunk_structured(docs: DataFrame, config: ChunkingConfig | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Chunks of Markdown documents section by section, with tables linearised and images named; others as `chunk`.

    Documents are Markdown by detection and have a heading.
    """
    c = config or ChunkingConfig()
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("sections", F.when(detect_format("text") == "markdown", markdown.sections("text")))
    structured = F.coalesce(F.size("sections"), F.lit(0)) > 0
    plain = chunk(rows.filter(~structured), c, "text", "doc_id")
    with_tables = rows.filter(structured)
    own = markdown.tables(with_tables).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "raw_text", "linearized"))).alias("tables"))
    joined = with_tables.join(own, "doc_id", "left").select("doc_id", "sections", "tables")

    def one(sections, tables):
        for s in sections:
            content = s["content"]
            for t in tables or ():
                content = content.replace(t["raw_text"], t["linearized"], 1)
            content = named_images(content)
            head = "#" * s["level"] + " " + s["title"] + "\n\n" if s["title"] else ""
            yield from chunk_section(head + content, s["start"], s["end"], c)

    return plain.unionByName(_finished(_cut(joined, one, kind)))


def named_images(text: str) -> str:
    import re

    return re.sub(markdown.IMAGE, lambda m: f"{markdown.IMAGE_LABEL}: {m[1]}]" if m[1] else f"{markdown.IMAGE_LABEL}]", text)


def choose(docs: DataFrame, config: ChunkingConfig | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The strategy used for indexing: by structure if the configuration says so."""
    c = config or ChunkingConfig()
    return (chunk_structured if c.structure_aware else chunk)(docs, c, text, doc_id)


def chunk_id(user: Column | str, file: Column | str, index: Column | str, content: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[column(c).cast("string") for c in (user, file, index, content)]), 256)


def split_fixed(docs: DataFrame, size: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content): every `size` characters, in generated code."""
    n = F.floor((F.char_length(text) - 1) / size).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return docs.filter(F.char_length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.posexplode(cuts).alias("chunk_index", "content"))


def split_at(docs: DataFrame, separator: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content): one level of splitting, trimmed, without blank parts."""
    from quarry.functions.text import trimmed

    parts = F.filter(F.transform(F.split(text, "\\Q" + separator + "\\E"), trimmed), lambda x: x != "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("chunk_index", "content"))


def with_overlap(chunks: DataFrame, n: int = 200) -> DataFrame:
    """Chunks behind the last n characters of the chunk before, by a window over each document's chunks."""
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("content", F.when(before.isNull(), F.col("content")).otherwise(F.concat(F.right(before, F.lit(n)), F.lit("\n"), F.col("content"))))
