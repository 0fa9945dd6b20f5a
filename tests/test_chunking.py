from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.config import ChunkingConfig
from quarry.operators import chunking as C

TEXTS = st.text(alphabet="ab .!\n。中；", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 40))
def test_pieces_fit_and_lose_only_separators(text, size):
    parts = list(C.pieces(text, size))
    assert all(len(p) <= size for p in parts)
    drop = set("".join(C.SEPARATORS)) | set(C.BLANKS)
    keep = lambda t: "".join(c for c in t if c not in drop)
    assert keep("".join(parts)) == keep(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(10, 60), st.integers(1, 9), st.integers(1, 20))
def test_chunks_are_bounded(text, most, least, overlap):
    c = ChunkingConfig(most, least, overlap)
    chunks = C.chunk_text(text, c)
    if len(text) <= most:
        assert chunks == [(text, 0, len(text))]
    for content, start, end in chunks:
        assert len(content) <= most + overlap + 1
        assert 0 <= start <= end <= len(text)


def test_merging():
    assert C.merged(["a", "b", "long enough", "x"], 3, 20) == ["a\nb", "long enough\nx"]
    assert C.merged(["aa", "b" * 10], 5, 11) == ["aa", "b" * 10]
    assert C.merged([], 3, 20) == []


def test_overlap_comes_from_the_piece_before():
    assert C.overlapped(["abcdef", "gh", "ij"], 3) == ["abcdef", "def\ngh", "gh\nij"]


def test_blocks_keep_tables_whole():
    text = "intro\n[表格: t]\n列: a\na: 1\n\nafter\n列: b\nb: 2\n# head"
    assert C.blocks(text) == [("intro", False), ("[表格: t]\n列: a\na: 1", True), ("\nafter", False), ("列: b\nb: 2", True), ("# head", False)]


def test_frames(spark):
    from quarry.sources.shipping import ship

    ship(spark)
    docs = spark.createDataFrame([(1, "short"), (2, ("word " * 30 + "end.\n") * 20), (3, ""), (4, None)], "doc_id long, text string")
    got = C.chunk(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["content"] == "short" and by[3][0]["content"] == "" and by[4][0]["content"] == ""
    assert sorted(r["chunk_index"] for r in by[2]) == list(range(len(by[2]))) and len(by[2]) > 2


def test_structured(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| r{i} | v{i} |" for i in range(30))
    text = f"# One\n\nintro **x**\n\n{table}\n\n## Two\n\n- item\n"
    docs = spark.createDataFrame([("m", text), ("p", "plain")], "doc_id string, text string")
    rows = sorted((r["doc_id"], r["chunk_index"], r["content"]) for r in C.chunk_structured(docs, ChunkingConfig(200, 50, 50)).collect())
    md = [r[2] for r in rows if r[0] == "m"]
    assert any("a: r0, b: v0" in c and "a: r29, b: v29" in c for c in md)
    assert md[-1].startswith("## Two")
    assert ("p", 0, "plain") in rows
