import numpy as np
import pyarrow as pa
from brute import shingles as plain
from brute import words as plain_words
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import text_arrays as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB cé\n\t\x0b\x85 中😀", max_size=40)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_and_shingles_tell_apart_what_differs(texts):
    w = A.words(pa.array(texts, pa.string()))
    assert np.diff(w.first).tolist() == [len(plain_words(t)) for t in texts]
    flat = [x for t in texts for x in plain_words(t)]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))
    sets = A.shingles(w)
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain(texts[i]) & plain(texts[j]))


def test_slices_cover_and_bound():
    column = pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7)])
    parts = list(A.slices(column, 10))
    assert [first for first, _ in parts] == [0, 2, 3]
    assert pa.concat_arrays([p for _, p in parts]) == column
    assert list(A.slices(pa.array([], pa.string()))) == []


def test_a_slice_of_a_column_hashes_alike():
    column = pa.array(["one two", "Three four five", None, "one"])
    whole, part = A.words(column), A.words(column.slice(1, 3))
    assert whole.hash[2:].tolist() == part.hash.tolist()
