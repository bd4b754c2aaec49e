import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import words
from vigil.llm.words import slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é \n\t\x0b\x1c漢", max_size=12)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_words_of_slices(texts, most):
    seen = []
    for part in slices(pa.array(texts, pa.string()), most=most):
        for k, row in enumerate(part.rows):
            seen.append(row)
            own = slice(part.word_edges[k], part.word_edges[k + 1])
            assert [bytes(part.data[a:b]) for a, b in zip(part.starts[own], part.ends[own])] == words(texts[row])
    assert seen == list(range(len(texts)))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_window_hashes_are_equal_for_equal_words_only(texts, size):
    found = {}
    for part in slices(pa.array(texts, pa.string()), most=9):
        hashes, doc, first = part.windows(size)
        for h, d, f in zip(hashes.tolist(), doc.tolist(), first.tolist()):
            k = f - part.word_edges[d]
            found.setdefault(h, set()).add(tuple(words(texts[part.rows[d]])[k:k + size]))
    want = {tuple(w[k:k + size]) for w in map(words, texts) for k in range(len(w) - size + 1)}
    assert all(len(v) == 1 for v in found.values())
    assert set().union(*found.values()) == want if found else not want


def test_slice_of_an_array_with_offset():
    arr = pa.array(["x", "a b", None, "c"]).slice(1)
    assert [int(n) for part in slices(arr) for n in part.n_words] == [2, 0, 1]
    assert list(slices(pa.array([], pa.string()))) == []
    assert np.array_equal([p.rows.start for p in slices(pa.array(["a" * 50] * 3), most=10)], [0, 1, 2])
