import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm.words import blocks, text_buffer, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB1 .\n-éÉüß€", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_and_hashes_follow_a_regular_expression(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    by_word = {}
    for first, last in blocks(offsets, 16):
        found = words(raw, offsets, first, last)
        for k in range(first, last):
            data = (texts[k] or "").encode()
            expected = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
            own = found.hashes[found.doc_bounds[k - first] : found.doc_bounds[k - first + 1]]
            assert len(own) == len(expected)
            for h, w in zip(own.tolist(), expected):
                folded = w.decode().translate({**{c: c + 32 for c in range(65, 91)}, 0xC9: 0xE9})
                assert by_word.setdefault(folded, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_of_arrays_keep_their_offsets():
    column = pa.array(["aa bb", None, "cc", "dd ee"]).slice(1)
    raw, offsets = text_buffer(column)
    assert bytes(raw) == b"ccdd ee" and offsets.tolist() == [0, 0, 2, 7]
    assert np.diff(words(raw, offsets, 0, 3).doc_bounds).tolist() == [0, 1, 2]
