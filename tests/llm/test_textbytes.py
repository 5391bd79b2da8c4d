import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reefline.llm import textbytes as tb

from .cases import lower, odd_texts, shingles, words


def test_hash_of_slices_is_xxh64():
    data = np.frombuffer(bytes(range(256)) * 40, np.uint8)
    start = np.arange(0, 3000, 7)
    length = (start * 31) % 300
    length[:3] = [0, 5000, 9000]
    got = tb.xxh64(data, start, length, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:a + n].tobytes(), 42) for a, n in zip(start, length, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0bé 　🙂", max_size=30), max_size=6))
def test_words_and_shingles_match_the_pattern(found):
    data, offsets = tb.buffers(pa.array(found, pa.string()))
    start, end, counts = tb.word_spans(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(start, end, strict=True)] == [w for t in found for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in found]
    text, a, b = tb.joined_words(data, start, end)
    first, last, n = tb.shingle_words(counts, 3)
    got = [text[a[i]:b[j]].tobytes().decode() for i, j in zip(first, last, strict=True)]
    assert got == [s for t in found for s in shingles(t, 3)] and n.tolist() == [len(shingles(t, 3)) for t in found]


def test_null_slices_and_pieces():
    column = pa.array(["zero", None, "one two", ""]).slice(1)
    data, offsets = tb.buffers(column)
    assert data.tobytes() == b"one two" and offsets.tolist() == [0, 0, 7, 7]
    assert [*tb.pieces(np.array([0, 5, 6, 30, 31]), 10)] == [(0, 2), (2, 3), (3, 4)]
    assert lower("ÀB") == "Àb" and tb.strings(data, offsets).to_pylist() == ["", "one two", ""]
    assert len(odd_texts()) > 15
