import numpy as np
import pyarrow as pa
import pytest

from lumenward.llm import words as W
from tests.llm import brute

TEXTS = ["", None, "  ", "one", " Two  words ", "tab\tnew\nline\rfeed\x0bform\x0cend", "é ü ß", "a b", "b a", "\x1fodd \x00zero"]


@pytest.mark.parametrize("piece", [None, 8])
def test_words_are_the_same_as_by_regex(monkeypatch, piece):
    if piece:
        monkeypatch.setattr(W, "PIECE_BYTES", piece)
        W._powers.cache_clear()
    column = pa.array([*TEXTS, "x" * 100 + " " + "y" * 50])
    data, bounds = W.text_buffer(column)
    starts, ends, counts = W.word_spans(data, bounds)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    want = [brute.words(t, lower=False) for t in column.to_pylist()]
    assert found == [w for ws in want for w in ws] and counts.tolist() == [len(w) for w in want]
    hashes = W.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))
    assert all((hashes[i] == hashes[j]) == (found[i] == found[j]) for i in range(len(found)) for j in range(len(found)))
    W._powers.cache_clear()


def test_slices_of_an_array_and_a_batch():
    column = pa.array([None, "ab c", "d", "", "efg"])[1:]
    data, bounds = W.text_buffer(column)
    assert bytes(data) == b"ab cdefg" and bounds.tolist() == [0, 4, 5, 5, 8]
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    assert [p.num_rows for p in W.slices([batch], "text", 5)] == [3, 1]
    assert sum(p.num_rows for p in W.slices([batch, batch.slice(0, 0)], "text", 1)) == 4


def test_windows():
    column = pa.array(["a b c d", "a b", "", "b c d"])
    data, bounds = W.text_buffer(column)
    starts, ends, counts = W.word_spans(data, bounds)
    windows, per_row = W.window_hashes(W.word_hashes(data, starts, ends), counts, 3)
    assert per_row.tolist() == [2, 1, 0, 1]
    assert windows[1] == windows[3] and len(set(windows.tolist())) == 3


def test_words_as_an_arrow_array():
    column = pa.array(["a bc", " ", "def"])
    data, bounds = W.text_buffer(column)
    starts, ends, _ = W.word_spans(data, bounds)
    assert W.word_array(data, starts, ends).to_pylist() == ["a", "bc", "def"]
    assert np.array_equal(W.mix64(np.arange(3, dtype=np.uint64)), W.mix64(np.arange(3, dtype=np.uint64)))
