"""Texts longer than the bits of a place can number."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from cinerank.llm import anchors
from cinerank.llm.substrings import SHAPE as WORDS
from cinerank.llm.substrings import open_windows
from cinerank.llm.suffixes import SHAPE as BYTES
from cinerank.llm.suffixes import _gather


@pytest.fixture
def narrow(monkeypatch):
    """Nine bits for a place, stretches of a few windows."""
    monkeypatch.setattr(anchors, "STRETCH", 150)
    monkeypatch.setattr(anchors, "_PLACE", np.uint64(511))


def test_smallest_of_many(narrow):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    for count in (1, 7, 41, 71):
        views = np.lib.stride_tricks.sliding_window_view(hashes, count)
        want = views.argmin(axis=1) + np.arange(len(views))
        assert anchors.smallest(hashes, count).tolist() == want.tolist()


def opened(text, shape):
    """A batch with one text, all of whose anchors are open."""
    place, key, _ = anchors.anchors(shape.tokens(text), shape)
    marks = [
        {"key": k, "start": p}
        for p, k in zip(place.tolist(), key.view(np.int64).tolist(), strict=True)
    ]
    body = zstandard.ZstdCompressor().compress(text)
    return pa.RecordBatch.from_pylist([{"did": 1, "tk": 2, "marks": marks, "body": body}])


def test_every_word_window_of_a_long_text_is_compared(narrow):
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(3000)).encode()
    found = pa.Table.from_batches(open_windows(WORDS)(iter([opened(text, WORDS)])))
    assert sorted(found.column("start").to_pylist()) == list(range(3000 - WORDS.width + 1))


def test_every_byte_window_of_a_long_text_is_compared(narrow):
    text = random.Random(3).randbytes(9000)
    windows = []
    for part in _gather(BYTES)(iter([opened(text, BYTES)])):
        for row in part.to_pylist():
            first = row["place"] - row["lead"]
            last = first + len(row["bytes"]) - BYTES.width
            assert text[first : last + BYTES.width] == row["bytes"]
            windows.extend(range(first, last + 1))
    assert sorted(windows) == list(range(9000 - BYTES.width + 1))
