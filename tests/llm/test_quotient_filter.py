"""Counting quotient filters against plain counters."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinerank.llm.exact_dedup import repeated_fingerprints
from cinerank.llm.quotient_filter import CONTINUED, OCCUPIED, SHIFTED, QuotientFilter, merge_all

# Few bits crowd the slots; the largest values press against the last slot.
CROWDED = st.lists(st.integers(0, 255) | st.integers(240, 255), max_size=300)
WIDE = st.lists(st.integers(0, 2**64 - 1) | st.sampled_from([0, 1, 2**63, 2**64 - 1]), max_size=60)


def filter_of(values, bits):
    found, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    return QuotientFilter.of(found, counts, bits)


def content(one):
    return dict(zip(*(x.tolist() for x in one.entries()), strict=True))


@settings(max_examples=200, deadline=None)
@given(CROWDED)
def test_entries_of_crowded_slots(values):
    one = filter_of(values, 8)
    assert content(one) == Counter(values)
    assert list(content(one)) == sorted(set(values))


@settings(max_examples=100, deadline=None)
@given(WIDE, WIDE)
def test_merged_is_the_filter_of_both(left, right):
    merged = filter_of(left, 64).merged(filter_of(right, 64))
    want = filter_of(left + right, 64)
    assert content(merged) == Counter(left + right)
    assert merged.packed() == want.packed()


@settings(max_examples=100, deadline=None)
@given(st.lists(CROWDED, max_size=12))
def test_many_merge_in_any_order(parts):
    filters = [filter_of(p, 8) for p in parts]
    every = Counter(v for p in parts for v in p)
    for order in (filters, filters[::-1]):
        merged = merge_all(iter(order))
        assert (content(merged) if merged else {}) == every


@settings(max_examples=50, deadline=None)
@given(CROWDED)
def test_packed_round_trip(values):
    one = filter_of(values, 8)
    again = QuotientFilter.unpacked(8, one.quotient_bits, *one.packed())
    assert content(again) == Counter(values)


def test_marks_of_a_small_filter():
    """Four fingerprints of six bits in eight slots: two of quotient 1, one of 2, one of 5."""
    one = filter_of([0b001_010, 0b001_111, 0b010_000, 0b101_001], 6)
    assert one.quotient_bits == 3
    assert one.slots.tolist() == [0, 0b010, 0b111, 0b000, 0, 0b001]
    assert one.marks.tolist() == [0, OCCUPIED, OCCUPIED | CONTINUED | SHIFTED, SHIFTED, 0, OCCUPIED]


@pytest.mark.parametrize("rows", [1, 1 << 20])
def test_repeated_fingerprints_of_a_table(spark, rows):
    """Once in one bucket, once in many; a third of the rows are one value."""
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 3000)]
    values += values[:500] + values[:100] + [-1, -1, 0] + [7] * 1500
    table = spark.createDataFrame([(v,) for v in values], "fp long").repartition(7)
    found = {r["fp"]: r["n"] for r in repeated_fingerprints(table, rows).collect()}
    assert found == {v: n for v, n in Counter(values).items() if n > 1}


def test_no_fingerprints(spark):
    assert repeated_fingerprints(spark.createDataFrame([], "fp long"), 0).count() == 0
