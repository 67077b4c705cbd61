"""Counting quotient filters: compact sorted multisets of fingerprints.

A fingerprint's leading bits, its quotient, name the slot it would like to have; the
slot holds the other bits, its remainder.  Remainders of one quotient form a run, in
order; runs follow each other by quotient and move right where slots are taken.  Three
bits a slot say where runs belong (see the constants), a fourth that the slot counts the
remainder before it, which only those seen more than once need.  Nothing is lost: the
bits give back every fingerprint, in order, and filters merge as sorted lists do,
whatever their numbers of slots.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# Some fingerprint has this slot's number as its quotient.
OCCUPIED = 1
# The slot's run began in an earlier slot.
CONTINUED = 2
# The slot's content would like an earlier slot.
SHIFTED = 4
# The slot counts the remainder before it.
COUNTER = 8
# Share of the slots that a new filter fills at most.
LOAD = 0.75


@dataclass(frozen=True)
class QuotientFilter:
    """``marks`` and ``slots`` end with the last slot in use."""

    bits: int
    quotient_bits: int
    marks: np.ndarray
    slots: np.ndarray

    def __len__(self) -> int:
        return len(self.slots)

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From ascending distinct fingerprints below 2^bits, and how often each occurs."""
        several = counts > 1
        content = len(fingerprints) + int(several.sum())
        quotient_bits = min(bits, max(1, int(content / LOAD).bit_length()))
        low = np.uint64(bits - quotient_bits)
        quotient = (fingerprints >> low).astype(np.int64)
        width = 1 + several.astype(np.int64)
        wish = np.repeat(quotient, width)
        counter = np.repeat(several, width)
        counter[np.cumsum(width) - width] = False
        value = np.repeat(fingerprints & ((np.uint64(1) << low) - np.uint64(1)), width)
        value[counter] = counts[several]
        index = np.arange(content)
        # The wished slot, or the one after the content before.
        place = index + np.maximum.accumulate(wish - index)
        size = int(place[-1]) + 1 if content else 0
        marks, slots = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        slots[place] = value
        marks[quotient] = OCCUPIED
        marks[place[1:][wish[1:] == wish[:-1]]] |= CONTINUED
        marks[place[place != wish]] |= SHIFTED
        marks[place[counter]] |= COUNTER
        return cls(bits, quotient_bits, marks, slots)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, ascending, and their counts."""
        # An occupied slot is never empty: if nothing came before, its run begins there.
        used = np.flatnonzero(self.marks)
        marks, value = self.marks[used], self.slots[used]
        run = np.cumsum((marks & CONTINUED) == 0) - 1
        quotient = np.flatnonzero(self.marks & OCCUPIED)[run].astype(np.uint64)
        counter = (marks & COUNTER) > 0
        whole = (quotient << np.uint64(self.bits - self.quotient_bits)) | value
        counts = np.ones(int((~counter).sum()), np.int64)
        counts[np.cumsum(~counter)[counter] - 1] = value[counter].astype(np.int64)
        return whole[~counter], counts

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both multisets; counts of equal fingerprints add up."""
        mine, counts = self.entries()
        more, further = other.entries()
        at = np.searchsorted(mine, more)
        equal = np.zeros(len(more), bool)
        inside = at < len(mine)
        equal[inside] = mine[at[inside]] == more[inside]
        counts[at[equal]] += further[equal]
        return QuotientFilter.of(
            np.insert(mine, at[~equal], more[~equal]),
            np.insert(counts, at[~equal], further[~equal]),
            self.bits,
        )

    def packed(self) -> tuple[bytes, bytes]:
        """Marks, two slots a byte, and slots."""
        even = np.r_[self.marks, np.zeros(len(self.marks) % 2, np.uint8)]
        return (even[::2] | (even[1::2] << 4)).tobytes(), self.slots.tobytes()

    @classmethod
    def unpacked(cls, bits: int, quotient_bits: int, marks: bytes, slots: bytes) -> QuotientFilter:
        content = np.frombuffer(slots, np.uint64)
        pairs = np.frombuffer(marks, np.uint8)
        each = np.column_stack([pairs & 15, pairs >> 4]).ravel()[: len(content)]
        return cls(bits, quotient_bits, each, content)


def merge_all(filters: Iterable[QuotientFilter]) -> QuotientFilter | None:
    """One filter of many that come one by one; None without any.

    Filters wait until one of their size comes, so each entry is merged a logarithmic
    number of times, and what waits is at most about twice the largest.
    """
    waiting: list[QuotientFilter] = []
    for one in filters:
        while waiting and len(waiting[-1]) <= 2 * len(one):
            one = waiting.pop().merged(one)
        waiting.append(one)
    while len(waiting) > 1:
        last = waiting.pop()
        waiting.append(waiting.pop().merged(last))
    return waiting[0] if waiting else None
