"""Exact duplicates through counting quotient filters.

Each partition builds a filter of its texts' 64-bit fingerprints (see
``quotient_filter``), in pieces by the leading bits, the bucket.  The pieces of a
bucket merge without loss by their sorted remainders, counts add up.  Only texts
whose fingerprint counts more than one are compared byte by byte.

Cost: one pass over all texts for fingerprints, which move as filters (about a
dozen bytes per distinct fingerprint and partition), and one over the texts whose
fingerprint repeats.  Fingerprints of more than a thousandth of all rows (at
most a thousand of them) are looked up by broadcast and their texts grouped
before the shuffle; all others are joined by fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import batch, text_key, texts_of
from cinerank.llm.quotient_filter import QuotientFilter, merge_all
from cinerank.operators.skew import lookup_join
from cinerank.session import materialise

# Distinct fingerprints that one merging step holds.
BUCKET_ROWS = 1 << 16
# At most this many fingerprints can each have more than 1 / HOT_SHARE of all rows.
HOT_SHARE = 1000
# Bytes of text that leave a worker together.
PART_BYTES = 4 << 20

_ROWS = "doc_id long, tk long, fp long, text_sha256 string"
_FILTER = "bucket int, quotient_bits int, marks binary, slots binary"
_COUNTS = pa.schema([("fp", pa.int64()), ("n", pa.int64())])


def _fingerprints(with_text: bool):
    fields = [("doc_id", pa.int64()), ("tk", pa.int64()), ("fp", pa.int64())]
    fields.append(("text_sha256", pa.string()))
    schema = pa.schema(fields + [("norm", pa.large_binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            begin, size, prints, hashes, norms = 0, 0, [], [], []

            def part(end: int) -> pa.RecordBatch:
                done = rows.slice(begin, end - begin)
                found = np.array(prints, np.uint64).view(np.int64)
                named = (done.column("doc_id"), done.column("tk"), found, hashes)
                return batch(schema, *named, *([norms] if with_text else []))

            for i, text in enumerate(texts_of(rows.column("text"))):
                # bytes.lower changes A-Z only.
                norm = text.lower()
                prints.append(xxhash.xxh3_64_intdigest(norm))
                hashes.append(hashlib.sha256(norm).hexdigest())
                if with_text:
                    norms.append(norm)
                    size += len(norm)
                if size >= PART_BYTES:
                    yield part(i + 1)
                    begin, size, prints, hashes, norms = i + 1, 0, [], [], []
            if begin < rows.num_rows:
                yield part(rows.num_rows)

    return run


def _build(bucket_bits: int):
    """One filter per partition, sent in pieces by bucket, the leading bits."""
    schema = pa.schema(
        [
            ("bucket", pa.int32()),
            ("quotient_bits", pa.int32()),
            ("marks", pa.binary()),
            ("slots", pa.binary()),
        ]
    )
    bits = 64 - bucket_bits

    def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = values >> np.uint64(bits) if bucket_bits else np.zeros_like(values)
        rest = values & np.uint64((1 << bits) - 1)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(values)]
        filters = [
            QuotientFilter.of(rest[a:b], counts[a:b], bits) for a, b in zip(starts, ends, strict=True)
        ]
        packed = [f.packed() for f in filters]
        return batch(
            schema,
            bucket[starts].astype(np.int32),
            [f.quotient_bits for f in filters],
            [marks for marks, _ in packed],
            [slots for _, slots in packed],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            values = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if len(values):
                held.append(values)
                size += len(values)
            if size >= 1 << 20:
                yield pieces(held)
                held, size = [], 0
        if held:
            yield pieces(held)

    return run


def _merge(bucket_bits: int):
    """Counts of the fingerprints that occur more than once, bucket after bucket."""
    bits = 64 - bucket_bits

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, QuotientFilter]]:
        for rows in batches:
            for row in rows.to_pylist():
                one = QuotientFilter.unpacked(bits, row["quotient_bits"], row["marks"], row["slots"])
                yield row["bucket"], one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in groupby(pieces(batches), key=itemgetter(0)):
            values, counts = merge_all(one for _, one in group).entries()
            if bucket_bits:
                values = values | (np.uint64(bucket) << np.uint64(bits))
            yield batch(_COUNTS, values[counts > 1].view(np.int64), counts[counts > 1])

    return run


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp``, ``n`` for every value of the long column ``fp`` that occurs more than once."""
    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    filters = fingerprints.select("fp").mapInArrow(_build(bits), _FILTER)
    return (
        filters.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_merge(bits), "fp long, n long")
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, tk, stands.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest doc_id stays.  A null doc_id stays only where no
    equal text has an id.  Rows that repeat doc_id and text are marked alike and
    all count in ``group_size``.  An empty table gives an empty result.  ``tk`` is the
    hash by which rows are joined to their documents again (see ``common.keyed``);
    ``stands`` marks one (doc_id, tk) of each group, where ``kept`` marks every text
    under the id that stays.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("tk"))
    rows = materialise(
        source.mapInArrow(_fingerprints(False), _ROWS),
        "fingerprints",
    )
    total = rows.count()
    repeated = materialise(repeated_fingerprints(rows, total), "repeated")
    hot = repeated.filter(F.col("n") > total / HOT_SHARE).select("fp")
    usual = repeated.filter(F.col("n") <= total / HOT_SHARE).select("fp")
    texts = source.mapInArrow(_fingerprints(True), f"{_ROWS}, norm binary")
    suspects = texts.join(F.broadcast(hot), "fp", "left_semi").unionByName(
        texts.join(usual, "fp", "left_semi")
    )
    groups = (
        suspects.groupBy("fp", "norm")
        .agg(
            # A null id is smaller than any other.
            F.max(F.struct("doc_id", "tk")).alias("first"),
            F.count("*").alias("group_size"),
            F.first("text_sha256").alias("text_sha256"),
        )
        .filter("group_size > 1")
        .drop("norm")
    )
    first = F.coalesce("first", F.struct("doc_id", "tk"))
    # A group with a large share of the rows is not gathered in one task.
    return lookup_join(rows, groups, ["fp", "text_sha256"], "left", computed=True).select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(first["doc_id"]).alias("kept"),
        "text_sha256",
        "tk",
        F.struct("doc_id", "tk").eqNullSafe(first).alias("stands"),
    )
