"""Looking up what many documents need from a large distributed table.

Documents are dealt to blocks of about ``BLOCK_BYTES`` of text by a hash of row and place.  A block
asks for each distinct key it holds once, the questions of all blocks meet by
shard of the key, and the answers return to the block in the order asked.  Texts
are shuffled once, compressed, and both uses read the same shuffle files; what
moves besides is the distinct keys per block, not one row per occurrence, so a
key that is in every text costs one entry per block.

A block is the unit of memory: a task holds one at a time.  A single text longer
than a block is a block of its own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import batch, parts_for, text_bytes

BLOCK_BYTES = 16 << 20
ROW_RUN = 16
ASKED = "block int, shard int, keys binary"
ASKED_SCHEMA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary())])
ANSWERED = "block int, shard int, answers binary"
ANSWERED_SCHEMA = pa.schema(
    [("block", pa.int32()), ("shard", pa.int32()), ("answers", pa.binary())]
)


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Parts of known type, compressed together."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.uint64)[0])
    sizes = np.frombuffer(raw[8 : 8 * (n + 1)], np.uint64).astype(int)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("block", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("body", pa.binary())]
    )
    press = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        bodies = (press.compress((t.as_py() or "").encode()) for t in rows.column("text"))
        yield batch(
            schema, rows.column("block"), rows.column("doc_id"), rows.column("tag"), list(bodies)
        )


def texts(table: pa.Table) -> Iterator[str]:
    """Texts of a block, one at a time."""
    open_ = zstandard.ZstdDecompressor()
    for body in table.column("body"):
        yield open_.decompress(body.as_py()).decode()


def blocks(
    docs: DataFrame, tag: Column | None = None, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, int]:
    """Compressed documents with their block, and the number of blocks.

    ``tag`` is an int column that goes with each document.  Equal rows are dealt out by
    where they stand, ``ROW_RUN`` neighbours together; a table that is read from files
    gives a repeated task the same rows in the same order.
    """
    _, size = text_bytes(docs)
    count = parts_for(size, block_bytes)
    run = F.expr(f"monotonically_increasing_id() div {ROW_RUN}")
    packed = docs.select(
        F.pmod(F.xxhash64("doc_id", "text", run), F.lit(count)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.lit(0) if tag is None else tag).cast("int").alias("tag"),
        "text",
    ).mapInArrow(_pack, "block int, doc_id long, tag int, body binary")
    return packed, count


def ask_and_answer(
    packed: DataFrame,
    ask: Callable[[pa.Table], pa.Table],
    answer: Callable[[pa.Table], pa.Table],
    give: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """Rows that ``give`` makes of each block and the answers to what it asked."""
    asked = packed.groupBy("block").applyInArrow(ask, ASKED)
    answered = asked.groupBy("shard").applyInArrow(answer, ANSWERED)
    return packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(give, schema)
