"""Byte-level BPE over whole texts, each distinct word encoded once.

Texts are split at single blanks; no merge of the tokenizer reaches across such a
split, because its own word pattern starts a word at every one of them.  Each
block of documents lists its distinct words, the lists meet by shard of the word,
where each distinct word is encoded once, and the ids return to the block, where
they are joined to the words by position.  Ids become text again by joining each
to its piece of the vocabulary, a table of fixed size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.blocks import (
    ANSWERED_SCHEMA,
    ASKED_SCHEMA,
    BLOCK_BYTES,
    ask_and_answer,
    blocks,
    squeeze,
    texts,
    unsqueeze,
)
from cinerank.llm.common import batch

# Words are encoded in slices of this many.
SLICE = 5_000
_RUN = regex.compile(r"\s\s")
_SINGLE = regex.compile(r"(?<=\S) (?=\S)")
# Ids of the documents that return from a block together.
GIVE_IDS = 1 << 19


def words(text: str) -> list[str]:
    """Parts of a text; all but the first begin with the blank before them."""
    parts = text.split(" ") if not _RUN.search(text) else _SINGLE.split(text)
    if parts[0] == "" and len(parts) > 1:
        # The text begins with a blank, which belongs to the part after it.
        parts = [" " + parts[1], *parts[2:]]
    return [parts[0], *(" " + p for p in parts[1:])] if text else []


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    # Tasks share the cores already; threads of its own cost memory and time.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def _shard(word: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) % shards


def _by_shard(table: pa.Table, shards: int) -> dict[int, list[str]]:
    """Distinct words of a block by shard, sorted."""
    distinct: set[str] = set()
    for text in texts(table):
        distinct.update(words(text))
    found: dict[int, list[str]] = {}
    for word in distinct:
        found.setdefault(_shard(word, shards), []).append(word)
    for held in found.values():
        held.sort()
    return found


def _ask(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows = []
        for shard, held in sorted(_by_shard(table, shards).items()):
            raw = [w.encode() for w in held]
            sizes = np.fromiter(map(len, raw), np.uint32, len(raw))
            rows.append({"block": block, "shard": shard, "keys": squeeze(sizes, b"".join(raw))})
        return pa.Table.from_pylist(rows, ASKED_SCHEMA)

    return run


def _asked_words(keys: bytes) -> list[str]:
    sizes, raw = unsqueeze(keys)
    ends = np.cumsum(np.frombuffer(sizes, np.uint32))
    starts = np.r_[0, ends[:-1]]
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _answer(path: str):
    def run(table: pa.Table) -> pa.Table:
        lists = [_asked_words(k.as_py()) for k in table.column("keys")]
        distinct = sorted(set().union(*lists))
        place = {word: i for i, word in enumerate(distinct)}
        tokenizer = _tokenizer(path)
        ids: list[bytes] = []
        for start in range(0, len(distinct), SLICE):
            encoded = tokenizer.encode_batch(
                distinct[start : start + SLICE], add_special_tokens=False
            )
            ids.extend(np.array(e.ids, np.uint32).tobytes() for e in encoded)
        rows = []
        for block, held in zip(table.column("block"), lists, strict=True):
            mine = [ids[place[word]] for word in held]
            sizes = np.fromiter(map(len, mine), np.uint32, len(mine)) // 4
            flat = np.frombuffer(b"".join(mine), np.uint32)
            # Bytes of equal weight side by side compress better.
            planes = flat.view(np.uint8).reshape(-1, 4).T
            rows.append(
                {
                    "block": block.as_py(),
                    "shard": table.column("shard")[0].as_py(),
                    "answers": squeeze(sizes, planes),
                }
            )
        return pa.Table.from_pylist(rows, ANSWERED_SCHEMA)

    return run


def _ids_of(answers: bytes) -> list[bytes]:
    sizes, planes = unsqueeze(answers)
    flat = np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes()
    ends = 4 * np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
    starts = np.r_[0, ends[:-1]]
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _give(shards: int, path: str, decoded: bool):
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields + [("decoded", pa.string())] * decoded)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        by_shard = _by_shard(table, shards)
        ids: dict[str, bytes] = {}
        for row in range(answers.num_rows):
            held = by_shard.pop(answers.column("shard")[row].as_py())
            ids.update(zip(held, _ids_of(answers.column("answers")[row].as_py()), strict=True))
        done, held, size = [], [], 0

        def finish(names: pa.Array) -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(h) for h in held)])
            flat = pa.array(np.concatenate(held).view(np.int32))
            columns = [names, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
            if decoded:
                columns.append([joined(path, h).decode("utf-8", "replace") for h in held])
            return batch(schema, *columns)

        names = table.column("doc_id").combine_chunks()
        begin = 0
        for text in texts(table):
            held.append(np.frombuffer(b"".join(map(ids.__getitem__, words(text))), np.uint32))
            size += len(held[-1])
            if size >= GIVE_IDS:
                done.append(finish(names[begin : begin + len(held)]))
                begin += len(held)
                held, size = [], 0
        if held:
            done.append(finish(names[begin:]))
        return pa.Table.from_batches(done, schema)

    return run


def encode(
    docs: DataFrame, tokenizer: str, decoded: bool = False, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id and the array ``ids`` of each document's token ids; with ``decoded``, the
    text that ``decode`` makes of them, in the same pass.

    ``tokenizer`` is the path of a tokenizers file with byte-level words that start
    at a blank, readable on every machine.  Nothing is truncated, padded or added.
    A null text is empty and has no ids.  Null doc_ids and repeated rows keep their rows.
    """
    packed, count = blocks(docs, block_bytes=block_bytes)
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return ask_and_answer(
        packed, _ask(count), _answer(tokenizer), _give(count, tokenizer, decoded), schema
    )


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The bytes of each id; null for ids that the vocabulary leaves out."""
    loaded = _tokenizer(path)
    vocabulary = loaded.get_vocab(with_added_tokens=True)
    whole = {token.content for token in loaded.get_added_tokens_decoder().values()}
    # Byte-level vocabularies write a byte as a visible character: those that have one
    # as themselves, the others in order from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    table: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        table[number] = token.encode() if token in whole else bytes(byte[c] for c in token)
    return pa.array(table, pa.binary())


def joined(path: str, ids: np.ndarray) -> bytes:
    """The pieces of ids, one after another."""
    found = pieces(path).take(pa.array(ids))
    if not len(found):
        return b""
    ends = np.frombuffer(found.buffers()[1], np.int32)
    return found.buffers()[2].slice(0, int(ends[len(found)])).to_pybytes()


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts_ = [
                joined(path, ids.values.to_numpy()).decode("utf-8", "replace")
                for ids in rows.column("ids")
            ]
            names = [*rows.schema.names, "decoded"]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts_, pa.string())], names)

    return run


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``, the text of the array ``ids``; special tokens are spelled out.

    A null array decodes to an empty text, unknown ids to nothing, and bytes that are
    no UTF-8 to the replacement character.
    """
    filled = encoded.withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<int>"))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in filled.schema)
    return filled.mapInArrow(_decoder(tokenizer), f"{schema}, decoded string")


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The hashes are of the decimal ids joined by commas and of the decoded text.
    """
    return encode(docs, tokenizer, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias(
            "ids_sha256"
        ),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
