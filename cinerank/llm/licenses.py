"""License notices by diagonal voting.

Every text's rolling hashes of ``GRAM`` words are joined to the places where the
templates have them.  A hit at word p of a text and word t of a template votes for the
diagonal p - t, where a copy of the template would begin.  Votes are added up per
document, template and diagonal before the shuffle; diagonals a few words apart, as
inserted or missing words make them, merge into one span; spans with enough votes are
verified on the words themselves.  A template that must match word by word has its
diagonals apart, and a span only where all its words stand.

Cost: one pass over the texts that makes eight bytes per word, which never leave the task
that made them unless they hit a template; and one that counts words and verifies the
spans, which are joined to the documents by measured size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.anchors import Rolling, mixed
from cinerank.llm.common import batch, id_key, text_key, texts_of
from cinerank.operators.skew import materialise_measured, sized_join

GRAM = 3
# Words that may be inserted or missing between two parts of one copy.
SHIFT = 5
# Share of a template's grams that must vote for a span, and of its words that must be there.
VOTES = 0.4
COVERAGE = 0.7
# Bytes of a text that are hashed together, and words whose hashes travel together.
STRETCH = 1 << 20
CHUNK = 1 << 12

_WEIGHTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False


# Phrases that count word by word.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Notices as their public licenses give them.
NOTICES = (
    Template("mit", "Released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at",
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification,"
             " are permitted provided that the following conditions are met"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation",
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0"
             " International License"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)

_SPANS = "array<struct<label: string, start: long, end: long, coverage: double, exact: boolean>>"
_GRAMS = "did long, tk long, at long, grams array<long>"


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """Which bytes belong to words: digits, small letters, everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _word_bytes()[raw]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def stretches(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about ``STRETCH`` bytes, cut between words."""
    if len(text) <= STRETCH:
        yield text
        return
    begin = 0
    while begin < len(text):
        end = begin + STRETCH
        while end < len(text):
            gaps = np.flatnonzero(~_word_bytes()[np.frombuffer(text[end : end + 4096], np.uint8)])
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        yield text[begin:end]
        begin = end


def word_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of a lowered text's words, stretch after stretch."""
    for part in stretches(text):
        raw = np.frombuffer(part, np.uint8)
        start, end = _bounds(raw)
        if len(start):
            yield Rolling(raw.astype(np.uint64)).spans(start, end)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - GRAM + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i, weight in enumerate(_WEIGHTS):
            total += words[i : i + n] * np.uint64(weight)
    return mixed(total).view(np.int64)


def rolling_grams(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Number of the first word, and gram hashes from there on."""
    at, rest = 0, np.empty(0, np.uint64)
    for hashes in word_hashes(text):
        words = np.concatenate([rest, hashes])
        grams = gram_hashes(words)
        for begin in range(0, len(grams), CHUNK):
            yield at + begin, grams[begin : begin + CHUNK]
        at += len(grams)
        rest = words[len(grams) :]


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("did", pa.int64()), ("tk", pa.int64()), ("at", pa.int64()), ("grams", pa.list_(pa.int64()))]
    )

    def packed(held: list) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(g) for *_, g in held)])
        grams = pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), pa.array(np.concatenate([g for *_, g in held]))
        )
        return batch(schema, *[list(c) for c in zip(*(h[:3] for h in held), strict=True)], grams)

    for rows in batches:
        held, size = [], 0
        names = zip(rows.column("did").to_pylist(), rows.column("tk").to_pylist(), strict=True)
        for (did, tk), text in zip(names, texts_of(rows.column("text")), strict=True):
            for at, grams in rolling_grams(text.lower()):
                held.append((did, tk, at, grams))
                size += len(grams)
                if size >= 1 << 18:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)


def words_of(text: bytes) -> list[bytes]:
    """The words of a lowered text."""
    start, end = _bounds(np.frombuffer(text, np.uint8))
    return [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _common(template: Sequence[bytes], words: Sequence[bytes]) -> int:
    """Words of the template that stand in ``words`` in the same order: the longest such list."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(template):
        places[word] = places.get(word, 0) | 1 << i
    # One bit per word of the template; a bit that is 0 raises the list's length by one.
    full = (1 << len(template)) - 1
    row = full
    for word in words:
        match = row & places.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(template) - row.bit_count()


def _verified(templates: Sequence[Template], coverage: float):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            (
                "spans",
                pa.list_(
                    pa.struct(
                        [
                            ("label", pa.string()),
                            ("start", pa.int64()),
                            ("end", pa.int64()),
                            ("coverage", pa.float64()),
                            ("exact", pa.bool_()),
                        ]
                    )
                ),
            ),
        ]
    )
    known = [words_of(t.text.encode().lower()) for t in templates]

    def checked(text: bytes, spans: list[dict]) -> tuple[int, list[dict]]:
        # Only the words in spans are cut out of the text.
        wanted = sorted(spans, key=lambda s: s["low"])
        held: dict[int, bytes] = {}
        n, least = 0, 0
        for part in stretches(text):
            start, end = _bounds(np.frombuffer(part, np.uint8))
            for span in wanted[least:]:
                if span["low"] >= n + len(start):
                    break
                for i in range(max(span["low"], n), min(span["until"], n + len(start))):
                    held[i] = part[start[i - n] : end[i - n]]
            n += len(start)
            while least < len(wanted) and wanted[least]["until"] <= n:
                least += 1
        found = []
        for span in wanted:
            template = templates[span["template"]]
            mine = known[span["template"]]
            first, until = max(span["low"], 0), min(span["until"], n)
            words = [held[i] for i in range(first, until)]
            share = _common(mine, words) / len(mine)
            if share == 1.0 if template.exact else share >= coverage:
                entry = (template.label, first, until, share, template.exact)
                found.append(dict(zip(("label", "start", "end", "coverage", "exact"), entry, strict=True)))
        return n, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, spans = [], []
            for text, votes in zip(
                texts_of(rows.column("text")), rows.column("votes").to_pylist(), strict=True
            ):
                n, found = checked(text.lower(), votes or [])
                sizes.append(n)
                spans.append(found)
            yield batch(schema, rows.column("doc_id"), sizes, spans)

    return run


def license_spans(
    docs: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    votes: float = VOTES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (label, start, end, coverage, exact).

    A span runs from word ``start`` up to, not including, word ``end``; ``coverage`` is
    the share of the template's words that stand in it in order.  An exact template has
    a span for every place where its words stand consecutively; another one for every
    place with at least ``votes`` of its grams and ``coverage`` of its words.  Templates
    have ``GRAM`` words or more and are few: their grams are joined by measured size.

    Null and empty texts have no words and no spans.  Repeated rows and null doc_ids keep
    their rows, and rows with one doc_id their own texts.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        id_key().alias("did"),
        text_key().alias("tk"),
        "text",
    )
    places, sizes = [], []
    for number, template in enumerate(templates):
        words = words_of(template.text.encode().lower())
        if len(words) < GRAM:
            raise ValueError(f"{template.text!r} has fewer than {GRAM} words")
        hashes = np.concatenate(list(word_hashes(template.text.encode().lower())))
        grams = gram_hashes(hashes).tolist()
        need = len(grams) if template.exact else max(1, int(np.ceil(votes * len(grams))))
        shift = 0 if template.exact else min(SHIFT, len(words) // 2)
        places += [(g, number, i) for i, g in enumerate(grams)]
        sizes.append((number, len(words), need, shift))
    grams = spark.createDataFrame(places, "gram long, template int, place int")
    shapes = spark.createDataFrame(sizes, "template int, n int, need int, shift int")
    rolled = (
        source.select("did", "tk", "text")
        .mapInArrow(_rolled, _GRAMS)
        .select("did", "tk", "at", F.posexplode("grams").alias("i", "gram"))
        .select("did", "tk", (F.col("at") + F.col("i")).alias("word"), "gram")
    )
    diagonals = (
        sized_join(rolled, grams, "gram", 32 * len(places))
        .groupBy("did", "tk", "template", (F.col("word") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"))
        .transform(lambda hits: sized_join(hits, shapes, "template", 32 * len(sizes)))
    )
    one = Window.partitionBy("did", "tk", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(one) > F.col("shift")
    spans = (
        diagonals.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("_run", F.sum("_new").over(one.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("did", "tk", "template", "_run")
        .agg(
            F.min("diagonal").alias("low"),
            (F.max("diagonal") + F.first("n")).alias("until"),
            F.sum("votes").alias("votes"),
            F.first("need").alias("need"),
        )
        .filter("votes >= need")
        .groupBy("did", "tk")
        .agg(F.collect_list(F.struct("template", "low", "until")).alias("votes"))
    )
    spans, size = materialise_measured(spans, "license-spans")
    return (
        sized_join(source, spans, ["did", "tk"], size, "left")
        .select("doc_id", "text", "votes")
        .mapInArrow(_verified(templates, coverage), f"doc_id long, n_words long, spans {_SPANS}")
    )
