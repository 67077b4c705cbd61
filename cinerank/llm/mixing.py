"""Mixing sources to target weights by balanced (cube method) sampling.

A source whose target is r times its size takes every document floor(r) times
and each once more with probability r - floor(r).  Which documents those are is
drawn by the cube method: three undecided documents at a time, probabilities
move along the null space of the constraints (total words and total documents)
until one of them is 0 or 1.  At most two documents of a group stay undecided;
those of all groups of a source fly again together.  The few left at the end, and
ten documents of spread sizes that were held back, are landed on a choice that
comes close to the target in words and documents.

A flight moves a large document little, so one that outweighs what could make up for
it would be landed on any side.  Such documents, at most 1 / ``LARGE_SHARE`` of a
source, are drawn before the flights, and what their draw adds or lacks is taken
off the probability of all others.

A source of any size is cut into groups of about ``GROUP`` documents by a hash,
so no task sees a whole source, and each level leaves about ``HELD`` + 2 documents
of a group to the next.  A source that is one group lands there and then.  All draws
come from hashes: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import batch
from cinerank.session import materialise

GROUP = 2000
MOST_COPIES = 3
# Documents of a group that stay out of its flight, to be landed with what flights leave.
HELD = 10
# A document is large with more than this share of its source, and so many average sizes.
LARGE_SHARE, LARGE_SIZES = 0.01, 3
# Draws of a source's large documents, until the others can make up for one.
DRAWS = 64
# Share of the target within which landing prefers the right number of documents.
CLOSE = 0.001
WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9

_UNITS = (
    "doc_id long, source string, size long, mark long, base int, prob double, need double, once int"
)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, docs for a table of source and size.

    Weights are 1, 2, 3, repeating, by code point of the source, null last, of the
    total size.  A target stops at three times the source's size; what is above
    goes to the others by weight, again and again.  Equivalently, targets are
    min(3 size, level * weight) for the one level that spends the total, and
    the sources with the smallest 3 size / weight are the stopped ones.

    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs")
    )
    ranked = totals.withColumn(
        "weight",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1,
    ).withColumn("most", (F.col("source_size") * MOST_COPIES).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(rest)
    )
    levels = ranked.withColumn("level", level).withColumn(
        "open", F.col("most") > F.col("level") * F.col("weight")
    )
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    return levels.withColumn("final", final).select(
        "source",
        "source_size",
        "docs",
        F.when(F.col("final").isNull(), F.col("most"))
        .otherwise(F.least("most", F.col("final") * F.col("weight")))
        .alias("target"),
    )


def null_direction(sizes: list[float]) -> tuple[float, float, float]:
    """A vector u with sum(u) = 0 and sum(u * sizes) = 0."""
    a, b, c = sizes
    if a == b == c:
        return 1.0, -1.0, 0.0
    return b - c, c - a, a - b


def fly(probabilities: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Flight phase; all but at most two of the results are 0 or 1."""
    out = probabilities.astype(float).copy()
    draws = random.random(len(out) + 1)
    held: list[int] = []
    for unit in range(len(out)):
        if _EDGE < out[unit] < 1 - _EDGE:
            held.append(unit)
        if len(held) < 3:
            continue
        direction = null_direction([float(sizes[i]) for i in held])
        up = down = np.inf
        for i, u in zip(held, direction, strict=True):
            if u > 0:
                up, down = min(up, (1 - out[i]) / u), min(down, out[i] / u)
            elif u < 0:
                up, down = min(up, out[i] / -u), min(down, (1 - out[i]) / -u)
        step = up if draws[unit] * (up + down) < down else -down
        for i, u in zip(held, direction, strict=True):
            out[i] += step * u
            if out[i] < _EDGE:
                out[i] = 0.0
            elif out[i] > 1 - _EDGE:
                out[i] = 1.0
        held = [i for i in held if 0 < out[i] < 1]
    return out


def draw_large(
    sizes: np.ndarray, share: float, rest: float, random: np.random.Generator
) -> np.ndarray:
    """Which large documents, in falling order, to take of a source with ``rest`` words besides.

    Each is drawn with the probability that all undecided words have, which keeps the
    expected words.  Of several draws the first counts after which the rest can fill
    the target, or else the one that misses it least.
    """
    left = rest + sizes.sum() - np.cumsum(sizes)
    whole = share * (rest + sizes.sum())
    best, least = np.zeros(len(sizes), bool), np.inf
    for _ in range(DRAWS):
        need, now = whole, share
        taken = np.zeros(len(sizes), bool)
        for i, (size, draw) in enumerate(zip(sizes, random.random(len(sizes)), strict=True)):
            missed = [max(n - left[i], -n, 0.0) for n in (need, need - size)]
            taken[i] = missed[1] < missed[0] if max(missed) > 0 else draw < now
            need -= size * taken[i]
            now = min(max(need / left[i], 0.0), 1.0) if left[i] > 0 else now
        missed = max(need - rest, -need, 0.0)
        if missed < least:
            best, least = taken, missed
        if least == 0:
            break
    return best


def land(probabilities: np.ndarray, sizes: np.ndarray, need: float) -> np.ndarray:
    """Decides the last units, of which there are few, among all their choices.

    First the total is to be within ``CLOSE`` of the best possible, then the number
    of documents near its expectation, then the total as near as can be.
    """
    out = probabilities.copy()
    left = np.flatnonzero((out > 0) & (out < 1))
    if not len(left):
        return out
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    settled = (out == 0) | (out == 1)
    apart = np.abs(float((out * sizes)[settled].sum()) + choices @ sizes[left] - need)
    docs = np.abs(choices.sum(axis=1) - out[left].sum())
    near = apart <= apart.min() + CLOSE * abs(need)
    best = np.lexsort((apart, docs, ~near))[0]
    out[left] = choices[best]
    return out


def fly_without_held(
    probabilities: np.ndarray, sizes: np.ndarray, random: np.random.Generator
) -> np.ndarray:
    """Flight of all but ``HELD`` documents of spread sizes, which stay as they are."""
    held = np.unique(np.linspace(0, len(sizes) - 1, HELD).astype(int))
    flying = np.setdiff1d(np.arange(len(sizes)), held)
    out = probabilities.astype(float).copy()
    out[flying] = fly(out[flying], sizes[flying], random)
    return out


def fly_and_land(
    probabilities: np.ndarray, sizes: np.ndarray, need: float, random: np.random.Generator
) -> np.ndarray:
    """Last flight of a source, whose held documents land with what it leaves."""
    return land(fly_without_held(probabilities, sizes, random), sizes, need)


def _settle_large(table: pa.Table) -> pa.Table:
    """A source's large documents, decided, with the share and need of its others."""
    order = [("size", "descending"), ("mark", "ascending"), ("doc_id", "ascending")]
    table = table.sort_by(order)
    size = table.column("size").to_numpy().astype(float)
    share, need = table.column("prob")[0].as_py(), table.column("need")[0].as_py()
    rest = table.column("source_size")[0].as_py() - size.sum()
    random = np.random.default_rng(int(table.column("mark").to_numpy().view(np.uint64)[0]))
    taken = draw_large(size, share, rest, random)
    need -= float(size[taken].sum())
    share = min(max(need / rest, 0.0), 1.0) if rest > 0 else share
    # As exactly decided as a flight leaves it.
    share = 0.0 if share <= _EDGE else 1.0 if share >= 1 - _EDGE else share
    n = table.num_rows
    kept = table.select(["doc_id", "source", "size", "mark", "base"])
    return (
        kept.append_column("prob", pa.array(np.full(n, share)))
        .append_column("need", pa.array(np.full(n, need)))
        .append_column("once", pa.array(taken.astype(np.int32)))
    )


def _flight():
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("source", pa.string()),
            ("size", pa.int64()),
            ("mark", pa.int64()),
            ("base", pa.int32()),
            ("prob", pa.float64()),
            ("need", pa.float64()),
            ("once", pa.int32()),
        ]
    )

    def settle(rows: pa.Table) -> pa.RecordBatch:
        prob = rows.column("prob").to_numpy()
        size = rows.column("size").to_numpy()
        seed = int(rows.column("mark").to_numpy().view(np.uint64)[0])
        random = np.random.default_rng(seed)
        if rows.column("chunks")[0].as_py() == 1:
            after = fly_and_land(prob, size, rows.column("need")[0].as_py(), random)
        else:
            after = fly_without_held(prob, size, random)
        settled = (after == 0) | (after == 1)
        once = pa.array(after.astype(np.int32), mask=~settled)
        kept = [rows.column(name).combine_chunks() for name in schema.names[:5]]
        return batch(schema, *kept, after, rows.column("need").combine_chunks(), once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            key = rows.column("place").to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = [0, *cuts.tolist(), rows.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                piece = rows.slice(begin, end - begin)
                if held and held[-1].column("place")[0] != piece.column("place")[0]:
                    yield settle(pa.Table.from_batches(held))
                    held = []
                held.append(piece)
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _fly_level(units: DataFrame) -> DataFrame:
    """One flight over groups of each source, and the landing of sources of one group."""
    chunk = F.pmod("mark", "chunks")
    placed = units.withColumn("chunk", chunk).withColumn("place", F.xxhash64("source", "chunk"))
    return (
        placed.repartition("source", "chunk")
        .sortWithinPartitions("place", "source", "chunk", F.desc("size"), "mark", "doc_id")
        .drop("chunk")
        .mapInArrow(_flight(), _UNITS)
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies, mark.

    size counts words (null text: 0); taken is copies times size, at most three
    sizes.  Null is a source of its own, the last.  An empty document is taken as
    often as any other and adds nothing.  Repeated rows are documents of their own.
    A source of total size 0 has target 0 and is not taken.  ``mark``, a hash of doc_id
    and text, goes with each row so that it can be joined to its document again.
    """
    text = F.coalesce("text", F.lit(""))
    sizes = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            doc_mark().alias("mark"),
        ),
        "sizes",
    )
    targets = materialise(source_targets(sizes), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _EDGE).cast("int")
    plan = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        "docs",
        whole.alias("base"),
        F.greatest(F.lit(0.0), ratio - whole).alias("share"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP)).cast("long").alias("chunks"),
    )
    # One row per source; a plain join, which Spark broadcasts if it is small.
    units = sizes.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    same = units.filter(F.col("share") <= _EDGE)
    settled = [same.select("doc_id", "source", "size", "mark", F.col("base").alias("copies"))]
    flying = units.filter(F.col("share") > _EDGE).select(
        "doc_id",
        "source",
        "size",
        "mark",
        "base",
        F.col("share").alias("prob"),
        (F.col("target") - F.col("base") * F.col("source_size")).alias("need"),
        "chunks",
        "source_size",
        (
            (F.col("size") > F.col("source_size") * LARGE_SHARE)
            & (F.col("size") * F.col("docs") > F.col("source_size") * LARGE_SIZES)
        ).alias("large"),
    )
    large = materialise(
        flying.filter("large")
        .drop("chunks", "large")
        .groupBy("source")
        .applyInArrow(_settle_large, _UNITS),
        "large",
    )
    settled.append(
        large.select(
            "doc_id", "source", "size", "mark", (F.col("base") + F.col("once")).alias("copies")
        )
    )
    # One row per source with large documents.
    others = large.groupBy(F.col("source").alias("_source")).agg(
        F.first("prob").alias("_prob"), F.first("need").alias("_need")
    )
    flying = (
        flying.filter(~F.col("large"))
        .join(others, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumns(
            {"prob": F.coalesce("_prob", "prob"), "need": F.coalesce("_need", "need")}
        )
        .drop("source_size", "large", "_source", "_prob", "_need")
    )
    most = targets.agg(F.max("docs")).first()[0] or 0
    while True:
        flown = materialise(_fly_level(flying), "flown")
        settled.append(
            flown.filter("once IS NOT NULL").select(
                "doc_id", "source", "size", "mark", (F.col("base") + F.col("once")).alias("copies")
            )
        )
        if most <= GROUP:
            break
        # What is decided is taken off the need of what is not.
        taken = flown.groupBy("source").agg(
            F.sum(F.coalesce(F.col("once"), F.lit(0)) * F.col("size")).alias("_taken"),
            F.sum(F.col("once").isNull().cast("long")).alias("_left"),
        )
        taken = materialise(taken.withColumnRenamed("source", "_source"), "left")
        flying = (
            flown.filter("once IS NULL")
            .join(taken, F.col("source").eqNullSafe(F.col("_source")))
            .select(
                "doc_id",
                "source",
                "size",
                "mark",
                "base",
                "prob",
                (F.col("need") - F.col("_taken")).alias("need"),
                F.greatest(F.lit(1), F.ceil(F.col("_left") / GROUP)).cast("long").alias("chunks"),
            )
        )
        most = taken.agg(F.max("_left")).first()[0] or 0
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    totals = plan.select("_source", "source_size", "target")
    return result.join(totals, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "source",
        F.col("copies").cast("int").alias("copies"),
        "mark",
    )


def doc_mark() -> Column:
    """The hash by which ``mix_sources`` draws; names a document together with its id."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
