"""Scoring with user and item factors: rows of (id, features)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.functions.vectors import dot, norm
from cinerank.operators.cells import BATCH_ROWS, packed, part_of, received, sent, to_every
from cinerank.operators.ordinal import global_ordinal
from cinerank.operators.skew import BROADCAST_LIMIT, lookup_join, measured_bytes, sized_join
from cinerank.operators.topk import as_ranked_list, top_k
from cinerank.session import materialise

USER_BATCH = 512
BATCH_SCORES = 1 << 22
ITEM_CHUNK = 4096
# Users scored together against a block: of like direction, they skip the same of its pieces.
VISIT_BATCH = 4096
# Neighbours among a block's items that are skipped together, and ranges of norms they are cut from.
PIECE_ITEMS = 256
PIECE_BANDS = 16
# Numbers that are worked on together where many passes go over them.
CACHED = 1 << 18
# Numbers in the vectors of a block of items; blocks grow to the larger size before there
# are more than so many of them.  Larger ones at once would be copied to more tasks each.
BLOCK_NUMBERS = 2_000_000
MOST_BLOCK_NUMBERS = 12_800_000
BLOCKS = 8
# Multiplications that one task makes for users against broadcast items.
PRODUCTS_PER_TASK = 1 << 28
# The same against a block of items, as long as there are fewer than so many tasks.
PRODUCTS_PER_VISIT = 1 << 36
VISIT_TASKS = 32
PIVOTS = 256
# Measured bytes of the vectors that a part of the users or films has for predictions, and how
# many parts there are at least, so that there are tasks enough, and at most: a vector is sent to
# as many tasks as the other side has parts.
PART_BYTES = 192 * 1024 * 1024
LEAST_PARTS = 5
MOST_PARTS = 16
# Scores are compared after rounding, so bounds give way by more than one step.
DECIMALS = 6
SLACK = 2e-6

_PAIRS = "user_id int, movie_id int, score double"
# ``place`` counts a visitor's items in a block, best first.
_PLACED = f"{_PAIRS}, place int"


def predict_pairs(
    pairs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    rank: int | None = None,
) -> DataFrame:
    """``pairs`` with ``prediction``; pairs with an unknown user or film are dropped.

    Factors within a broadcast are joined to the pairs where these are.  Beyond it pairs and
    vectors meet in cells (``_predict_in_cells``), so that no pair carries a vector through a shuffle.
    Where there are too many vectors for that, or they are not alike, the pairs are
    stored, so that what made them runs once and hot keys are counted on them and not on rows
    that carry vectors.
    """
    users = user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("_user"))
    items = item_factors.select(F.col("id").alias("movie_id"), F.col("features").alias("_item"))
    n_users, n_items = measured_bytes(users), measured_bytes(items)
    if max(n_users, n_items) > BROADCAST_LIMIT:
        grid = [max(LEAST_PARTS, -(-size // PART_BYTES)) for size in (n_users, n_items)]
        width = _common_width(user_factors, item_factors, rank) if max(grid) <= MOST_PARTS else None
        if width is not None and _are_integral(pairs, user_factors, item_factors):
            return _predict_in_cells(pairs, user_factors, item_factors, width, grid)
        pairs = materialise(pairs, "pairs")
    joined = sized_join(pairs, users, "user_id", n_users, counted=pairs)
    joined = sized_join(joined, items, "movie_id", n_items, counted=pairs)
    return joined.withColumn("prediction", dot(F.col("_user"), F.col("_item"), rank)).drop(
        "_user", "_item"
    )


def _are_integral(pairs: DataFrame, *factors: DataFrame) -> bool:
    kinds = [pairs.schema[c].dataType for c in ("user_id", "movie_id")] + [f.schema["id"].dataType for f in factors]
    return all(isinstance(kind, T.IntegralType) for kind in kinds)


def _common_width(users: DataFrame, items: DataFrame, rank: int | None) -> int | None:
    """Numbers that a product takes, if all vectors have them."""
    size = F.size("features")
    odd = F.col("features").isNull() | F.exists("features", lambda v: v.isNull())
    found = [
        side.filter(F.col("id").isNotNull())
        .agg(F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(odd).alias("odd"))
        .first()
        for side in (users, items)
    ]
    if any(row["least"] is None or row["odd"] for row in found):
        return None
    if rank is not None:
        return rank if min(row["least"] for row in found) >= rank else None
    widths = {row[name] for row in found for name in ("least", "most")}
    return widths.pop() if len(widths) == 1 else None


def _predict_in_cells(
    pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, width: int, grid: list[int]
) -> DataFrame:
    """``predict_pairs`` by tasks that hold the vectors of one part of the users and one of the films.

    A pair is sent to its task once, in packs without vectors, and read there as a stream.  A
    vector is sent to as many tasks as the other side has parts.  A user or film with very
    many pairs is met in all parts of the other side.
    """
    names = [c for c in pairs.columns if c != "prediction"]
    rows = pairs.select(*names).dropna(subset=["user_id", "movie_id"])
    # A join by names puts its keys first.
    rows = rows.select("movie_id", "user_id", *[c for c in names if c not in ("user_id", "movie_id")])
    across, down = grid[1], grid[0]

    def cell(table: pa.Table) -> np.ndarray:
        user, item = (table.column(c).to_numpy() for c in ("user_id", "movie_id"))
        return part_of(user, down) * across + part_of(item, across)

    sides = []
    for factors, parts in ((user_factors, down), (item_factors, across)):
        vectors = factors.filter(F.col("id").isNotNull()).select(
            F.col("id").cast("long").alias("id"), F.slice("features", 1, width).alias("features")
        )
        sides.append(packed(vectors, lambda t, parts=parts: part_of(t.column("id").to_numpy(), parts)))
    part = F.col("part")
    users = to_every(sides[0], F.sequence(part * across, part * across + (across - 1)))
    items = to_every(sides[1], F.sequence(part, part + (down - 1) * across, F.lit(across)))
    asked = packed(rows, cell).select(F.col("part").alias("task"), "payload")
    schema = T.StructType([*rows.schema, T.StructField("prediction", T.DoubleType())])

    def held(tables: list[pa.Table]):
        if not tables:
            return np.empty(0, np.int64), np.empty((0, width))
        table = pa.concat_tables(tables)
        ids = table.column("id").to_numpy()
        flat = table.column("features").combine_chunks().flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], flat.reshape(len(ids), width)[order]

    def places(ids: np.ndarray, wanted: np.ndarray):
        first = np.searchsorted(ids, wanted)
        return first, np.searchsorted(ids, wanted, "right") - first

    def score(table: pa.Table, known) -> Iterator[pa.RecordBatch]:
        keys = [table.column(c).to_numpy() for c in ("user_id", "movie_id")]
        (user, n_user), (item, n_item) = (places(ids, k) for (ids, _), k in zip(known, keys, strict=True))
        # An id is there once or not at all; more often, it meets as often as a join would let it.
        times = n_user * n_item
        row = np.repeat(np.arange(len(times)), times)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        left = known[0][1][user[row] + turn // np.maximum(n_item[row], 1)]
        right = known[1][1][item[row] + turn % np.maximum(n_item[row], 1)]
        # Added in the order of the numbers, as ``dot`` does.
        total = np.zeros(len(row))
        for i in range(width):
            total += left[:, i].astype(np.float64) * right[:, i].astype(np.float64)
        if len(row) != table.num_rows or (times != 1).any():
            table = table.take(pa.array(row))
        yield from table.append_column("prediction", pa.array(total)).to_batches(BATCH_ROWS)

    def run(batches):
        now, tables, known = None, ([], []), None
        for task, kind, table in received(batches):
            if task != now:
                now, tables, known = task, ([], []), None
            if kind < 2:
                tables[kind].append(table)
                continue
            if known is None:
                known, tables = [held(some) for some in tables], ([], [])
            yield from score(table, known)

    return sent([users, items, asked], down * across).mapInArrow(run, schema)


def _fuzz(users: np.ndarray, longest: float, kind: type) -> np.ndarray:
    """How far products of each user can be off, in numbers of ``kind``."""
    error = (users.shape[1] + 8) * np.finfo(kind).eps
    return error * np.linalg.norm(users, axis=1) * longest + 1e-30


def _bars(need: np.ndarray, users: np.ndarray, fuzz: np.ndarray, metric: str, slack: float) -> np.ndarray:
    """The least product by which an item can reach the score ``need``, for each user.

    ``need`` is a rounded score; for l2 that is a distance, negative, and the vectors are
    the extended ones of ``nearest_vectors``.
    """
    if metric == "l2":
        own = 0.25 * np.square(users[:, :-1]).sum(axis=1)
        return own - np.square(slack - need) - fuzz
    return need - slack - fuzz


def _quick(vectors: np.ndarray) -> np.ndarray:
    """The vectors in short numbers, in which products are tried first, if these can hold them."""
    return vectors.astype(np.float32) if np.abs(vectors).max(initial=0.0) < 1e15 else vectors


def _below(bars: np.ndarray, kind: np.dtype) -> np.ndarray:
    """``bars`` in numbers of ``kind``, and not above what they were."""
    return np.nextafter(bars.astype(kind), kind.type(-np.inf))


def _reached(above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the numbers that are not negative, which are few: looked for eight at a time."""
    found = (above >= 0).ravel()
    whole = len(found) // 8 * 8
    near = (np.flatnonzero(found[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    places = np.concatenate([near[found[near]], whole + np.flatnonzero(found[whole:])])
    return np.divmod(places, above.shape[1])


def _scores_of(users, vectors, row, col, metric: str, decimals: int) -> np.ndarray:
    """Rounded scores of the pairs (row, col) in full numbers."""
    found = np.empty(len(row))
    step = max(1, BATCH_SCORES // users.shape[1])
    for start in range(0, len(row), step):
        some = slice(start, start + step)
        if metric == "l2":
            apart = 0.5 * users[row[some], :-1] - vectors[col[some], :-1]
            found[some] = -np.sqrt(np.square(apart).sum(axis=1))
        else:
            found[some] = np.einsum("ij,ij->i", users[row[some]], vectors[col[some]])
    return np.round(found, decimals)


def _score_block(k: int, item_chunk: int, decimals: int, slack: float, metric: str = "dot"):
    """Build the numpy kernel: exact top-k of each user over one block of items.

    The items come in pieces.  ``ceilings`` bounds the products of each piece (a row) with
    each user; a batch visits the pieces by falling bound, and only its users that
    can reach their k-th score so far.  Products are tried in short numbers
    (``quick``), and those near enough to matter are taken in full ones.
    """

    def best(users, vectors, quick, ids, floor, bounds, ceilings):
        # -> (row, id, score) of the k best per user; `floor` are scores to reach.
        longest = float(np.sqrt(np.square(vectors).sum(axis=1).max(initial=0.0)))
        # The best so far of each user, best first.
        vals = np.full((len(users), k), -np.inf)
        cols = np.zeros((len(users), k), np.int64)
        filled = np.zeros(len(users), np.int64)
        need = floor.copy()
        brief = _quick(users)
        if brief.dtype != quick.dtype:
            brief, quick = users, vectors
        # A user's bar is one number more in its product, which then tells whether it is reached.
        fuzz = 2 * _fuzz(users, longest, quick.dtype)
        bars = _bars(need, users, fuzz, metric, slack)
        asking = np.column_stack([brief, -_below(bars, quick.dtype)])
        edged = np.column_stack([quick, np.ones(len(quick), quick.dtype)])
        for piece in np.argsort(-ceilings.sum(axis=1), kind="stable"):
            begin, end = bounds[piece]
            for start in range(begin, end, item_chunk):
                stop = min(start + item_chunk, end)
                live = np.flatnonzero(ceilings[piece] >= bars)
                if not len(live):
                    break
                above = asking[live] @ edged[start:stop].T
                unknown = np.flatnonzero(np.isposinf(asking[live, -1]))
                if len(unknown) and stop - start > k:
                    # Without a score to reach, the k best of the chunk are asked for, and ties.
                    some = live[unknown]
                    products = brief[some] @ quick[start:stop].T
                    kth = np.partition(products, -k, axis=1)[:, -k] - fuzz[some]
                    if metric == "l2":
                        own = 0.25 * np.square(users[some, :-1]).sum(axis=1)
                        kth = -np.sqrt(np.maximum(own - kth, 0.0) + 1e-12 * (1 + own))
                    bar = _bars(kth - slack, users[some], fuzz[some], metric, slack)
                    above[unknown] = products - _below(bar, products.dtype)[:, None]
                r, c = _reached(above)
                if not len(r):
                    continue
                r = live[r]
                score = _scores_of(users, vectors, r, start + c, metric, decimals)
                # Rows come in order of users: each one's so far and the new ones are ranked anew.
                some = r[np.r_[True, r[1:] != r[:-1]]]
                old = np.repeat(some, filled[some])
                turn = np.arange(len(old)) - np.repeat(np.cumsum(filled[some]) - filled[some], filled[some])
                row = np.concatenate([old, r])
                col = np.concatenate([cols[old, turn], ids[start + c]])
                val = np.concatenate([vals[old, turn], score])
                order = np.lexsort((col, -val, row))
                row, col, val = row[order], col[order], val[order]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                sizes = np.diff(np.r_[heads, len(row)])
                place = np.arange(len(row)) - np.repeat(heads, sizes)
                keep = place < k
                vals[row[keep], place[keep]] = val[keep]
                cols[row[keep], place[keep]] = col[keep]
                filled[some] = np.minimum(sizes, k)
                need[some] = np.maximum(need[some], vals[some, k - 1])
                bars[some] = _bars(need[some], users[some], fuzz[some], metric, slack)
                asking[some, -1] = -_below(bars[some], quick.dtype)
        known = np.arange(k) < filled[:, None]
        return np.repeat(np.arange(len(users)), filled), cols[known], vals[known]

    return best


def _batch_rows(k: int, most: int = USER_BATCH) -> int:
    """Users scored together: fewer where each of them is to get very many items."""
    return max(1, min(most, BATCH_SCORES // k))


def _with_norm(factors: DataFrame) -> DataFrame:
    return factors.select("id", "features", norm(F.col("features")).alias("norm"))


def _matrix_of(column) -> np.ndarray:
    """List column of equal-length vectors as a matrix (used on the driver only)."""
    return np.stack([np.asarray(value, np.float64) for value in column])


def _score_against(
    users: DataFrame, items: DataFrame, k: int, decimals: int, metric: str = "dot"
) -> DataFrame:
    """Top-k of each user over items that fit one broadcast (the caller has measured)."""
    shared = _shared(items)
    if shared is None:
        return users.sparkSession.createDataFrame([], _PAIRS)
    return _score_shared(users, shared, k, decimals, metric)


def _shared(items: DataFrame):
    """Vectors and ids by falling norm as a broadcast; None without any."""
    rows = items.orderBy(F.desc("norm"), "id").select("id", "features").toPandas()
    if rows.empty:
        return None
    held = (_matrix_of(rows["features"]), rows["id"].to_numpy(np.int64))
    return items.sparkSession.sparkContext.broadcast(held)


def _score_shared(users: DataFrame, shared, k: int, decimals: int, metric: str) -> DataFrame:
    """``_score_against`` for vectors and ids that have been broadcast, by falling norm."""
    batch_rows = _batch_rows(k)
    kernel = _score_block(k, ITEM_CHUNK, decimals, SLACK, metric)

    def score(batches):
        vectors, ids = shared.value
        quick = _quick(vectors)
        width = vectors.shape[1]
        starts = np.arange(0, len(vectors), ITEM_CHUNK)
        bounds = np.column_stack([starts, np.minimum(starts + ITEM_CHUNK, len(vectors))])
        # The first of a chunk is its longest.
        norms = np.linalg.norm(vectors[starts], axis=1) * (1 + 1e-12)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                users_ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = _vectors(part.column("features"), width)
                floor = np.full(len(users_ids), -np.inf)
                ceilings = norms[:, None] * np.linalg.norm(matrix, axis=1)
                row, col, val = kernel(matrix, vectors, quick, ids, floor, bounds, ceilings)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(users_ids[row], pa.int32()),
                        pa.array(col, pa.int32()),
                        pa.array(val, pa.float64()),
                    ],
                    names=["user_id", "movie_id", "score"],
                )

    # A small file of users is one task, however many items there are.
    tasks = -(-users.count() * shared.value[0].size // PRODUCTS_PER_TASK)
    asking = users.select("id", "features")
    if tasks <= 1:
        return asking.mapInArrow(score, _PAIRS)
    # Scores cost far more than they take room, and a caller may read them more than once.
    return materialise(asking.repartition(tasks, "id").mapInArrow(score, _PAIRS), "scores")


def _vectors(column: pa.Array, width: int | None = None) -> np.ndarray:
    """List column as a matrix; vectors of different lengths are an error."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if width is None and len(lengths) else width or 0
    if (lengths != width).any():
        raise ValueError(f"vectors of {sorted({*lengths.tolist(), width})} numbers in one search")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lengths), width)


def _pivots(items: DataFrame) -> np.ndarray:
    """Directions that items are sorted to: those of ``PIVOTS`` items with the least hashes.

    They decide where items are stored and what is skipped, never what is found.  Each is
    followed by the nearest one that is left, so that a block holds neighbours.
    """
    chosen = items.filter("norm > 0").orderBy(F.xxhash64("id"), "id").limit(PIVOTS)
    rows = chosen.select("features").toPandas()
    if rows.empty:
        rows = items.select("features").limit(1).toPandas()
        return np.zeros((1, len(rows["features"][0]) if len(rows) else 1))
    matrix = _matrix_of(rows["features"])
    pivots = np.unique(matrix / np.linalg.norm(matrix, axis=1)[:, None], axis=0)
    cosines = pivots @ pivots.T
    order = [0]
    while len(order) < len(pivots):
        near = cosines[order[-1]].copy()
        near[order] = -np.inf
        order.append(int(near.argmax()))
    return pivots[order]


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1)
    cosines = (matrix @ pivots.T) / np.where(lengths > 0, lengths, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _to_cells(pivots: np.ndarray):
    """Nearest pivot, angle to it, and the tenth of a power of e in which the norm is."""

    def run(batches):
        for batch in batches:
            norms = batch.column("norm").to_numpy(zero_copy_only=False)
            cell = np.full(len(norms), -1)
            angle = np.zeros(len(norms))
            some = np.flatnonzero(norms > 0)
            if len(some):
                vectors = _vectors(batch.column("features").take(pa.array(some)), pivots.shape[1])
                angles = _angles(vectors, pivots)
                cell[some] = angles.argmin(axis=1)
                angle[some] = angles[np.arange(len(some)), cell[some]]
            band = np.floor(-10 * np.log(np.where(norms > 0, norms, 1.0)))
            columns = [pa.array(cell, pa.int32()), pa.array(angle), pa.array(band, pa.int32())]
            names = [*batch.schema.names, "cell", "angle", "band"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return run


def _blocks_of(items: DataFrame, block_items: int | None) -> tuple[DataFrame, np.ndarray]:
    """Items with their ``block``, and the pivots.

    A block holds neighbours: items of a few pivots, or those of one pivot that are of
    like norm, in a ring of angles.  There are few blocks, since a user's vector is sent to
    each block it visits: ``BLOCKS`` of them, unless one would be very small or would not
    fit a task.
    """
    pivots = _pivots(items)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}"
    placed = items.mapInArrow(_to_cells(pivots), f"{schema}, cell int, angle double, band int")
    placed = materialise(placed, "cells")
    keys = ["cell", "band", "angle", "id"]
    n_items = placed.count()
    if block_items is None:
        least, most = (max(1, n // pivots.shape[1]) for n in (BLOCK_NUMBERS, MOST_BLOCK_NUMBERS))
        block_items = min(most, max(least, -(-n_items // BLOCKS)))
    # Blocks of one size, so that tasks are alike.  Keys are sorted without the vectors.
    numbered = global_ordinal(placed.select(*keys), keys)
    block = F.expr(f"(ordinal - 1) * {-(-n_items // block_items)} div {n_items}")
    firsts = numbered.groupBy(block.alias("block")).agg(F.min(F.struct(*keys)).alias("first"))
    # One short row for each block; a vector's block is the last that begins no later.
    begins = [row["first"] for row in firsts.orderBy("block").collect()[1:]]
    if not begins:
        return placed.withColumn("block", F.lit(0).cast("long")), pivots
    kinds = placed.select(*keys).schema
    literals = [
        F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kinds]) for row in begins
    ]
    own = F.struct(*keys)
    block = F.size(F.filter(F.array(*literals), lambda first: first <= own)).cast("long")
    return placed.withColumn("block", block), pivots


def _bounds_of(blocks: DataFrame) -> dict[str, np.ndarray]:
    """What is known of each block and pivot: as many short rows as blocks and pivots together."""
    rows = (
        blocks.groupBy("block", "cell")
        .agg(
            F.min("angle").alias("nearest"),
            F.max("angle").alias("farthest"),
            F.min("norm").alias("shortest"),
            F.max("norm").alias("longest"),
            F.count("*").alias("n"),
        )
        .orderBy("block", "cell")
        .toPandas()
    )
    return {name: rows[name].to_numpy() for name in rows.columns}


def _ceilings(lengths: np.ndarray, angles: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """The largest product that each vector can have with an item of each block.

    By the triangle inequality of angles an item is at least as far from the vector as
    the vector's angle to the pivot is from the block's ring.  Angles are rounded by
    about 2e-8, and give way by more.
    """
    to_pivot = angles[:, np.maximum(known["cell"], 0)]
    gap = np.maximum(to_pivot - known["farthest"], known["nearest"] - to_pivot)
    cosine = np.cos(np.maximum(gap - 1e-7, 0.0))
    # An obtuse angle gives the most with the shortest item.
    reach = np.where(cosine >= 0, known["longest"], known["shortest"]) * cosine
    return lengths[:, None] * np.where(known["cell"] < 0, 0.0, reach)


def _to_visits(pivots: np.ndarray, known: dict[str, np.ndarray], k: int, first: bool, metric: str):
    """Blocks that each user visits: at first those of the most promising parts that hold ``k``
    items, then all others that can reach the user's k-th score so far."""
    # ``known`` is ordered by block, so a block's parts stand side by side.
    names, begins = np.unique(known["block"], return_index=True)
    longest = float(known["longest"].max(initial=0.0))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, USER_BATCH):
                part = batch.slice(start, USER_BATCH)
                users = _vectors(part.column("features"), pivots.shape[1])
                lengths = np.linalg.norm(users, axis=1)
                angles = _angles(users, pivots)
                ceilings = _ceilings(lengths, angles, known)
                order = np.argsort(-ceilings, axis=1, kind="stable")
                before = np.cumsum(known["n"][order], axis=1) - known["n"][order]
                begun = np.zeros(ceilings.shape, bool)
                np.put_along_axis(begun, order, before < k, axis=1)
                visited = np.logical_or.reduceat(begun, begins, axis=1)
                if not first:
                    floor = part.column("floor").to_numpy(zero_copy_only=False)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    bars = _bars(floor, users, _fuzz(users, longest, np.float64), metric, SLACK)
                    hopeful = np.logical_or.reduceat(ceilings >= bars[:, None], begins, axis=1)
                    visited = ~visited & hopeful
                row, block = np.nonzero(visited)
                visits = part.take(pa.array(row))
                visits = visits.append_column("block", pa.array(names[block], pa.int64()))
                direction = angles.argmin(axis=1)[row]
                yield visits.append_column("direction", pa.array(direction, pa.int32()))

    return run


def _split_by_direction(vectors: np.ndarray, begin: int, end: int, most: int, order: np.ndarray) -> list[int]:
    """Halve the places ``begin`` to ``end`` of ``order`` across their widest direction until a piece
    has ``most`` of them; gives where the pieces begin."""
    begins, open_parts = [], [(begin, end)]
    while open_parts:
        begin, end = open_parts.pop()
        if end - begin <= most:
            begins.append(begin)
            continue
        some = vectors[order[begin:end]]
        some = some - some.mean(axis=0)
        along = some @ np.linalg.eigh(some.T @ some)[1][:, -1]
        middle = (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(along, middle)]
        open_parts += [(begin, begin + middle), (begin + middle, end)]
    return begins


def _pieces(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Vectors and ids of a block in pieces, where these begin and end, and what is known of each.

    Items of like norm are cut to pieces of like direction: a piece is a cone around
    its mean direction and a range of norms.  Few pieces then reach far in a user's direction.
    """
    norms, ids = table.column("norm").to_numpy(), table.column("id").to_numpy().astype(np.int64)
    vectors = _vectors(table.column("features").combine_chunks())
    order = np.lexsort((ids, -norms))
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
    bands = int(np.clip(len(ids) // (4 * PIECE_ITEMS), 1, PIECE_BANDS))
    cuts = np.linspace(0, len(ids), bands + 1).astype(np.int64)
    begins = []
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > begin:
            begins += _split_by_direction(units, int(begin), int(end), PIECE_ITEMS, order)
    begins = np.sort(np.array(begins))
    vectors, units, lengths, ids = vectors[order], units[order], lengths[order], ids[order]
    counts = np.diff(np.r_[begins, len(ids)])
    middle = np.add.reduceat(units, begins)
    middle /= np.maximum(np.linalg.norm(middle, axis=1), 1e-300)[:, None]
    cosine = np.einsum("ij,ij->i", units, np.repeat(middle, counts, axis=0))
    # Angles are rounded by about 2e-8 near the middle, and give way by more.
    widest = np.arccos(np.clip(np.minimum.reduceat(cosine, begins), -1.0, 1.0)) + 1e-7
    known = {
        "middle": middle.astype(np.float32),
        "widest": np.minimum(widest, np.pi),
        "shortest": np.minimum.reduceat(lengths, begins),
        "longest": np.maximum.reduceat(lengths, begins),
    }
    return vectors, ids, np.column_stack([begins, begins + counts]), known


def _piece_ceilings(users: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """The largest product that an item of each piece (a row) can have with each user.

    The item is no nearer to the user than the edge of the piece's cone.  In short numbers: the
    cosine is off by a few roundings, and the bound gives way by more.
    """
    lengths = np.linalg.norm(users, axis=1)
    units = (users / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)
    longest, shortest = known["longest"], known["shortest"]
    # Lengths that short numbers do not hold stay in full ones.
    kind = np.float32 if lengths.max(initial=0.0) * longest.max(initial=0.0) < 1e30 else np.float64
    edge, side = (f(known["widest"]).astype(np.float32)[:, None] for f in (np.cos, np.sin))
    longest, shortest = (norms.astype(kind)[:, None] for norms in (longest, shortest))
    lengths = (lengths * (1 + 1e-6)).astype(kind)
    slack = np.float32(8 * (users.shape[1] + 8) * np.finfo(np.float32).eps)
    ceilings = np.empty((len(longest), len(users)), kind)
    # A few pieces at a time, which stay in the processor's cache.
    step = max(1, CACHED // max(1, len(users)))
    for start in range(0, len(longest), step):
        some = slice(start, start + step)
        cosine = known["middle"][some] @ units.T
        # Inside the cone the angle to it is none.
        np.minimum(cosine, edge[some], out=cosine)
        reach = cosine * cosine
        np.subtract(1, reach, out=reach)
        np.maximum(reach, 0, out=reach)
        np.sqrt(reach, out=reach)
        reach *= side[some]
        cosine *= edge[some]
        reach += cosine
        reach += slack
        # An obtuse angle gives the most with the shortest item.
        found = np.multiply(reach, longest[some], out=ceilings[some])
        np.maximum(found, reach * shortest[some], out=found)
        found *= lengths
    return ceilings


def _crowds(visits: DataFrame, blocks: DataFrame, width: int, n_users: int | None = None) -> DataFrame:
    """block, salts, first: how many tasks a block's visitors are dealt out to, and the number
    of the first of these.

    Tasks are shared out by work, and a block's items are copied to each of its tasks: there
    are at most ``VISIT_TASKS`` (or two for each core) and one a block, however many visitors.
    With ``n_users``, of all users, these are the tasks for every pair of user and item, and
    visits that are a part of the pairs get the same part of them, or one for each core.
    """
    sizes = blocks.groupBy("block").agg(F.count("*").alias("_items"))
    crowds = visits.groupBy("block").agg(F.count("*").alias("_users")).join(sizes, "block")
    cores = visits.sparkSession.sparkContext.defaultParallelism
    tasks = max(VISIT_TASKS, 2 * cores)
    work = F.col("_users") * F.col("_items")
    # One row for each block, here and below.
    every = Window.partitionBy()
    visited = F.sum(work).over(every)
    pairs = visited if n_users is None else n_users * F.sum("_items").over(every)
    share = F.round(work * F.greatest(tasks / pairs, cores / visited))
    enough = F.ceil(work * width / PRODUCTS_PER_VISIT)
    dealt = crowds.select("block", F.greatest(F.lit(1), F.least(enough, share)).cast("int").alias("salts"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("salts").over(before), F.lit(0)).cast("int")
    return materialise(dealt.withColumn("first", first), "visitors")


def _score_visits(
    visits: DataFrame,
    blocks: DataFrame,
    pivots: np.ndarray,
    k: int,
    decimals: int,
    metric: str,
    n_users: int | None = None,
) -> DataFrame:
    """The best ``k`` items of each visited block for each visitor, with their ``place``.

    Each task gets a block's items and after them the visitors that fall to it, ordered by
    direction.  It holds the items and one batch of visitors, so any number of these may come.
    """
    crowds = _crowds(visits, blocks, pivots.shape[1], n_users)
    tasks = crowds.agg(F.sum("salts")).first()[0] or 1
    salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    asking = visits.join(F.broadcast(crowds), "block").select(
        (F.col("first") + salt).alias("task"), F.lit(1).alias("visitor"), "direction", "id", "features", "floor"
    )
    numbers = F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)
    asked = blocks.join(F.broadcast(crowds), "block").select(
        F.explode(numbers).alias("task"),
        F.lit(0).alias("visitor"),
        "id",
        "features",
        "norm",
        "cell",
        "angle",
        "band",
    )
    batch_rows = _batch_rows(k, VISIT_BATCH)
    kernel = _score_block(k, ITEM_CHUNK, decimals, SLACK, metric)
    schema = pa.schema(
        [("user_id", pa.int32()), ("movie_id", pa.int32()), ("score", pa.float64()), ("place", pa.int32())]
    )

    def best(part: pa.RecordBatch, block):
        vectors, quick, ids, bounds, known = block
        users = _vectors(part.column("features"), vectors.shape[1])
        user_ids = part.column("id").to_numpy()
        floors = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        floors = np.where(np.isnan(floors), -np.inf, floors)
        for start in range(0, len(users), batch_rows):
            some = slice(start, start + batch_rows)
            asking = users[some]
            ceilings = _piece_ceilings(asking, known)
            row, col, val = kernel(asking, vectors, quick, ids, floors[some], bounds, ceilings)
            # The kernel keeps each visitor's items together, best first.
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
            place = np.arange(len(row)) - np.repeat(heads, np.diff(np.r_[heads, len(row)])) + 1
            columns = (user_ids[some][row], col, val, place)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def score(batches):
        task, items, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, visitor = (batch.column(name).to_numpy() for name in ("task", "visitor"))
            turns = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(visitor) != 0)) + 1
            for begin, end in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                part = batch.slice(begin, end - begin)
                if numbers[begin] != task:
                    task, items, block = numbers[begin], [], None
                if not visitor[begin]:
                    items.append(part)
                    continue
                if block is None:
                    vectors, ids, bounds, known = _pieces(pa.Table.from_batches(items))
                    block, items = (vectors, _quick(vectors), ids, bounds, known), []
                yield from best(part, block)

    return (
        asked.unionByName(asking, allowMissingColumns=True)
        .repartitionById(tasks, F.col("task"))
        .sortWithinPartitions("task", "visitor", "direction")
        .mapInArrow(score, _PLACED)
    )


def pivot_visits(
    users: DataFrame,
    blocks: DataFrame,
    pivots: np.ndarray,
    k: int,
    floors: DataFrame | None,
    metric: str = "dot",
) -> DataFrame:
    """id, features, floor, block, direction: which users visit which blocks, see ``_to_visits``."""
    known = _bounds_of(blocks)
    if floors is None:
        asking = users.select("id", "features", F.lit(None).cast("double").alias("floor"))
    else:
        # Two numbers a user, so that the vectors stay where they are.
        known_floors = floors.withColumnRenamed("user_id", "id")
        asking = lookup_join(users, known_floors, "id", "left").select("id", "features", "floor")
    kind = asking.schema["features"].dataType.simpleString()
    return asking.mapInArrow(
        _to_visits(pivots, known, k, floors is None, metric),
        f"id int, features {kind}, floor double, block long, direction int",
    )


def _floors(scored: DataFrame, k: int) -> DataFrame:
    """A score that ``k`` items of a block reach, the best of each user's blocks so far.

    One row a visit is sent, and not its list.
    """
    reached = scored.filter(F.col("place") == k).groupBy("user_id")
    return reached.agg(F.max("score").alias("floor"))


def _placed_items(item_factors: DataFrame, limit: int, block_items: int | None):
    """Items as they are searched: by falling norm in a broadcast if their measured size is
    within ``limit``, else (blocks, pivots)."""
    items = _with_norm(item_factors)
    if measured_bytes(items) > limit:
        return _blocks_of(items, block_items)
    return _shared(items)


def _best_items(user_factors: DataFrame, placed, k: int, decimals: int, metric: str = "dot") -> DataFrame:
    """``top_k_items`` for items from ``_placed_items``."""
    spark = user_factors.sparkSession
    if not isinstance(placed, tuple):
        scored = spark.createDataFrame([], _PAIRS)
        if placed is not None:
            scored = _score_shared(_with_norm(user_factors), placed, k, decimals, metric)
        return top_k(scored, k, "user_id", "score", "movie_id")
    blocks, pivots = placed
    # Read several times, and a caller's users may be costly.
    users = materialise(user_factors.select(F.col("id").cast("int").alias("id"), "features"), "askers")
    n_users = users.count()
    first = pivot_visits(users, blocks, pivots, k, None, metric)
    begun = materialise(_score_visits(first, blocks, pivots, k, decimals, metric, n_users), "first-scores")
    floors = materialise(_floors(begun, k), "floors")
    others = pivot_visits(users, blocks, pivots, k, floors, metric)
    rest = _score_visits(others, blocks, pivots, k, decimals, metric, n_users)
    if k > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        # Lists as long as that are counted before they are cut.
        rest = materialise(rest, "scores")
    scored = begun.unionByName(rest).drop("place")
    # Lists of all visits are sent once, and what is left of them is stored.
    return materialise(top_k(scored, k, "user_id", "score", "movie_id"), "ranked")


def top_k_items(
    user_factors: DataFrame,
    item_factors: DataFrame,
    k: int = 10,
    limit: int = BROADCAST_LIMIT,
    block_items: int | None = None,
    decimals: int = DECIMALS,
) -> DataFrame:
    """The ``k`` items with the largest dot product for every user, exactly.

    Scores are rounded to ``decimals`` digits and ties go to the smaller item id.
    Rows: user_id, movie_id, score, rank.

    Item factors whose measured size is within ``limit`` are broadcast and
    users are scored where they are.  Beyond it items are sorted to blocks of
    neighbours around pivots, as large as a task can hold.  A user visits the block with
    the largest bound first, and then only those whose bound of norms and angles reaches
    the k-th score found there; inside a block pieces of it are skipped by the same bounds.
    Scores or what is best of them are stored, so reading the result twice does not score twice.
    """
    return _best_items(user_factors, _placed_items(item_factors, limit, block_items), k, decimals)


def top_k_unseen(
    user_factors: DataFrame,
    item_factors: DataFrame,
    k: int,
    seen: DataFrame,
    limit: int = BROADCAST_LIMIT,
    block_items: int | None = None,
) -> DataFrame:
    """The ``k`` best items of every user that are not among the user's pairs in ``seen``.

    ``seen`` is (user_id, movie_id).  Exact: a user with n such pairs of items that there are
    asks for at least the k + n best items, of which at most n fall away.  Users are scored
    by classes whose lengths are k, 2k, 4k, ... so all lists together have at most 2k rows a
    user and two for each pair of ``seen``.
    """
    there = item_factors.select(F.col("id").alias("movie_id"))
    asked = user_factors.select(F.col("id").alias("user_id"))
    # Pairs of others' or of items that are not searched take nothing from a list.
    pairs = seen.select("user_id", "movie_id")
    for key, rows in (("user_id", asked), ("movie_id", there)):
        pairs = materialise(lookup_join(pairs, rows.distinct(), key, "left_semi", computed=True), "seen")
    pairs = materialise(pairs.distinct(), "seen")
    known = pairs.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    need = (F.coalesce("n", F.lit(0)) + k) / k
    step = F.ceil(F.round(F.log2(need), 9)).cast("int")
    users = lookup_join(user_factors, known, "id", "left", computed=True)
    users = materialise(users.withColumn("step", step).drop("n"), "askers")
    n_items = item_factors.count()
    placed = _placed_items(item_factors, limit, block_items)
    lists = None
    # One class per doubling: as many as the longest list of pairs has binary digits.
    for row in users.select("step").distinct().orderBy("step").collect():
        asking = users.filter(F.col("step") == row["step"]).drop("step")
        length = max(1, min(k << row["step"], n_items))
        found = _best_items(asking, placed, length, DECIMALS).drop("rank")
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        return _best_items(user_factors, placed, k, DECIMALS)
    unseen = lookup_join(lists, pairs, ["user_id", "movie_id"], "left_anti", computed=True)
    return top_k(unseen, k, "user_id", "score", "movie_id")


def recommendation_lists(ranked: DataFrame) -> DataFrame:
    """One row per user: recommendations array<struct<movie_id int, rating float>>."""
    entries = ranked.select(
        "user_id",
        "rank",
        F.col("movie_id").cast("int").alias("movie_id"),
        F.col("score").cast("float").alias("rating"),
    )
    return as_ranked_list(entries, "user_id", ["movie_id", "rating"], "recommendations")


def nearest_vectors(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "dot"
) -> DataFrame:
    """Exact ``k`` nearest vectors under dot, cosine or l2, as a dot-product search.

    Cosine divides by the norms.  For l2, ``2 u.v - |v|^2`` falls as the distance
    grows, so appending one coordinate to each side gives the same ranking.
    Rows: user_id, movie_id, score (or distance for l2), rank.
    """
    if metric == "dot":
        return top_k_items(queries, vectors, k)
    features = F.col("features")
    if metric == "cosine":

        def unit(df: DataFrame) -> DataFrame:
            length = norm(features)
            return df.filter(length > 0).select(
                "id", F.transform(features, lambda v: v.cast("double") / length).alias("features")
            )

        return top_k_items(unit(queries), unit(vectors), k)
    if metric != "l2":
        raise ValueError("metric is dot, cosine or l2")
    doubled = queries.select(
        "id",
        F.concat(
            F.transform(features, lambda v: v.cast("double") * 2), F.array(F.lit(-1.0))
        ).alias("features"),
    )
    extended = vectors.select(
        "id",
        F.concat(
            F.transform(features, lambda v: v.cast("double")),
            F.array(norm(features) * norm(features)),
        ).alias("features"),
    )
    # Products decide what can be among the nearest; distances come from the vectors themselves.
    nearest = _best_items(doubled, _placed_items(extended, BROADCAST_LIMIT, None), k, DECIMALS, "l2")
    return nearest.select("user_id", "movie_id", (-F.col("score")).alias("distance"), "rank")
