"""Copies in slices, metrics of runs, unseen films, written folds."""

import random

import pytest

from cinerank.operators import factors
from cinerank.plans.folds import export_split, read_fold, read_holdout, write_folds, write_holdout
from cinerank.plans.training import train
from cinerank.session import scratch_path
from cinerank.sinks import copied_table, copy_into, read_metrics, refused_rows
from cinerank.sinks import copies
from cinerank.sinks.snapshots import commit, current
from tests.conftest import rows

KIND = "k string, v long, text string"
REFUSED = "k string, v long, held_version long"


def merged(held, new):
    """By dictionaries: the table after the copy and what was refused."""
    newest = {}
    for k, v, text in sorted(new, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2] or "")):
        newest.setdefault(k, (v, text))
    table, refused = dict(held), []
    for k, (v, text) in newest.items():
        old = table.get(k)
        if old is None or (v is not None and (old[0] is None or v > old[0])):
            table[k] = (v, text)
        else:
            refused.append((k, v, old[0]))
    return table, refused


def some_rows(seed, n):
    draw = random.Random(seed)
    keys = [None, "", *map(str, range(60))]
    return [(draw.choice(keys), draw.choice([None, *range(5)]), f"{seed}-{i}") for i in range(n)]


def held_at(spark, path):
    return {r["k"]: (r["v"], r["text"]) for r in copied_table(spark, path, KIND).collect()}


def test_copies_equal_dictionaries(spark):
    path, table = scratch_path(spark, "copies"), {}
    for seed in range(2):
        new = some_rows(seed, 80 - 40 * seed)
        report = copy_into(spark.createDataFrame(new, KIND).repartition(3), path, "k", "v", f"job-{seed}", 2)
        table, refused = merged(table, new)
        assert held_at(spark, path) == table
        assert rows(refused_rows(spark, path, f"job-{seed}", REFUSED)) == sorted(refused, key=repr)
        written, turned_away = report.groupBy().sum("written", "refused").first()
        assert written + turned_away == len({r[0] for r in new}) and turned_away == len(refused)
    assert current(spark, path).version == 2


def test_a_stopped_copy_goes_on(spark, monkeypatch):
    path = scratch_path(spark, "copies")
    first = some_rows(7, 60)
    copy_into(spark.createDataFrame(first, KIND), path, "k", "v", "first", 4)
    table, _ = merged({}, first)
    new = some_rows(8, 60)
    frame = spark.createDataFrame(new, KIND)
    assert copy_into(frame, path, "k", "v", "second", 4, at_most=1).count() == 1
    assert held_at(spark, path) == table

    # The next slice fails between its merge and its row of progress.
    plain, calls = copies._append, []

    def failing(*arguments):
        calls.append(arguments)
        if len(calls) == 2:
            raise OSError("lost")
        plain(*arguments)

    monkeypatch.setattr(copies, "_append", failing)
    with pytest.raises(OSError):
        copy_into(frame, path, "k", "v", "second", 4)
    monkeypatch.undo()
    assert held_at(spark, path) == table and current(spark, path).version == 1

    # Taken up with what was staged, not with what the source is by now.
    done = copy_into(frame.limit(0), path, "k", "v", "second", 4)
    table, refused = merged(table, new)
    assert sorted(r["slice"] for r in done.collect()) == [0, 1, 2, 3]
    assert held_at(spark, path) == table
    assert rows(refused_rows(spark, path, "second", REFUSED)) == sorted(refused, key=repr)
    again = current(spark, path)
    copy_into(frame, path, "k", "v", "second", 4)
    assert current(spark, path) == again and again.version == 2


def test_slices_without_rows_keep_their_parts(spark):
    path = scratch_path(spark, "copies")
    copy_into(spark.createDataFrame(some_rows(1, 60), KIND), path, "k", "v", "a", 4)
    before = current(spark, path).parts
    copy_into(spark.createDataFrame([("5", 9, "new")], KIND), path, "k", "v", "b", 4)
    assert len(set(before) & set(current(spark, path).parts)) == 3
    copy_into(spark.createDataFrame([], KIND), path, "k", "v", "c", 4)
    assert held_at(spark, path)["5"] == (9, "new")
    with pytest.raises(ValueError):
        copy_into(spark.createDataFrame([], KIND), path, "k", "v", "d", 5)


def test_a_copy_overtaken_is_not_committed(spark):
    path = scratch_path(spark, "copies")
    frame = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], KIND)
    copy_into(frame, path, "k", "v", "slow", 2, at_most=1)
    other = commit(spark, path, current(spark, path), ["parts/other-0", "parts/other-1"])
    with pytest.raises(RuntimeError):
        copy_into(frame, path, "k", "v", "slow", 2)
    assert current(spark, path) == other


def test_runs_keep_their_metrics(spark):
    ratings = [(u, f, float(1 + (u + f) % 5)) for u in range(30) for f in range(12)]
    frame = spark.createDataFrame(ratings, "user_id int, movie_id int, rating double")
    path = scratch_path(spark, "runs")
    for run in ("one", "two"):
        row = train(frame, f"{path}/model-{run}", run, seed=3, metrics_path=f"{path}/metrics", rank=3, max_iter=2)
        assert row.first()["run_id"] == run
    kept = rows(read_metrics(spark, f"{path}/metrics"), "run_id", "rank", "seed", "n_pairs")
    assert [r[0] for r in kept] == ["one", "two"] and kept[0][1:] == kept[1][1:]


@pytest.mark.parametrize("limit", [1 << 30, 1])
def test_unseen_items_equal_every_pair(spark, limit):
    draw = random.Random(5)
    users = [(u, [draw.gauss(0, 1) for _ in range(4)]) for u in range(12)]
    items = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    # From no item to all of them, with repeats and with items that no one knows.
    seen = [(u, i) for u, n in enumerate([0, 0, 1, 3, 4, 9, 20, 37, 39, 40, 40, 2]) for i in draw.sample(range(40), n)]
    seen += seen[:5] + [(2, 999), (999, 1)]
    kind = "id int, features array<double>"
    found = factors.top_k_unseen(
        spark.createDataFrame(users, kind), spark.createDataFrame(items, kind), 3,
        spark.createDataFrame(seen, "user_id int, movie_id int"), limit, block_items=7,
    )
    expected = []
    for u, x in users:
        scored = [(-round(sum(a * b for a, b in zip(x, y)), 6), i) for i, y in items if (u, i) not in seen]
        expected += [(u, i, at) for at, (_, i) in enumerate(sorted(scored)[:3], 1)]
    assert rows(found, "user_id", "movie_id", "rank") == sorted(expected, key=repr)
    none = spark.createDataFrame([], "user_id int, movie_id int")
    nobody = factors.top_k_unseen(spark.createDataFrame([], kind), spark.createDataFrame(items, kind), 3, none, limit)
    assert nobody.count() == 0


def test_folds_are_written_once_and_sorted(spark):
    table = [(i % 7, (i * 37) % 50, i % 5, i) for i in range(103)]
    frame = spark.createDataFrame(table, "user_id int, movie_id int, rating int, seq int").repartition(4)
    path = scratch_path(spark, "folds")
    write_folds(frame, path, 5, "seq")
    assert spark.read.parquet(path).count() == 103
    tests = []
    for i in range(1, 6):
        base, test = read_fold(spark, path, i, frame.schema)
        held = rows(test, "seq")
        tests.append(len(held))
        assert len(set(rows(base, "seq"))) + len(held) == 103
        assert [r[0] for r in sorted(held)] == list(range(min(held)[0], max(held)[0] + 1))
    assert tests == [21, 21, 21, 20, 20]
    plan = read_fold(spark, path, 2, frame.schema)[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan

    write_holdout(frame, f"{path}-ua", 2, "user_id", "seq")
    base, test = read_holdout(spark, f"{path}-ua", frame.schema)
    assert rows(test, "seq") == sorted(((i,) for i in range(14)), key=repr) and base.count() == 89
    export_split(base, test, f"{path}-files", "ua")
    lines = [tuple(map(int, r["value"].split("\t"))) for r in spark.read.text(f"{path}-files/ua.base").collect()]
    assert sorted(lines) == sorted(t for t in table if t[3] >= 14)
