"""Tables that grow by commits: writers that meet, die and try again."""

import threading

import pytest

from orthoscan.sources import snapshots


def frame(spark, keys):
    return spark.createDataFrame([(k, [float(k), -float(k)], k) for k in keys], "key long, features array<float>, record_id long")


def rows(spark, path, generation=None):
    return sorted((r.record_id, r.key) for r in snapshots.read(spark, path, generation).collect())


def test_appends_go_on_and_generations_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.commits(spark, path).count() == 0
    assert [snapshots.append(spark, path, frame(spark, k), ["key"]) for k in ([5, 3], [], [9, 7, 8])] == [1, 2, 3]
    assert rows(spark, path, 1) == rows(spark, path, 2) == [(0, 3), (1, 5)]
    assert rows(spark, path) == [(0, 3), (1, 5), (2, 7), (3, 8), (4, 9)]
    assert snapshots.read(spark, path).columns == ["record_id", "key", "features"]
    assert [[r.key for r in snapshots.lookup(spark, path, i).collect()] for i in (-1, 0, 1, 2, 4, 5)] == [[], [3], [5], [7], [9], []]
    assert snapshots.lookup(spark, path, 2, generation=2).count() == 0
    plan = snapshots.lookup(spark, path, 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(nth,1)" in plan
    assert "dynamicpruning" in snapshots.read(spark, path, 1)._jdf.queryExecution().executedPlan().toString()


def test_a_writer_that_died_is_not_seen_and_may_try_again(spark, tmp_path, monkeypatch):
    path, claim = str(tmp_path / "t"), snapshots._claim
    snapshots.append(spark, path, frame(spark, [1, 2]), ["key"], "a")

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(snapshots, "_claim", dies)
    with pytest.raises(OSError):
        snapshots.append(spark, path, frame(spark, [3, 4]), ["key"], "b")
    assert rows(spark, path) == [(0, 1), (1, 2)]  # its rows are written, but not committed

    def dies_after(*args):
        assert claim(*args)
        raise OSError("gone before the answer")

    monkeypatch.setattr(snapshots, "_claim", dies_after)
    with pytest.raises(OSError):
        snapshots.append(spark, path, frame(spark, [3, 4]), ["key"], "b")
    monkeypatch.setattr(snapshots, "_claim", claim)
    assert snapshots.append(spark, path, frame(spark, [3, 4]), ["key"], "b") == 2  # it was made
    assert rows(spark, path) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_a_writer_that_was_overtaken_goes_after(spark, tmp_path, monkeypatch):
    path, claim, others = str(tmp_path / "t"), snapshots._claim, []

    def overtaken(spark, path, commit):
        if not others:  # another one commits between this one's look and its claim
            others.append(commit["generation"])
            assert snapshots.append(spark, path, frame(spark, [1, 2, 3]), ["key"], "b") == 1
        return claim(spark, path, commit)

    monkeypatch.setattr(snapshots, "_claim", overtaken)
    assert snapshots.append(spark, path, frame(spark, [8, 9]), ["key"], "a") == 2 and others == [1]
    assert rows(spark, path) == [(0, 1), (1, 2), (2, 3), (3, 8), (4, 9)]


def test_writers_at_once(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    writers = [threading.Thread(target=lambda n=n: made.append(snapshots.append(spark, path, frame(spark, range(10 * n, 10 * n + n)), ["key"], str(n)))) for n in range(1, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = rows(spark, path)
    assert sorted(made) == [1, 2, 3] and [i for i, _ in got] == list(range(6))
    assert sorted(k for _, k in got) == [10, 20, 21, 30, 31, 32]
