from collections import Counter

import pytest

from histria.sources import sinks


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "item long")


def build(new):
    return new.selectExpr("item", "item * 10 AS v")


def stored(spark, folder):
    """How often each key is in the batches that count."""
    _, batches = sinks._batches(spark, folder)
    return Counter(r["item"] for r in spark.read.parquet(*[f"{folder}/{b}/rows" for b in batches]).collect())


@pytest.mark.parametrize("stale", [600.0, -1.0])  # the other waits in vain, or takes the lock over at once
def test_two_writers_at_every_file_operation(spark, tmp_path, monkeypatch, stale):
    at = 0
    while True:
        folder, seen, inside = str(tmp_path / f"c{at}"), [0], [False]

        def step(what, folder=folder, seen=seen, inside=inside, at=at):
            if inside[0]:
                return
            seen[0] += 1
            if seen[0] == at + 1:
                inside[0] = True
                try:
                    sinks.extend_cache(spark, folder, keys(spark, 2, 3), build, wait_seconds=0, stale_seconds=stale)
                except TimeoutError:
                    pass
                finally:
                    inside[0] = False

        monkeypatch.setattr(sinks, "_step", step)
        mine = sinks.extend_cache(spark, folder, keys(spark, 1, 2), build)
        assert sorted(r["v"] for r in mine.collect()) == [10, 20]
        inside[0] = True
        assert sorted(r["v"] for r in sinks.extend_cache(spark, folder, keys(spark, 1, 2, 3), build, wait_seconds=0).collect()) == [10, 20, 30]
        assert stored(spark, folder) == {1: 1, 2: 1, 3: 1}
        if seen[0] < at + 1:
            break
        at += 1
    assert at >= 3


def test_a_broken_list_is_passed_over(spark, tmp_path):
    folder = str(tmp_path / "c")
    sinks.extend_cache(spark, folder, keys(spark, 1), build)
    (tmp_path / "c" / "batches-000000002.json").write_text('["batch-')
    assert sinks.extend_cache(spark, folder, keys(spark, 1, 4), build).count() == 2
    assert stored(spark, folder) == {1: 1, 4: 1}


def test_only_the_owner_releases(spark, tmp_path):
    lock = tmp_path / "w" / "writer.lock"
    with sinks.only_writer(spark, str(tmp_path / "w")), sinks.only_writer(spark, str(tmp_path / "w"), stale_seconds=-1):
        second = lock.read_text()
    assert not lock.exists() and len(second) == 32
    first = sinks.only_writer(spark, str(tmp_path / "w"))
    first.__enter__()
    other = sinks.only_writer(spark, str(tmp_path / "w"), stale_seconds=-1)
    other.__enter__()
    held = lock.read_text()
    first.__exit__(None, None, None)
    assert lock.read_text() == held
    other.__exit__(None, None, None)
    assert not lock.exists()


def test_readers_see_old_or_new_text(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t.json"), []
    sinks.write_text(spark, path, "old")
    monkeypatch.setattr(sinks, "_step", lambda what: seen.append(sinks.read_text(spark, path)))
    sinks.write_text(spark, path, "new")
    assert seen == ["old"] and sinks.read_text(spark, path) == "new"
    assert not [f.name for f in tmp_path.iterdir() if f.name.endswith(".tmp")]
