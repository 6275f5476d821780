"""A stream of changes: late and repeated events, files saved many times in a row, batches that run again."""

import json
import time
from types import SimpleNamespace as N

import pytest
from pyspark.sql import Row

from corpusloom.plans.index import Indexer
from corpusloom.sources.store import SnapshotStore
from corpusloom.streaming.reindex import Applied, Changes, due_paths, reindex_stream

EVENTS = "path string, at timestamp, digest string"


class Handle:
    """State and timers of one key, as Spark keeps them."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return N(get=lambda: self.value, exists=lambda: self.value is not None, update=lambda v: setattr(self, "value", v))

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def steps(quiet_ms, *batches):
    """What batches (now, events) of one path make due; a batch without events lets timers go off."""
    p, h, out = Changes(quiet_ms), Handle(), []
    p.init(h)
    for now, events in batches:
        clock = N(getCurrentProcessingTimeInMs=lambda now=now: now)
        due = [t for t in h.timers if t <= now]
        for t in due:
            h.timers.remove(t)
            out += [(now, r["version"]) for r in p.handleExpiredTimer(("x",), clock, None)]
        if events:
            out += [(now, r["version"]) for r in p.handleInputRows(("x",), iter([Row(at=a, digest=d) for a, d in events]), clock)]
    return out


def test_late_and_repeated_events_change_nothing():
    assert steps(0, (1, [(10, "a")]), (2, [(9, "z")]), (3, [(10, "a")]), (4, [(11, "a")]), (5, [(12, "b")]), (6, [(11, "c")])) == [(1, 1), (5, 2)]
    # Without a digest every newer event is a change; without a moment it is newer than all.
    assert steps(0, (1, [(10, None)]), (2, [(10, None)]), (3, [(11, None)]), (4, [(None, None)]), (5, [(None, None)])) == [(1, 1), (3, 2), (4, 3), (5, 4)]
    assert steps(0, (1, [(12, "c"), (10, "a"), (11, "b")]), (2, [(11, "b")])) == [(1, 3)]


def test_a_path_is_due_when_it_has_been_quiet():
    assert steps(100, (0, [(1, "a")]), (60, [(2, "b")]), (110, None), (130, [(3, "c")]), (229, None), (230, None), (500, None)) == [(230, 3)]
    # It changes, and is as before in the end.
    assert steps(100, (0, [(1, "a")]), (100, None), (200, [(2, "b")]), (250, [(3, "a")]), (400, None)) == [(100, 1)]
    assert steps(100, (0, [(1, None)]), (100, None), (200, [(2, None)]), (300, None)) == [(100, 1), (300, 2)]


def write(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def due(spark, folder, checkpoint, **options):
    got = []
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    query = due_paths(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).foreachBatch(lambda b, _: got.extend((r["path"], r["version"]) for r in b.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(got)


def test_state_survives_a_restart(spark, tmp_path):
    at = "2024-01-01T00:00:{:02d}Z".format
    folder, checkpoint = tmp_path / "events", tmp_path / "c"
    write(folder, 0, [{"path": "a/./x.cpp", "at": at(5), "digest": "1"}, {"path": "b.cpp", "at": at(5), "digest": "1"}, {"path": None}])
    assert due(spark, folder, checkpoint) == [("a/x.cpp", 1), ("b.cpp", 1)]
    write(folder, 1, [{"path": "a/x.cpp", "at": at(5), "digest": "1"}, {"path": "b.cpp", "at": at(4), "digest": "0"}, {"path": "c.cpp", "digest": "1"}])
    assert due(spark, folder, checkpoint) == [("c.cpp", 1)]
    write(folder, 2, [{"path": "a/x.cpp", "at": at(6), "digest": "2"}, {"path": "c.cpp", "digest": "1"}])
    assert due(spark, folder, checkpoint) == [("a/x.cpp", 2)]
    assert due(spark, folder, checkpoint) == []


@pytest.fixture
def indexer(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/f.cpp").write_text("int f() { return 0; }\n")
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "tree"))
    indexer.index()
    return indexer


def names(indexer):
    return sorted(r[0] for r in indexer.store.read()["symbols"].select("qualified_name").collect())


def test_a_replayed_batch_is_passed_over(spark, tmp_path, indexer):
    (tmp_path / "tree/_g.cpp").write_text("int g() { return f(); }\n")
    write(tmp_path / "events", 0, [{"path": "_g.cpp"}, {"path": "gone.cpp"}])
    run = lambda checkpoint: reindex_stream(spark.readStream.schema(EVENTS).json(str(tmp_path / "events")), indexer, str(tmp_path / checkpoint)).awaitTermination()
    run("c")
    assert names(indexer) == ["f", "g"] and indexer.store.version() == 2 and Applied(spark, str(tmp_path / "c-applied")).last() == 0
    run("c")
    assert indexer.store.version() == 2
    # The checkpoint is lost, the note isn't: the batch comes again and is passed over.
    (tmp_path / "c-applied").rename(tmp_path / "d-applied")
    run("d")
    assert indexer.store.version() == 2
    # Both are lost: the same files give the same rows.
    run("e")
    assert indexer.store.version() == 3 and names(indexer) == ["f", "g"]


def test_a_file_saved_again_and_again_is_read_once(spark, tmp_path, indexer):
    with pytest.raises(ValueError):
        reindex_stream(spark.readStream.schema(EVENTS).json(str(tmp_path)), indexer, str(tmp_path / "c"), quiet=1.0)
    events = tmp_path / "events"
    events.mkdir()
    stream = spark.readStream.schema(EVENTS).json(str(events))
    query = reindex_stream(stream, indexer, str(tmp_path / "c"), quiet=4.0, interval="1 second")
    try:
        for k in range(4):
            (tmp_path / "tree/f.cpp").write_text(f"int f() {{ return {k}; }}\nint h{k}() {{ return 1; }}\n")
            write(events, k, [{"path": "f.cpp", "digest": str(k)}])
            time.sleep(0.5)
        until = time.time() + 90
        while indexer.store.version() < 2 and time.time() < until and query.isActive:
            time.sleep(0.5)
        time.sleep(3)
    finally:
        query.stop()
    assert query.exception() is None
    assert names(indexer) == ["f", "h3"] and indexer.store.version() == 2
