"""Pauses of a stream of saved files: state, timers and restarts."""

import json
import time

from loomgraph.streaming import watch

QUIET = 4000


def until(done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)


def source(spark, folder):
    return spark.readStream.schema("path string, note string").json(str(folder))


def save(folder, number, *paths):
    """One file of events, moved in whole."""
    made = folder.parent / f"{number}.tmp"
    made.write_text("".join(json.dumps({"path": p, "note": "x"}) + "\n" for p in paths))
    made.rename(folder / f"{number}.json")


def test_a_burst_is_one_batch_also_after_a_restart(spark, tmp_path):
    folder, checkpoint = tmp_path / "events", str(tmp_path / "checkpoint")
    folder.mkdir()
    batches = []

    def apply(paths, structural):
        batches.append((sorted(r.path for r in paths.collect()), structural))

    query = watch.watch(source(spark, folder), apply, checkpoint, "/repo/.store", quiet=QUIET)
    try:
        for k in range(5):  # a burst of a second
            save(folder, k, f"/repo/B{k}.cs", "/repo/a.cs", "/repo/A.cs", "/repo/notes.md", None)
            time.sleep(0.25)
        until(lambda: batches)
        time.sleep(2)
        assert batches == [(["/repo/A.cs", *(f"/repo/B{k}.cs" for k in range(5))], False)]
        save(folder, 10, "/repo/Late.cs")
        before = len([p for p in query.recentProgress if p.numInputRows])
        until(lambda: len([p for p in query.recentProgress if p.numInputRows]) > before, 30)
    finally:
        query.stop()
    assert len(batches) == 1  # stopped before the pause was over
    query = watch.watch(source(spark, folder), apply, checkpoint, "/repo/.store", quiet=QUIET)
    try:
        save(folder, 11, "/repo/X.csproj")
        until(lambda: len(batches) > 1 and any("/repo/Late.cs" in b[0] for b in batches))
        time.sleep(1)
    finally:
        query.stop()
    assert [p for b in batches[1:] for p in b[0]].count("/repo/Late.cs") == 1
    assert any(structural for _, structural in batches[1:])
    assert query.exception() is None


def test_trees_have_pauses_of_their_own(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    save(folder, 1, "one/x.cs", "two/y.cs", "one/X.cs")
    events = source(spark, folder).selectExpr("split(path, '/')[0] as watched", "path")
    found = []
    writer = watch.bursts(events, 1000).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: found.extend(df.collect()))
    query = writer.trigger(processingTime="300 milliseconds").start()
    try:
        until(lambda: len(found) == 2)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in found) == [("one", "one/X.cs", 2), ("two", "two/y.cs", 1)]
