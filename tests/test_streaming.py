import datetime as dt
import json

from lodestone.sources.store import Store
from lodestone.streaming import watch

START = dt.datetime(2024, 1, 1)


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"project_id": "p", "path": p, "op": "change", "ts": (START + dt.timedelta(seconds=s)).isoformat()}) for s, p in events))


def run(query):
    query.processAllAvailable()
    query.stop()


def test_bursts_accumulate_once(spark, tmp_path):
    store, events = Store(spark, str(tmp_path / "store")), tmp_path / "events"
    put(events, "1.json", [(0, "a.py"), (1, "b.py"), (2.4, "a.py"), (2.5, "x.md"), (2.6, "dist/c.py"), (10, "a.py"), (11, "c.py")])
    checkpoint = str(tmp_path / "checkpoint")
    start = lambda: watch.accumulate(watch.bursts(watch.file_events(spark, str(events)), late="0 seconds"), store, checkpoint)
    run(start())
    put(events, "2.json", [(100, "z.py")])
    run(start())
    put(events, "3.json", [(200, "z.py")])
    run(start())
    got = {(r.file_a, r.file_b): r["count"] for r in store.read("file_coedits").collect()}
    assert got == {("a.py", "b.py"): 1, ("a.py", "c.py"): 1}


def test_reindex_sees_each_burst(spark, tmp_path):
    seen, events = [], tmp_path / "events"
    put(events, "1.json", [(0, "a.py"), (1, "b.py"), (100, "c.py"), (300, "d.py")])
    bursts = watch.bursts(watch.file_events(spark, str(events)), late="0 seconds")
    run(watch.reindex(bursts, lambda project, paths: seen.append((project, sorted(paths))), str(tmp_path / "checkpoint")))
    assert seen[:2] == [("p", ["a.py", "b.py"]), ("p", ["c.py"])]


def test_stream_and_batch_agree(spark):
    from lodestone.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id", "event_type", "cast(ts as timestamp) ts")
    from pyspark.sql import functions as F

    from lodestone.operators import coedit

    sessions = coedit.edit_sessions(batch, "user_id", "ts", "30 minutes", "event_type").select(F.concat_ws("|", "user_id", "first_ts").alias("session_id"), F.explode("changed").alias("file_id"))
    expected = {(r.file_a, r.file_b): r["count"] for r in coedit.pairs(sessions).collect()}
    assert {(r.file_a, r.file_b): r["count"] for r in QUERIES["streaming_coedit"](spark, folder).collect()} == expected
