"""Streams of file events: sessions, what changed together, and re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import text as X
from lodestone.operators import coedit
from lodestone.sources.store import Store, retried

#: Events nearer than this belong to one burst of edits.
GAP = "1500 milliseconds"
LATE = "10 minutes"
EVENTS = "project_id string, path string, op string, ts timestamp"


def file_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Events (add, change, unlink) that arrive as JSON files; of supported files that the watcher doesn't ignore."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder)
    return raw.filter(X.supported(F.col("path"), case_sensitive=True) & ~X.ignored_by_watcher(F.col("path")))


def bursts(events: DataFrame, key: str = "project_id", ts: str = "ts", value: str = "path", gap: str = GAP, late: str = LATE) -> DataFrame:
    """Sessions by event time, each with its distinct values. Later events than the watermark open a session of their own
    no more; in append mode a session is emitted when the watermark passes its end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.collect_set(value).alias("changed"), F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.sort_array("changed").alias("changed"), "n_events")


def coedits(sessions: DataFrame, key: str = "project_id") -> DataFrame:
    """Pair counts of closed sessions (key, start, changed)."""
    rows = sessions.select(F.concat_ws("|", F.col(key).cast("string"), F.unix_micros("start").cast("string")).alias("session_id"), F.explode("changed").alias("file_id"), F.unix_micros("start").alias("seen"))
    return coedit.pairs(rows, F.col("seen"))


def accumulate(sessions: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Adds each batch of closed sessions to the store's co-edit counts. A batch that runs again isn't counted twice: the
    store's last batch is kept with the counts, in one transaction."""

    def step(batch: DataFrame, number: int) -> None:
        with store.transaction():
            done = store.read("projects").filter(F.col("id") == f"stream:{checkpoint}").select("config").first()
            if done and int(done[0]) >= number:
                return
            ids = batch.select("project_id", F.col("start").alias("session_id"), F.explode("changed").alias("file_id"), F.unix_micros("start").alias("seen"))
            new = coedit.pairs(ids, F.col("seen"), ["project_id"])
            old = store.read("file_coedits").withColumn("last_seen", F.unix_micros("last_seen"))
            key = ["project_id", "file_a", "file_b"]
            both = old.select(*key, "count", "last_seen").unionByName(new.select(*key, "count", "last_seen"))
            both = both.groupBy(*key).agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
            mark = batch.sparkSession.range(1).select(F.lit(f"stream:{checkpoint}").alias("id"), F.lit(str(number)).alias("config"))
            store.write("file_coedits", both.select(X.edge_id(*(F.col(k) for k in key)).alias("id"), *key, "count", F.timestamp_micros("last_seen").alias("last_seen")))
            store.upsert("projects", mark, ["id"])

    def add(batch: DataFrame, number: int) -> None:
        retried(lambda: step(batch, number))

    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add).start()


def reindex(sessions: DataFrame, index: Callable[[str, list[str]], object], checkpoint: str) -> StreamingQuery:
    """Calls index(project_id, paths) for each closed session; a session's paths are few."""

    def run(batch: DataFrame, number: int) -> None:
        for row in batch.orderBy("start").toLocalIterator():
            index(row["project_id"], row["changed"])

    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()
