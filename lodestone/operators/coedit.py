"""Files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Files of a session that one task pairs with as many others. A mass change (a checkout, say) has more, and its pairs are
#: made block by block over the cluster; it counts as one session like any other.
BLOCK = 500


def pairs(sessions: DataFrame, seen: Column | None = None, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(file_a, file_b, count, last_seen): in how many sessions (session_id, file_id) both files of a pair changed; with by,
    sessions and pairs belong to these columns' values.

    A session is a short burst of edits; its distinct files are gathered and its pairs made in place, so the join of the
    sessions with themselves needs no second shuffle. The files of a larger session are cut into blocks, and the pairs of
    blocks spread over the tasks."""
    seen, by = F.lit(0).cast("long") if seen is None else seen, by or []
    grouped = sessions.groupBy(*by, "session_id").agg(F.sort_array(F.collect_set("file_id")).alias("files"), F.max(seen).alias("seen")).filter(F.size("files") > 1)
    first = grouped.filter(F.size("files") <= block).select(*by, "files", "seen", F.posexplode("files").alias("i", "file_a"))
    few = first.select(*by, "file_a", "seen", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("file_b"))
    last = F.floor((F.size("files") - 1) / block).cast("int")
    blocks = grouped.filter(F.size("files") > block).select(*by, "files", "seen", F.explode(F.sequence(F.lit(0), last)).alias("m"), last.alias("last"))
    blocks = blocks.select(*by, "seen", "m", F.expr(f"slice(files, m * {block} + 1, {block})").alias("own"), "files", F.explode(F.sequence("m", "last")).alias("n"))
    blocks = blocks.select(*by, "seen", "m", "n", "own", F.expr(f"slice(files, n * {block} + 1, {block})").alias("other")).repartition(F.xxhash64("own", "other"))
    one = blocks.select(*by, "seen", "other", F.explode("own").alias("file_a")).select(*by, "file_a", "seen", F.explode("other").alias("file_b"))
    both = few.unionByName(one.filter("file_a < file_b"))
    return both.groupBy(*by, "file_a", "file_b").agg(F.count("*").alias("count"), F.max("seen").alias("last_seen"))


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added to stored counts."""
    columns = ["file_a", "file_b", "count", "last_seen"]
    return stored.select(columns).unionByName(new.select(columns)).groupBy("file_a", "file_b").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def scores(counts: DataFrame, active, candidates: DataFrame) -> DataFrame:
    """(path, score) of every candidate path: its count with the active file over the largest count that the active file
    has with any file; 0 for others. If the active file has no partner, no rows at all."""
    own = counts.filter((F.col("file_a") == active) | (F.col("file_b") == active))
    partner = own.select(F.when(F.col("file_a") == active, F.col("file_b")).otherwise(F.col("file_a")).alias("path"), "count")
    most = F.broadcast(partner.agg(F.max("count").alias("most"))).filter("most IS NOT NULL")
    joined = candidates.select("path").distinct().join(partner, "path", "left").join(most)
    return joined.select("path", F.coalesce(F.col("count") / F.col("most"), F.lit(0.0)).alias("score"))


def edit_sessions(events: DataFrame, key: str, ts: str, gap: str, value: str) -> DataFrame:
    """Sessions of a key: events no further apart than gap; start, end, events and distinct values."""
    window = F.session_window(F.col(ts), gap)
    grouped = events.groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("n_events"), F.sort_array(F.collect_set(value)).alias("changed"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return grouped.drop("w")


def session_ids(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Each event with its session's number within its key."""
    w = Window.partitionBy(key).orderBy(ts)
    fresh = F.coalesce((F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > int(gap_seconds * 1e6)).cast("int"), F.lit(1))
    return events.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w)).drop("_new")
