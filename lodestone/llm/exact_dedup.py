"""Exact deduplication by a log-structured merge index (operator 3), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, lower_ascii, parted, partitions, prefiltered, texts


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


class DigestIndex:
    """Sorted runs of (digest, keep_id, n) in the shared folder.

    A memtable is the slice of the input that hashes to one run number; flush() writes each as a run sorted by digest,
    with a Bloom filter of the digests in every Parquet row group. compact() merges fan_in runs into one, level by level,
    and keeps the smallest identifier under the chosen order (the largest doc_id is the smallest of the descending order).
    Slices of one digest are summed run by run, so that a digest with a third of all rows never meets in one task.

    The filters serve lookup(), of a digest in an index that stays: Parquet asks them before it reads a row group. The join
    that marks all documents reads every row anyway, and needs none."""

    def __init__(self, scratch: Scratch, keep: str = "largest", fan_in: int = 16):
        self.scratch, self.fan_in, self.levels = scratch, fan_in, []
        self.keep = {"largest": F.max, "smallest": F.min}[keep]

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.scratch.root}/{name}"
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.per_file)}
        rows.sortWithinPartitions("run", "digest").write.options(**filters).mode("overwrite").parquet(path)
        return self.scratch.spark.read.schema(rows.schema).parquet(path)

    def flush(self, keys: DataFrame, memtables: int) -> DataFrame:
        """keys: doc_id, digest, run. Their number sizes the filters of the files."""
        self.runs, self.per_file = memtables, max(256, keys.count() // partitions(self.scratch.spark))
        first = keys.groupBy("run", "digest").agg(self.keep("doc_id").alias("keep_id"), F.count("*").alias("n"))
        self.levels = [self._write(first, "level0")]
        return self.levels[0]

    def compact(self) -> DataFrame:
        """The last level: one run, one row for each digest."""
        runs = self.runs
        while runs > 1:
            runs = -(-runs // self.fan_in)
            merged = self.levels[-1].groupBy((F.col("run") / self.fan_in).cast("int").alias("run") if runs > 1 else F.lit(0).alias("run"), "digest").agg(self.keep("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            self.levels.append(self._write(merged, f"level{len(self.levels)}"))
            if len(self.levels) > 2:
                self.scratch.drop(f"level{len(self.levels) - 2}")
        return self.levels[-1]

    def lookup(self, digest: bytes) -> DataFrame:
        """The rows of the last level with this digest: one, or none."""
        return self.levels[-1].filter(F.col("digest") == F.lit(bytearray(digest)))


def exact_duplicates(docs: DataFrame, keep: str = "largest", memtables: int | None = None, digest_bytes: int = 32) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256 (hex, of the normalised text).

    Texts are equal if they are after lower-casing A-Z only; null counts as the empty text. Of equal texts the row with the
    largest (or smallest) doc_id stays. A null doc_id stays only if no row of its text has an id. Rows that repeat an id
    and its text count in group_size each and share one verdict. An empty table gives no rows; other columns play no part.

    Digests that several rows share are verified byte by byte: their texts are grouped by the whole text, on the map side
    first. If one digest has two texts (tests shorten digests for that), its rows are grouped by text instead."""
    spark = docs.sparkSession
    memtables = memtables or partitions(spark)
    scratch = Scratch(spark, "exact")
    sha = text_digest(F.col("text"))
    digest = F.substring(F.col("sha"), 1, digest_bytes)
    named = texts(docs)
    keys = scratch.keep(named.select("doc_id", sha.alias("sha"), F.pmod(F.xxhash64("doc_id", sha), F.lit(memtables)).cast("int").alias("run")), "keys").withColumn("digest", digest)

    index = DigestIndex(scratch, keep)
    first = index.flush(keys.select("doc_id", "digest", "run"), memtables)
    hits = index.compact().filter("n > 1").select("digest", "keep_id", "n")

    normal = named.select("doc_id", sha.alias("sha"), lower_ascii(F.col("text")).alias("text")).withColumn("digest", digest).drop("sha")
    verified = prefiltered(normal.select("digest", "text"), hits, "digest").groupBy("digest", "text").agg(F.count("*").alias("copies"))
    clashes = scratch.keep(verified.groupBy("digest").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("digest"), "clashes")

    by_run = first.select("run", "digest").join(hits, "digest")
    merged = keys.join(by_run, ["run", "digest"], "left")
    found = merged.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), "digest")
    if not clashes.isEmpty():
        rows = normal.join(clashes, "digest", "left_semi")
        classes = rows.groupBy("digest", "text").agg(index.keep("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        exact = rows.join(classes, ["digest", "text"]).select("doc_id", "keep_id", "group_size", F.lower(F.hex(text_digest(F.col("text")))).alias("text_sha256"), "digest")
        found = found.join(clashes, "digest", "left_anti").unionByName(exact)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and its text, one. Rows whose id is
    surely neither dropped nor repeated pass without a shuffle. Null texts count as empty, null ids are as in exact_duplicates;
    an empty table stays empty; columns of any names but those that begin with _row_ pass."""
    verdicts = Scratch(docs.sparkSession, "verdicts").keep(exact_duplicates(docs, keep), "verdicts")
    rows = verdicts.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("text_sha256").alias("_sha"), F.col("kept").alias("_kept")).agg(F.count("*").alias("_n"))
    touched = rows.filter("NOT _kept OR _n > 1 OR _null")
    named = docs.withColumns({"_row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), "_row_null": F.col("doc_id").isNull()})
    sure, open_ = parted(named, F.col("_row_id"), touched, "_id")
    open_ = open_.withColumn("_row_sha", F.lower(F.hex(text_digest(F.coalesce(F.col("text").cast("string"), F.lit(""))))))
    gone = touched.filter("NOT _kept").select("_id", "_null", "_sha")
    same = (F.col("_row_id") == F.col("_id")) & (F.col("_row_null") == F.col("_null")) & (F.col("_row_sha") == F.col("_sha"))
    first = F.row_number().over(Window.partitionBy("_row_id", "_row_null", "_row_sha").orderBy(F.lit(0)))
    left = open_.join(gone, same, "left_anti").withColumn("_first", first).filter("_first = 1")
    return sure.select(docs.columns).unionByName(left.select(docs.columns))
