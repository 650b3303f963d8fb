"""What the corpus operators share: input columns, tables in the shared folder, bounded filters, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import scratch as _shared

#: Slots of the filters that are broadcast: at most this many rows, whatever the input. Each has 64 bits, so that a filter of a
#: million keys still stops 94 rows of 100.
FILTER_SLOTS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Only (key, column), with null as the empty text; other columns, whatever their names, play no part."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[column].cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting has the value for what runs inside, and is as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes of an Arrow batch of the operators' own tables, about; a row that has more is a batch of its own.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows, and of about BATCH_BYTES, for what runs inside. Packed rows have some 100 KB each, and a
    batch is held by the executor's JVM, whose buffers double as they grow, and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with setting(spark, key, str(min(rows, before) if before > 0 else rows)), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        yield


def freed_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is declared and run inside leaves no shuffle files once it has ended. Otherwise they stay until the driver happens to collect
    its garbage, so that the disk holds the shuffles of all steps instead of the largest."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch(_shared.Scratch):
    """Tables of the operators, written in small Arrow batches, and without the shuffles that they came from."""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark), freed_shuffles(self.spark):
            return super().keep(df, name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches, whose bytes Spark bounds, a few rows at a time, as Python's objects take more room than the batch; what
    a task leaves free goes back to the system, as workers live on."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
    release()


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_SLOTS)).cast("int")


def _bit(key: Column) -> Column:
    """One of a slot's 64 bits, by a hash of its own."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit("bit"), key), F.lit(64)).cast("int"))


def _filter(keys: DataFrame, key: str) -> DataFrame:
    """(_slot_of_keys, _bits) of the slots that keys have."""
    own = keys.select(_slot(F.col(key)).alias("_slot_of_keys"), _bit(F.col(key)).alias("_bits"))
    return F.broadcast(own.groupBy("_slot_of_keys").agg(F.bit_or("_bits").alias("_bits")))


_HIT = "_slot_of_row = _slot_of_keys AND (_bit_of_row & _bits) <> 0"


def prefiltered(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of big whose key may be in keys. The broadcast side has FILTER_SLOTS rows at most, so its size
    doesn't follow the data; a full filter only passes more rows to the join that must come after."""
    return parted(big, F.col(key), keys, key)[1]


def parted(rows: DataFrame, by: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose value of by certainly isn't in keys, the others): the first need no shuffle to pass a join with keys."""
    slots, marked = _filter(keys, key), rows.withColumns({"_slot_of_row": _slot(by), "_bit_of_row": _bit(by)})
    sure, open_ = (marked.join(slots, F.expr(_HIT), how) for how in ("left_anti", "left_semi"))
    return sure.drop("_slot_of_row", "_bit_of_row"), open_.drop("_slot_of_row", "_bit_of_row")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def release() -> None:
    """Gives the memory that a task's arrays have freed back to the system, as workers live on with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"position%d" % i) | 1 for i in range(64)], dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Nothing is remembered: texts have more words than a dictionary of bounded size holds."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of so many words; of all words if there are fewer; none without words."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    n = len(hashes) - width_here + 1
    total = np.full(n, width_here, dtype=np.uint64)
    for i in range(width_here):
        total += hashes[i : i + n] * _MULTIPLIERS[i]
    return mixed(total)


#: Counters that travel together.
CHUNK = 1 << 12


#: Counters are mostly small, in bytes of few bits each: fit for a code by their frequencies, which lz4 and snappy lack.
_ZSTD = pa.Codec("zstd")
_SIZE = 4


def packed(counts: np.ndarray) -> bytes:
    """A chunk of counters, as narrow as its largest, with their places where few aren't 0; compressed, after its size."""
    blob = _narrowed(counts)
    return len(blob).to_bytes(_SIZE, "little") + _ZSTD.compress(blob, asbytes=True)


def _narrowed(counts: np.ndarray) -> bytes:
    wide = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << 8 * w)
    at = np.flatnonzero(counts)
    if len(at) * (2 + wide) < CHUNK * wide:
        return bytes([16 + wide]) + at.astype("<u2").tobytes() + counts[at].astype(f"<u{wide}").tobytes()
    return bytes([wide]) + counts.astype(f"<u{wide}").tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    blob = _ZSTD.decompress(blob[_SIZE:], int.from_bytes(blob[:_SIZE], "little"), asbytes=True)
    wide = blob[0] & 15
    if blob[0] < 16:
        return slice(None), np.frombuffer(blob, f"<u{wide}", offset=1)
    n = (len(blob) - 1) // (2 + wide)
    return np.frombuffer(blob, "<u2", n, 1), np.frombuffer(blob, f"<u{wide}", n, 1 + 2 * n)


def packed_chunks(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The numbers and packed counters of the chunks that aren't 0 everywhere; as many counters as whole chunks have."""
    chunks = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1)).tolist()
    return chunks, [packed(counts[c * CHUNK : (c + 1) * CHUNK]) for c in chunks]


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, n = unpacked(blob)
            total.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))[at] += n.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(x) for x in total.values()], pa.binary())], ["chunk", "counts"])


def summed(chunks: DataFrame, size: int, kind: type = np.int64) -> np.ndarray:
    """The sums of packed counters (chunk, counts) over the cluster, as one array of the given size; of a kind that they may
    exceed, its highest number. They come in one job, packed as well: an iteration over partitions would take a job for each."""
    out = np.zeros(size, dtype=kind)
    with freed_shuffles(chunks.sparkSession):
        found = chunks.repartition(partitions(chunks.sparkSession), "chunk").mapInArrow(_chunk_sums, "chunk int, counts binary").toArrow()
    for batch in found.to_batches():
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, n = unpacked(blob.as_py())
            out[chunk * CHUNK : (chunk + 1) * CHUNK][at] = np.minimum(n.astype(np.uint64), np.uint64(np.iinfo(kind).max))
    return out
