"""Tables as Parquet snapshots: a write makes a new version, and a numbered pointer file switches to it."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.schema import TABLES


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last row of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return rows.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which replace those of the same keys. new has one row for each key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True).select(old.columns)


def without(rows: DataFrame, gone: DataFrame, **on: str) -> DataFrame:
    """rows but for those whose column (a keyword) is among a column of gone (its value)."""
    for column, other in on.items():
        rows = rows.join(gone.select(F.col(other).alias("_gone")).distinct(), F.col(column) == F.col("_gone"), "left_anti")
    return rows


def cascade(files_gone: DataFrame, chunks: DataFrame, embeddings: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of chunks, embeddings and edges when files (column file_id) go."""
    chunks_gone = chunks.join(files_gone.select("file_id").distinct(), "file_id", "left_semi").select("chunk_id")
    return without(chunks, files_gone, file_id="file_id"), without(embeddings, chunks_gone, chunk_id="chunk_id"), without(edges, chunks_gone, from_chunk="chunk_id", to_chunk="chunk_id")


class Conflict(RuntimeError):
    """Another writer was first. What this one wrote has no effect; it may read again and retry."""


class Store:
    """Tables below one folder, in any file system that Spark writes to.

    A version of a table is a list of folders: replacing it starts a new list, appending adds one to it, and long lists are
    merged. A transaction writes new folders and then makes one small pointer file with the next number, which fails if that
    is there already: readers see all of its tables or none, and of two writers that began at one number the second gets a
    Conflict. A failed one leaves folders that nothing points to."""

    #: Appended folders from which a table is written as one again.
    MERGE = 32

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._pending: dict[str, list[str]] | None = None
        self._base = 0

    def _number(self) -> int:
        """The last pointer's; 0 before the first."""
        names = (status.getPath().getName() for status in self._fs.listStatus(self._path(self.root)))
        return max((int(n.removeprefix("_v")) for n in names if n.startswith("_v")), default=0)

    def _versions(self, number: int | None = None) -> dict[str, list[str]]:
        number = self._number() if number is None else number
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_v{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, versions: dict[str, list[str]], number: int) -> None:
        """Makes pointer number, by renaming a finished draft, unless there is one."""
        draft, target = self._path(f"{self.root}/_draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/_v{number}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if not self._fs.exists(target):
                raise
            self._fs.delete(draft, False)
            raise Conflict(f"{self.root}: version {number} was made by another writer") from e

    def _current(self) -> dict[str, list[str]]:
        """What a reader sees: inside a transaction, the version that it began with and what it wrote."""
        return self._versions() if self._pending is None else self._versions(self._base) | self._pending

    def read(self, name: str) -> DataFrame:
        """The current rows, or those that the open transaction has written; empty before the first write."""
        versions = self._current()
        if name not in versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{folder}" for folder in versions[name]))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces a table. rows may come from the table's own current version."""
        self._put(name, rows, False)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows, which no stored row has the key of; what is stored isn't read or written, but for a merge at times."""
        self._put(name, rows, True)

    def _put(self, name: str, rows: DataFrame, more: bool) -> None:
        if self._pending is None:
            with self.transaction():
                return self._put(name, rows, more)
        others = self._current().get(name, []) if more else []
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        rows = rows.select(columns)
        if len(others) >= self.MERGE:
            rows, others = self.read(name).unionByName(rows), []
        folder = f"{name}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{folder}")
        self._pending[name] = [*others, folder]

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        if self._pending is None:
            with self.transaction():
                return self.upsert(name, rows, keys)
        self.write(name, upserted(self.read(name), rows, keys))

    @contextmanager
    def transaction(self):
        """All writes inside take effect together at the end, or none if it fails. Reads inside see one version."""
        if self._pending is not None:
            raise RuntimeError("a transaction is open")
        self._pending, self._base = {}, self._number()
        try:
            yield self
            if self._pending:
                self._point(self._versions(self._base) | self._pending, self._base + 1)
        finally:
            self._pending = None

    def vacuum(self) -> int:
        """Deletes folders and pointers of versions that aren't current; the number of folders. For times without writers."""
        number = self._number()
        current, gone = {folder for folders in self._versions(number).values() for folder in folders}, 0
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name != f"_v{number}" and name not in current:
                gone += bool(self._fs.delete(status.getPath(), True)) and not name.startswith("_")
        return gone


def retried(step, times: int = 5):
    """The result of a step that begins anew, reading what is current, after a Conflict."""
    for turn in range(times):
        try:
            return step()
        except Conflict:
            if turn == times - 1:
                raise
