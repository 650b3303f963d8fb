"""Source trees as tables, and what changed between two of them."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.scratch import Scratch

_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false)(?:; length=(\d+); replication=\d+; blocksize=\d+)?; modification_time=(\d+); ", re.S)
_RAW = "path string, content binary, last_modified double"


@dataclass
class _Tree:
    """What a walk finds. Spark's file sources skip names that begin with _ or . and empty files, so those come apart."""

    roots: list[str] = field(default_factory=list)  # folders without ignored ones, and single files
    hidden: list[tuple[str, float]] = field(default_factory=list)
    empty: list[tuple[str, float]] = field(default_factory=list)


def _walk(spark: SparkSession, root: str, ignored: frozenset[str]) -> tuple[str, _Tree]:
    """The root's qualified name, and the tree below it. One call for each folder; ignored ones aren't entered."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs, tree = top.getFileSystem(conf), _Tree()
    top = fs.makeQualified(top)

    def walk(folder, visible: bool) -> tuple[bool, list[str]]:
        """Whether all that Spark sees below the folder is wanted; if not, what is."""
        found = jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(folder))
        clean, parts = True, []
        for path, is_folder, length, modified in sorted(_STATUS.findall(found)):
            name = path.rsplit("/", 1)[-1]
            seen = visible and not name.startswith(("_", ".")) and not name.endswith("._COPYING_")
            if name in ignored:
                clean &= not seen
            elif is_folder == "true":
                try:
                    whole, own = walk(jvm.org.apache.hadoop.fs.Path(path), seen)
                except Py4JJavaError:  # gone meanwhile, or not ours to read
                    continue
                clean &= whole
                parts += [path] if whole and seen else own
            elif X.is_supported(name):
                if length == "0":
                    tree.empty.append((path, float(modified)))
                elif seen:
                    parts.append(path)
                else:
                    tree.hidden.append((path, float(modified)))
        return clean, parts

    clean, parts = walk(top, True)
    tree.roots = [top.toString()] if clean else parts
    return top.toString().rstrip("/"), tree


def _copied(spark: SparkSession, files: list[tuple[str, float]]) -> DataFrame:
    """Hidden files by copies in the shared folder, whose names Spark doesn't skip."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = f"{Scratch(spark, 'hidden').root}/files"

    def copy(number: int) -> None:
        source, target = jvm.org.apache.hadoop.fs.Path(files[number][0]), jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
        try:
            jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        except Py4JJavaError:  # gone meanwhile
            pass

    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(conf).mkdirs(target)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(copy, range(len(files))))
    names = spark.createDataFrame([(str(i), path, modified) for i, (path, modified) in enumerate(files)], "number string, path string, last_modified double")
    copies = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("number"), "content")
    return names.join(copies, "number").select("path", "content", "last_modified")


def scan(spark: SparkSession, root: str, older: bool = False) -> DataFrame:
    """Supported files below root that aren't ignored: path (relative), language, content, hash, last_modified (epoch ms).

    Whatever a name begins with, and empty files too. Folders with an ignored name aren't entered. A file that vanishes
    while it is read, or can't be, is left out; text that isn't UTF-8 is read with replacements."""
    ignored = frozenset((*X.IGNORED_V1, *X.IGNORED_FILES_V1) if older else X.IGNORED)
    base, tree = _walk(spark, root, ignored)
    parts = [spark.createDataFrame([(path, b"", modified) for path, modified in tree.empty], _RAW)]
    if tree.roots:
        either = "".join(f"{e}," for e in ("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in X.EXTENSIONS)).rstrip(",")
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", False).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("pathGlobFilter", f"*.{{{either}}}").load(tree.roots)
        parts.append(raw.select("path", "content", (F.unix_micros("modificationTime") / 1000.0).alias("last_modified")))
    if tree.hidden:
        parts.append(_copied(spark, tree.hidden))
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    files = files.select(F.substr("path", F.lit(len(base) + 2)).alias("path"), F.decode("content", "UTF-8").alias("content"), "last_modified")
    files = files.filter(X.supported(F.col("path")))
    if older:
        name = F.element_at(F.split("path", "/"), -1)
        files = files.filter(~X.ignored(F.col("path"), X.IGNORED_V1) & ~name.isin(*X.IGNORED_FILES_V1))
        return files.select("path", X.language_v1(F.col("path")).alias("language"), "content", X.file_hash_v1(F.col("content")).alias("hash"), F.floor(F.col("last_modified") / 1000).cast("double").alias("last_modified"))
    files = files.filter(~X.ignored(F.col("path")))
    return files.select("path", X.language(F.col("path")).alias("language"), "content", X.file_hash(F.col("content")).alias("hash"), "last_modified")


def changed(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Scanned rows whose hash isn't the stored one of (project_id, path); all of them with force."""
    old = stored.select("project_id", "path", F.col("hash").alias("old_hash"))
    joined = scanned.join(old, ["project_id", "path"], "left")
    return (joined if force else joined.filter(~F.col("hash").eqNullSafe(F.col("old_hash")))).drop("old_hash")


def vanished(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that the scan doesn't have."""
    return stored.join(scanned.select("project_id", "path"), ["project_id", "path"], "left_anti")


def index_counts(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """One row: files indexed, skipped and in all."""
    n, total = changed(scanned, stored, force).agg(F.count("*").alias("files_indexed")), scanned.agg(F.count("*").alias("total_files"))
    return n.crossJoin(total).select("files_indexed", (F.col("total_files") - F.col("files_indexed")).alias("files_skipped"), "total_files")
