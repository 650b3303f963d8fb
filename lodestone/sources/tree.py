"""Small source trees in any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_tree(spark: SparkSession, root: str, files: dict[str, str]) -> None:
    """Writes (or replaces) files by their relative path."""
    jvm = spark._jvm
    for path, text in files.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(text.encode()))
        stream.close()


def remove_from_tree(spark: SparkSession, root: str, paths: list[str]) -> None:
    """Deletes files by their relative path."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
