"""Small files beside the stored relations, on whatever file system their folder is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write the whole file, so that a reader finds the old text or the new one."""
    part, system = _at(spark, f"{path}.part")
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    where, _ = _at(spark, path)
    if system.exists(where):
        system.delete(where, False)
    system.rename(part, where)


def read_text(spark: SparkSession, path: str) -> str | None:
    where, system = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it."""
    where, system = _at(spark, path)
    system.delete(where, True)


def folders_with(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of the files that match a glob, sorted."""
    where, system = _at(spark, pattern)
    return sorted(str(s.getPath().getParent()) for s in system.globStatus(where) or [])


#: Names the folder of the last whole run.
CURRENT = "current"


def history_folder(spark: SparkSession, folder: str) -> str:
    """Where the relations of a stored history lie: in the last whole run under `folder`, or in `folder` itself."""
    run = read_text(spark, f"{folder}/{CURRENT}")
    return f"{folder}/{run.strip()}" if run else folder
