"""Names in folders of any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, by name; nothing if there is no such folder."""
    folder, files = _opened(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix=number``, ascending."""
    found = (n.removeprefix(f"{prefix}=") for n in names(spark, path) if n.startswith(f"{prefix}="))
    return sorted(int(n) for n in found if n.isdigit())


def newest_published(spark: SparkSession, path: str) -> int | None:
    """The highest ``version=number`` that holds its file. One without is left over from a writer that did not get to the end."""
    for version in reversed(numbered(spark, path, "version")):
        if any(n.startswith("part-") for n in names(spark, f"{path}/version={version}")):
            return version
    return None


def size_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and number of the files with rows below a folder."""
    folder, files = _opened(spark, path)
    found, sizes = files.listFiles(folder, True), []
    while found.hasNext():
        status = found.next()
        if status.getPath().getName().startswith("part-"):
            sizes.append(status.getLen())
    return sum(sizes), len(sizes)


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _opened(spark, path)
    files.delete(folder, True)
