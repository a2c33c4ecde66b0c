"""File-system calls through Hadoop, so that they reach whatever store Spark itself reads and writes.

Metadata only: names, small text files, renames and deletes of whole folders.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder. Other errors are raised."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def files(spark: SparkSession, *paths: str, empty: bool = True) -> list[tuple[str, str, int]]:
    """(path, URL-encoded path, modification time in ms) of the files at or under the paths, as a rule empty ones too."""
    jvm, out = spark.sparkContext._jvm, []
    for path in paths:
        p, fs = _path(spark, path)
        found = fs.listFiles(p, True)
        while found.hasNext():
            status = found.next()
            own = status.getPath()
            below = str(own.toUri().getPath())[len(str(p.toUri().getPath())):]
            hidden = any(part.startswith((".", "_")) for part in below.split("/") if part)
            if not hidden and (empty or status.getLen() > 0):
                uri = jvm.org.apache.spark.paths.SparkPath.fromPath(own).urlEncoded()
                out.append((own.toString(), uri, int(status.getModificationTime())))
    return sorted(out)


def unescape(name: str, spark: SparkSession) -> str:
    """A partition folder's value, as Spark wrote it."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.unescapePathName(name)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; an existing one of that name is an error (the store decides, in one step)."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def rename(spark: SparkSession, source: str, target: str) -> None:
    p, fs = _path(spark, source)
    t, _ = _path(spark, target)
    fs.mkdirs(t.getParent())
    if not fs.rename(p, t):
        raise OSError(f"{source} could not be moved to {target}")


def delete_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.exists(p)) and bool(fs.delete(p, True))
