"""Small files in any store that Spark can reach, and the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_made: list[str] = []


def _at(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, fs.makeQualified(found)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, path = _at(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _at(spark, path)
    return fs.exists(found)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, found = _at(spark, path)
    stream = fs.open(found)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a whole file unless one of that name is there; of several writers one succeeds.

    The file is written beside its place and then linked (local folders) or renamed without overwriting (others): as
    safe as the store's rename is.
    """
    jvm = spark._jvm
    fs, found = _at(spark, path)
    fs.mkdirs(found.getParent())
    own = jvm.org.apache.hadoop.fs.Path(found.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(own, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            paths = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(paths.get(found.toUri()), paths.get(own.toUri()))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
            context.rename(own, found, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(own, False)


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the folder of spark.checkpoint.dir; a temporary one where that is unset, on a single machine alone."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="loomstone-")
        named = f"file://{_own_folder}"
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Delete what scratch() named. Results that haven't been read to the end need it."""
    spark = SparkSession.getActiveSession()
    while _made and spark is not None:
        try:
            fs, path = _at(spark, _made[-1])
            fs.delete(path, True)
        except Exception:  # the session has ended, or the store has
            return
        _made.pop()
