"""What several operators share: the shared folder, written intermediates, slices of Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python patterns of a word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of the batches in which rows go to Python: what bounds a worker's memory where texts are long.
BATCH_BYTES = "1m"

_own_folder: str | None = None
_made: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of BATCH_BYTES, from now on in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a single machine without that setting, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="loomstone-")
    return f"file://{_own_folder}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes with clean(), at exit at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made.append(path)
    return path


def clean(spark: SparkSession | None = None) -> None:
    """Delete the intermediates of this process. Results that haven't been read to the end need them."""
    spark = spark or SparkSession.getActiveSession()
    while _made and spark is not None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(_made[-1])
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # the session has ended, or the store has
            return
        _made.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost nothing done before."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys with over a KEYS-th of all rows, and over LEAST rows, are met by a broadcast: there are fewer than KEYS of them.
KEYS, LEAST = 8192, 256


def meet(many: DataFrame, one: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """The rows of `many` joined to `one`, which has each key once, with n, at least as many as there are rows of the key in `many`; total: the sum of n.

    Rows of frequent keys stay where they are and meet a table of fewer than KEYS rows; the others are shuffled.
    """
    bound = max(LEAST, total // KEYS)
    hot = one.filter(F.col("n") > bound).drop("n")
    cold = one.filter(F.col("n") <= bound).drop("n")
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def lean(run):
    """For functions of mapInArrow: what is unused at the end of a task goes back to the system.

    A worker process stays for later tasks, and what it keeps adds up with theirs.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary value, 0 for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """The batch in runs of rows of about `most` bytes in the column; a longer row stands alone."""
    total = np.cumsum(lengths(batch.column(batch.schema.get_field_index(column))))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right"))
        to = max(at + 1, to)
        yield batch.slice(at, to - at)
        at = to


def values(column: pa.Array) -> list[bytes]:
    """Each value as bytes, null as none."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
