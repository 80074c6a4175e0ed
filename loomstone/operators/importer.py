"""Registering source files as work, and importing finished parts into the final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import ids
from loomstone.plans.ddl import TableSpec
from loomstone.sources import store

from .parts import duplicate_names, registry
from .rewrite import PARTITION, read_folders, read_staged
from .state import StateLog, new_row, timestamp


#: What a part's folder in a table is named by.
FOLDER = "import="


class NotEmpty(ValueError):
    """The final table has rows already."""


def registered(spark: SparkSession, path: str, job: str, bucket: str, prefix: str, spec: TableSpec, select: str) -> DataFrame:
    """part_id, path, bytes, source_key, finished_key of a folder's files: what an upload would make, without a copy.

    Ids follow from the file, the destination and the select, so that registering again gives the same rows.
    """
    files = registry(spark, path)
    if files.isEmpty():
        raise ValueError(f"there are no parts in {path}")
    twice = [r["name"] for r in duplicate_names(files).limit(5).collect()]
    if twice:
        raise ValueError(f"parts of one name: {', '.join(twice)}")
    part = F.concat(F.lit("part-"), ids.short_hash_column(F.lit(""), F.col("path"), F.col("name"), F.lit(""), F.lit(spec.schema.json()), F.lit(select)))
    key = lambda kind: F.concat(F.lit(f"{prefix.strip('/')}/jobs/{ids.safe_segment(job)}/{kind}/"), F.col("part_id"))
    return files.withColumn("part_id", part).select("part_id", "path", "bytes", key("source").alias("source_key"), key("finished").alias("finished_key"), F.lit(job).alias("job_id"), F.lit(bucket).alias("bucket"))


def submit(log: StateLog, found: DataFrame, spec: TableSpec) -> int:
    """Write registered parts as READY rows, all in one commit; returns how many."""
    now = timestamp()
    rows = []
    for r in found.orderBy("path").collect():
        rows.append(new_row(r["job_id"], r["part_id"], r["bucket"], r["path"], r["finished_key"], now, destination_database=spec.database, destination_table=spec.table, destination_schema=spec.schema.json()))
    log.commit(rows)
    return len(rows)


class ImportFailed(RuntimeError):
    """A part couldn't be attached; those before it are, those after it wait."""


def import_finished(log: StateLog, job: str, spec: TableSpec, root: str, table: str, require_empty: bool = True) -> int:
    """Attach the FINISHED parts of a job to the table's folder, one after another by key; returns how many.

    A part is IMPORTING before and IMPORTED after. The first that fails is marked FAILED with its error and ends the
    import; put back to work it is FINISHED again, and a later run goes on with it. A part has a folder of its own in
    the table, which attaching again replaces, so a crash at any time leaves no doubles: parts that are found IMPORTING
    are attached again. With require_empty the table may hold nothing but parts of this job.
    """
    spark = log.spark
    rows = log.get(job)
    waiting = sorted((r for r in rows if r["status"] in ("FINISHED", "IMPORTING")), key=lambda r: r["finished_key"])
    if not waiting:
        return 0
    begun = {r["part_id"] for r in rows if r["status"] in ("IMPORTING", "IMPORTED") or (r["importing_at"] or "").strip()}
    if require_empty:
        others = [n for n in store.names(spark, table) if n.removeprefix(FOLDER) not in begun and not n.startswith((".", "_SUCCESS"))]
        if any(not _empty(spark, f"{table}/{n}", spec) for n in others):
            raise NotEmpty(f"{table} has rows")
    for r in waiting:
        part = r["part_id"]
        if r["status"] == "FINISHED":
            log.apply(job, [part], "import")
        try:
            whole = read_folders(spark, [f"{root}/{r['finished_key']}"], spec)
            whole.write.mode("overwrite").partitionBy(PARTITION).option("compression", spec.codec).parquet(f"{table}/{FOLDER}{part}")
        except Exception as e:
            log.apply(job, [part], "fail", error=str(e)[:1000])
            raise ImportFailed(f"part {part}: {e}") from e
        log.apply(job, [part], "imported")
    return len(waiting)


def _empty(spark: SparkSession, table: str, spec: TableSpec) -> bool:
    try:
        return read_staged(spark, table, spec).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return True
        raise
