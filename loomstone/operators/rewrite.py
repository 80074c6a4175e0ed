"""Rewriting a source into a destination's form: a row-local select, by position, sorted, partitioned, compressed."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.ddl import TableSpec
from loomstone.plans.guard import check

#: The column that names a row's destination partition in staged files.
PARTITION = "_partition"


class EmptyOutput(ValueError):
    """A part's select gave no rows."""


def positional(df: DataFrame, spec: TableSpec, strict: bool = False) -> DataFrame:
    """The select's columns named and typed like the destination's, by position as in an insert.

    With strict, a value that the destination's type can't hold is an error; else it is null where Spark's try_cast says so.
    """
    if len(df.columns) != len(spec.schema.fields):
        raise ValueError(f"the select has {len(df.columns)} columns, {spec.table} has {len(spec.schema.fields)}")
    temporary = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cast = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    same = dict(zip(temporary.columns, df.schema.fields))
    out = []
    for c, field in zip(temporary.columns, spec.schema.fields):
        out.append((F.col(c) if same[c].dataType == field.dataType else cast(c, field.dataType)).alias(field.name))
    return temporary.select(*out)


def rewritten(source: DataFrame, select: Callable[[DataFrame], DataFrame] | str, spec: TableSpec, view: str = "source") -> DataFrame:
    """The destination's rows of a source: the select, checked to be row-local, in the destination's columns.

    A select given as text reads the source by the name of `view`. One pass without a shuffle; filters and column
    selection reach the scan.
    """
    if isinstance(select, str):
        out = source.sparkSession.sql(select, **{view: source}) if "{" + view + "}" in select else _by_view(source, select, view)
    else:
        out = select(source)
    return positional(check(out), spec)


#: Held while a select reads its source by name, since parts are rewritten side by side.
_naming = threading.Lock()


def _by_view(source: DataFrame, select: str, view: str) -> DataFrame:
    """The select over a view of that name; the plan holds the source itself, so the view needn't stay."""
    with _naming:
        source.createOrReplaceTempView(view)
        try:
            return source.sparkSession.sql(select)
        finally:
            source.sparkSession.catalog.dropTempView(view)


def staged(df: DataFrame, spec: TableSpec, path: str, allow_empty: bool = False, rows_per_file: int = 0, cluster: bool = True) -> str:
    """Write a part's output to its own folder, a directory for each destination partition; returns the path.

    Writing again replaces the folder, so a retried part leaves no doubles. With cluster, rows are dealt by
    partition first, split where a partition is large (a rebalance), so that each partition has few files; without,
    no row is moved and each task writes its own. No rows at all is an error unless allowed.
    """
    out = df.withColumn(PARTITION, partition_column(spec))
    if cluster:
        out = out.hint("rebalance", PARTITION)
    if spec.sort_by:
        out = out.sortWithinPartitions(PARTITION, *[F.expr(k) for k in spec.sort_by])
    writer = out.write.mode("overwrite").partitionBy(PARTITION).option("compression", spec.codec)
    if spec.codec == "zstd":
        writer = writer.option("parquet.compression.codec.zstd.level", str(spec.level))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", str(rows_per_file))
    writer.parquet(path)
    if not allow_empty and read_staged(df.sparkSession, path, spec).isEmpty():
        raise EmptyOutput(f"the select gave no rows for {path}")
    return path


def read_staged(spark, path: str, spec: TableSpec, with_partition: bool = False) -> DataFrame:
    """What staged() wrote, in the destination's columns; an empty folder has no rows. Folders of several parts above it are no columns."""
    from pyspark.sql import types as T

    schema = T.StructType([*spec.schema.fields, T.StructField(PARTITION, T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    return df.select(*spec.schema.names, *([PARTITION] if with_partition else []))


def read_folders(spark, paths: list[str], spec: TableSpec) -> DataFrame:
    """Many staged folders as one scan, in the destination's columns, with the partition worked out anew.

    Partition directories aren't read from the paths, as folders of several parts share none.
    """
    df = spark.read.schema(spec.schema).option("recursiveFileLookup", "true").parquet(*paths)
    return df.withColumn(PARTITION, partition_column(spec))


def partition_column(spec: TableSpec):
    return F.expr(spec.partition_by).cast("string") if spec.partition_by else F.lit("all")


def by_part(source: DataFrame, part: F.Column, select, spec: TableSpec) -> DataFrame:
    """All parts' outputs with a column part: since the select is row-local, one pass over the whole gives the same rows."""
    tagged = source.withColumn("part_", part)
    inner = select(tagged) if callable(select) else _by_view(tagged, select, "source")
    return positional(check(inner.select(*[c for c in inner.columns if c != "part_"])), spec)
