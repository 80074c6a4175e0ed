"""Manifests: what a part is, where it comes from and goes, and the statements that rewrite it, as JSON beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
# A manifest's form.
SCHEMA = (
    "version int, job_id string, part_id string, freeze string, source struct<database:string,table:string>, dest struct<database:string,table:string>, "
    "part struct<disk:string,name:string,relative_path:string>, sql struct<source_schema:string,destination_schema:string,insert_select:string>, "
    "s3 struct<bucket:string,source_key:string,finished_key:string>, created_at timestamp"
)
REQUIRED = ["job_id", "part_id", "source.table", "dest.database", "dest.table", "part.name", "sql.destination_schema", "sql.insert_select", "s3.bucket", "s3.source_key", "s3.finished_key"]


def to_text(rows: DataFrame) -> DataFrame:
    """Rows in the manifest's form -> part_id, manifest (JSON)."""
    return rows.select("part_id", F.to_json(F.struct(*rows.columns)).alias("manifest"))


def from_text(rows: DataFrame, column: str = "manifest") -> DataFrame:
    """Rows with a JSON column -> the manifest's fields; text that isn't one gives nulls, which problems() names.

    Made by a generator, so that a text is parsed once for all its fields and not once for each.
    """
    return rows.select(F.inline(F.array(F.from_json(column, SCHEMA))))


def problem() -> Column:
    """What a manifest lacks, or null."""
    tests = F.when(F.col("version").isNull() | (F.col("version") != VERSION), f"version isn't {VERSION}")
    for name in REQUIRED:
        tests = tests.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", f"{name} is missing")
    return tests


def problems(manifests: DataFrame) -> DataFrame:
    return manifests.select("part_id", problem().alias("problem")).filter("problem is not null")


def mismatches(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """part_id of manifests that differ from their state rows in job, bucket or key, or have none."""
    return checked(manifests, rows).filter("not same").select("part_id")


def checked(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifests with `problem` (null: none) and `same`: whether the state row has their job, bucket and key."""
    own = rows.select("part_id", F.col("job_id").alias("job_"), F.col("bucket").alias("bucket_"), F.col("source_key").alias("key_"))
    same = F.col("job_id").eqNullSafe(F.col("job_")) & F.col("s3.bucket").eqNullSafe(F.col("bucket_")) & F.col("s3.source_key").eqNullSafe(F.col("key_"))
    return manifests.join(own, "part_id", "left").select(*[F.col(c) for c in manifests.columns], problem().alias("problem"), same.alias("same"))
