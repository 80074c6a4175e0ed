"""The part registry: which files a table consists of, and how many rows and bytes each partition's parts have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def registry(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """path, name, bytes, modified of the files under a folder, by path: nothing of their contents is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, part_rows, part_bytes of a Parquet folder's files."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("part_rows"), F.max("_metadata.file_size").alias("part_bytes"))


def duplicate_names(files: DataFrame) -> DataFrame:
    """Part names that more than one file has: they couldn't be told apart in a destination."""
    return files.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def totals(parts: DataFrame) -> DataFrame:
    """part_count, part_rows, part_bytes of all parts: one row, zeros where there are none."""
    return parts.agg(F.count("*").alias("part_count"), F.coalesce(F.sum("part_rows"), F.lit(0)).alias("part_rows"), F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("part_bytes"))


def by_partition(parts: DataFrame) -> DataFrame:
    return parts.groupBy("partition_id").agg(F.count("*").alias("part_count"), F.sum("part_rows").alias("part_rows"), F.sum("part_bytes").alias("part_bytes"))


def rolled_up(parts: DataFrame) -> DataFrame:
    """by_partition, and totals as the row of a null partition."""
    return parts.rollup("partition_id").agg(F.count("*").alias("part_count"), F.coalesce(F.sum("part_rows"), F.lit(0)).alias("part_rows"), F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("part_bytes"))


def snapshot(parts: DataFrame) -> DataFrame:
    """part_count, part_bytes, largest: what a waiting merge compares from poll to poll."""
    return parts.agg(F.count("*").alias("part_count"), F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("part_bytes"), F.coalesce(F.max("part_bytes"), F.lit(0)).alias("largest"))


def changed(before: DataFrame, after: DataFrame, key: str, *measures: str) -> DataFrame:
    """Keys whose measures differ between two snapshots, one of which may lack them."""
    a, b = before.alias("a"), after.alias("b")
    same = [F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")) for m in measures]
    all_same = same[0]
    for s in same[1:]:
        all_same = all_same & s
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").filter(~all_same).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key))


def mergeable_pairs(parts: DataFrame, target: int, least: int = 1) -> DataFrame:
    """partition_id, smallest_two: partitions of more than `least` parts (two anyway) whose two smallest fit the target.

    Sums are of decimals, so no size is too large. Two rows a partition are kept before the sum.
    """
    w = Window.partitionBy("partition_id")
    ranked = parts.select("partition_id", "part_bytes", F.row_number().over(w.orderBy("part_bytes")).alias("rn"))
    counts = parts.groupBy("partition_id").agg(F.count("*").alias("n")).filter((F.col("n") > least) & (F.col("n") >= 2)).select("partition_id")
    two = ranked.filter("rn <= 2").groupBy("partition_id").agg(F.sum(F.col("part_bytes").cast("decimal(20,0)")).alias("s"))
    return two.join(counts, "partition_id", "left_semi").filter(F.col("s") <= target).select("partition_id", F.col("s").cast("long").alias("smallest_two"))


def mergeable_partitions(parts: DataFrame, target: int) -> DataFrame:
    """Partitions of more than one part that fit the target as a whole."""
    return by_partition(parts).filter((F.col("part_count") > 1) & (F.col("part_bytes") <= target))


def settled(parts: DataFrame, target: int, least: int = 1) -> DataFrame:
    """partition_id, decision: what remains to do for each partition.

    settled_parts: no more than `least` parts; settled_target: no pair fits the target; merge: all its parts fit
    the target and become one; compact: some pair fits.
    """
    pairs = mergeable_pairs(parts, target, least).select("partition_id", F.lit(True).alias("pair"))
    own = by_partition(parts).join(pairs, "partition_id", "left")
    decision = (
        F.when(F.col("part_count") <= least, "settled_parts")
        .when(F.col("pair").isNull(), "settled_target")
        .when(F.col("part_bytes") <= target, "merge")
        .otherwise("compact")
    )
    return own.select("partition_id", decision.alias("decision"))


def longest_prefix(paths: DataFrame, disks: DataFrame) -> DataFrame:
    """path, disk: the disk whose path is the longest that holds each path; null if none does.

    disks is a short list, one row a mount, and is broadcast as long as Spark finds it small.
    """
    inside = F.col("path").startswith(F.concat(F.rtrim(F.col("disk_path"), F.lit("/")), F.lit("/"))) | (F.col("path") == F.col("disk_path"))
    joined = paths.join(disks, inside, "left")
    best = F.max_by("disk", F.length("disk_path"))
    return joined.groupBy("path").agg(best.alias("disk"))


def count_by_disk(parts: DataFrame, disks: DataFrame) -> DataFrame:
    """disk, n for every disk, also those without parts."""
    return disks.select("disk").join(parts.groupBy("disk").agg(F.count("*").alias("n")), "disk", "full_outer").select("disk", F.coalesce("n", F.lit(0)).alias("n"))


def latest(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by the order, without sorting the log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def merges_running(log: DataFrame, database: str, table: str) -> DataFrame:
    """n: rows of a log of running merges (database, table) that are of one table."""
    return log.filter((F.col("database") == database) & (F.col("table") == table)).agg(F.count("*").alias("n"))


def merges_failed(log: DataFrame, database: str, table: str) -> DataFrame:
    """n: rows of a part log (database, table, event_type, error) that tell of a merge of one table that failed."""
    return merges_running(log.filter("event_type = 'MergeParts' and error <> 0"), database, table)


#: What a query's progress consists of.
PROGRESS = ["read_rows", "read_bytes", "written_rows", "written_bytes"]


def progress_of(running: DataFrame, finished: DataFrame, query_id: str) -> DataFrame:
    """query_id, state and progress of a query: as it runs, else as it ended; state `unknown` if neither knows it."""
    found = running.filter(F.col("query_id") == query_id).select("query_id", F.lit("running").alias("state"), F.lit(1).alias("rank"), *PROGRESS)
    ended = finished.filter(F.col("query_id") == query_id).select("query_id", F.lit("finished").alias("state"), F.lit(2).alias("rank"), *PROGRESS)
    none = running.sparkSession.createDataFrame([(query_id, "unknown", 3, 0, 0, 0, 0)], "query_id string, state string, rank int, " + ", ".join(f"{c} long" for c in PROGRESS))
    best = F.min_by(F.struct("state", *PROGRESS), "rank")
    return found.unionAll(ended).unionAll(none).groupBy("query_id").agg(best.alias("r")).select("query_id", "r.*")


def names(listed: DataFrame, column: str) -> DataFrame:
    """The distinct names of a listing, in order."""
    return listed.select(F.col(column).alias("name")).distinct().orderBy("name")


def tables(listed: DataFrame, excluded: list[str]) -> DataFrame:
    """A listing of tables (database, name) without some databases, in order."""
    return listed.filter(~F.col("database").isin(excluded)).select("database", "name").orderBy("database", "name")


def first_path(listed: DataFrame, column: str) -> DataFrame:
    """The rows with the first element of an array column, counted from one; null where it is empty."""
    return listed.withColumn("first", F.try_element_at(column, F.lit(1)))


def directory_stats(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes (from the listing), part_rows, read_bytes (as the files themselves say) of a folder: one row."""
    listed = registry(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.lit(0).cast("long").alias("part_rows"), F.lit(0).cast("long").alias("read_bytes"))
    read = file_rows(spark, path).agg(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.coalesce(F.sum("part_rows"), F.lit(0)).alias("part_rows"), F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("read_bytes"))
    return listed.unionAll(read).agg(*[F.sum(c).alias(c) for c in listed.columns])
