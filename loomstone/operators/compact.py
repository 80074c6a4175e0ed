"""Compaction: which parts to join next, and joining them.

Rows here have at least job_id, bucket, destination_database, destination_table, destination_schema, part_id,
status, compact_generation, updated_at, destination_active_part_count, destination_active_part_bytes and
destination_active_partition_counts (partition id -> parts).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.plans.ddl import TableSpec

from .state import MOST_INPUTS

GROUP = ["job_id", "bucket", "destination_database", "destination_table", "destination_schema"]
GIB = 1 << 30


@dataclass(frozen=True)
class Options:
    """What a claim takes: least parts of a partition, most artifacts and bytes (0: no bound), and which rows."""

    min_parts: int = 2
    max_artifacts: int = 8
    max_bytes: int = 300 * GIB
    excluded_jobs: tuple[str, ...] = ()
    required_partitions: tuple[str, ...] = ()
    match: dict = field(default_factory=dict, hash=False)

    @property
    def least(self) -> int:
        return self.min_parts or 2

    @property
    def most(self) -> int:
        """Artifacts of a batch; a batch is committed at once, which bounds them anyway."""
        return min(self.max_artifacts or MOST_INPUTS, MOST_INPUTS)


def _named(rows: DataFrame) -> DataFrame:
    blank = F.lit(False)
    for c in GROUP[2:]:
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    return rows.filter(~blank)


def partition_entries(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each partition of each part, without blank ids and zero counts: the group, part_id, partition_id, n."""
    return rows.select(*GROUP, "part_id", *more, F.explode("destination_active_partition_counts").alias("partition_id", "n")).filter((F.trim("partition_id") != "") & (F.col("n") > 0))


def candidates(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """COMPACT_READY rows that may be joined, with `place`: their order in their group.

    Order: generation, time of change, part id. Excluded jobs go by an anti join, so their list may be long.
    """
    own = _named(rows.filter("status = 'COMPACT_READY'")).filter((F.col("destination_active_part_count") > 0) & (F.size("destination_active_partition_counts") > 0))
    for column, value in options.match.items():
        own = own.filter(F.col(column) == value)
    if options.excluded_jobs:
        excluded = rows.sparkSession.createDataFrame([(j,) for j in options.excluded_jobs], "job_id string")
        own = own.join(excluded, "job_id", "left_anti")
    if options.required_partitions:
        own = own.filter(F.arrays_overlap(F.map_keys("destination_active_partition_counts"), F.lit(list(options.required_partitions))))
    order = Window.partitionBy(*GROUP).orderBy(F.coalesce("compact_generation", F.lit(0)), "updated_at", "part_id")
    return own.withColumn("place", F.row_number().over(order))


def busy_partitions(rows: DataFrame) -> DataFrame:
    """The group and partition_id of what COMPACTING rows hold."""
    return partition_entries(_named(rows.filter("status = 'COMPACTING'"))).select(*GROUP, "partition_id").distinct()


def candidate_partitions(own: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """The group, partition_id and `rank`: partitions in the order in which the candidates name them first, by id within a part."""
    entries = partition_entries(own, "place")
    if required:
        entries = entries.filter(F.col("partition_id").isin(list(required)))
    first = entries.groupBy(*GROUP, "partition_id").agg(F.min("place").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy("first", "partition_id"))).drop("first")


def split_by_busy(partitions: DataFrame, busy: DataFrame) -> DataFrame:
    """Candidate partitions with `busy`: whether a running compaction holds them."""
    marked = busy.select(*GROUP, "partition_id", F.lit(True).alias("busy"))
    return partitions.join(marked, [*GROUP, "partition_id"], "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


def single_partition_fill(entries: DataFrame, options: Options, key: list[str]) -> DataFrame:
    """The batch of each partition by itself: entries (key, partition_id, part_id, place, n, bytes) -> those taken, in `rn` order.

    Candidates are taken in order while there is room for artifacts and bytes (the first always); a partition
    whose taken parts are fewer than the least gives none. A running sum says where to stop, so nothing is folded.
    """
    w = Window.partitionBy(*key, "partition_id").orderBy("place", "part_id")
    run = entries.withColumn("rn", F.row_number().over(w)).withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("rn") <= options.most
    if options.max_bytes:
        fits = fits & ((F.col("total") <= options.max_bytes) | (F.col("rn") == 1))
    all_ = Window.partitionBy(*key, "partition_id")
    return run.filter(fits).withColumn("parts", F.sum("n").over(all_)).filter(F.col("parts") >= options.least).drop("total", "parts")


def fill(partitions: list[str], parts: list[dict], options: Options) -> list[str]:
    """The ids that one batch takes, given partitions in order and their candidates (id, bytes, counts) in order.

    The budgets of artifacts and bytes are shared by all partitions. A partition that the parts taken before
    already cover adds nothing; one that can't reach the least adds nothing either, and what it would have
    added is free again.
    """
    taken: dict[str, dict] = {}
    total = 0
    for partition in partitions:
        have = sum(p["counts"].get(partition, 0) for p in taken.values())
        if have >= options.least:
            continue
        new, size = [], 0
        for p in parts:
            n = p["counts"].get(partition, 0)
            if p["id"] in taken or not n:
                continue
            if len(taken) + len(new) >= options.most or options.max_bytes and total + size + p["bytes"] > options.max_bytes and (taken or new):
                break
            new.append(p)
            size, have = size + p["bytes"], have + n
        if have >= options.least:
            taken |= {p["id"]: p for p in new}
            total += size
        if len(taken) >= options.most:
            break
    return list(taken)


def batches(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The group, part_id and `seq`: the next batch of every group.

    Partitions that no running compaction holds are tried first, the others only if those give nothing. A batch
    has so few parts that of each partition only its first candidates matter, so a group reaches its task with a
    bounded number of rows a partition, whatever the number of its parts.
    """
    own = candidates(rows, options)
    entries = partition_entries(own, "place", "destination_active_part_bytes")
    enough = entries.groupBy(*GROUP, "partition_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= options.least).select(*GROUP, "partition_id")
    order = split_by_busy(candidate_partitions(own, options.required_partitions), busy_partitions(rows)).join(enough, [*GROUP, "partition_id"], "left_semi")
    near = entries.withColumn("rn", F.row_number().over(Window.partitionBy(*GROUP, "partition_id").orderBy("place"))).filter(F.col("rn") <= 2 * options.most)
    kept = near.select(*GROUP, "part_id").distinct()
    counts = entries.join(kept, [*GROUP, "part_id"], "left_semi").join(order, [*GROUP, "partition_id"])

    def plan(pdf):
        import pandas as pd

        chosen: list[str] = []
        parts = [
            {"id": i, "bytes": int(g["destination_active_part_bytes"].iloc[0] or 0), "counts": dict(zip(g["partition_id"], g["n"].astype(int)))}
            for i, g in pdf.sort_values("place").groupby("part_id", sort=False)
        ]
        for busy in (False, True):
            own = pdf[pdf["busy"] == busy].sort_values("rank")["partition_id"].drop_duplicates().tolist()
            chosen = fill(own, parts, options)
            if chosen:
                break
        head = {c: [pdf[c].iloc[0]] * len(chosen) for c in GROUP}
        return pd.DataFrame(head | {"part_id": chosen, "seq": range(1, len(chosen) + 1)}, columns=[*GROUP, "part_id", "seq"])

    schema = ", ".join(f"{c} string" for c in GROUP) + ", part_id string, seq int"
    return counts.groupBy(*GROUP).applyInPandas(plan, schema)


def batch_totals(chosen: DataFrame) -> DataFrame:
    """Parts, rows, bytes and inputs of each batch, and the generation of what it makes."""
    return chosen.groupBy(*GROUP).agg(
        F.count("*").alias("inputs"),
        F.coalesce(F.sum("destination_active_part_count"), F.lit(0)).alias("parts"),
        F.coalesce(F.sum("destination_active_part_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("destination_active_part_bytes"), F.lit(0)).alias("bytes"),
        (F.max(F.coalesce("compact_generation", F.lit(0))) + 1).alias("generation"),
    )


def isolated(rows: DataFrame) -> DataFrame:
    """job_id, part_id: COMPACT_READY rows whose single part is the only one of its partition: nothing can be joined to them."""
    active = rows.filter(F.col("status").isin("COMPACT_READY", "COMPACTING"))
    entries = active.select("job_id", "part_id", "status", "destination_active_part_count", F.explode("destination_active_partition_counts").alias("partition_id", "n")).filter((F.trim("partition_id") != "") & (F.col("n") > 0))
    alone = entries.groupBy("job_id", "partition_id").agg(F.sum("n").alias("n")).filter("n = 1").select("job_id", "partition_id")
    single = entries.filter("status = 'COMPACT_READY' and destination_active_part_count = 1").groupBy("job_id", "part_id").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("partition_id").alias("partition_id")).filter("k = 1 and n = 1")
    return single.join(alone, ["job_id", "partition_id"], "left_semi").select("job_id", "part_id")


def ready_since(*columns: str):
    """The first of the time columns that isn't blank."""
    return F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in columns])


def finalize_after(rows: DataFrame, window_seconds: int) -> DataFrame:
    """job_id, finalize_after: when a job's compact window ends; jobs without a row that anchors it aren't there."""
    own = rows.filter(F.col("status").isin("COMPACT_READY", "COMPACTING"))
    at = F.max(ready_since("compact_ready_at", "progress_updated_at", "updated_at"))
    return own.groupBy("job_id").agg((at + F.expr(f"interval {max(0, window_seconds)} seconds")).alias("finalize_after"))


def finalizable(rows: DataFrame, window_seconds: int, now) -> DataFrame:
    """job_id, part_id of the rows that may become FINISHED now (a timestamp or a column).

    Never while a job has READY, IN_PROGRESS or FAILED rows; isolated parts at once; else the whole job, once
    nothing of it is COMPACTING and its window has ended.
    """
    now = now if hasattr(now, "alias") else F.lit(now)
    jobs = rows.groupBy("job_id").agg(F.bool_or(F.col("status").isin("READY", "IN_PROGRESS", "FAILED")).alias("blocked"), F.bool_or(F.col("status") == "COMPACTING").alias("running"))
    free = jobs.filter("not blocked")
    alone = isolated(rows).join(free, "job_id", "left_semi")
    rest = free.filter("not running").join(alone.select("job_id").distinct(), "job_id", "left_anti")
    if window_seconds > 0:
        rest = rest.join(finalize_after(rows, window_seconds).filter(F.col("finalize_after") <= now), "job_id", "left_semi")
    whole = rows.filter("status = 'COMPACT_READY'").join(rest, "job_id", "left_semi").select("job_id", "part_id")
    return alone.unionByName(whole)


def window_expired(rows: DataFrame, window_seconds: int, now) -> DataFrame:
    """job_id of jobs whose compact window has ended; without a window all jobs."""
    if window_seconds <= 0:
        return rows.select("job_id").distinct()
    now = now if hasattr(now, "alias") else F.lit(now)
    return finalize_after(rows, window_seconds).filter(F.col("finalize_after") <= now).select("job_id")


def stale_leases(rows: DataFrame, now, seconds: int) -> DataFrame:
    """COMPACTING rows whose older time of change or claim is `seconds` back or more."""
    now = now if hasattr(now, "alias") else F.lit(now)
    return rows.filter("status = 'COMPACTING'").filter(F.least("updated_at", "compacting_at") <= now - F.expr(f"interval {seconds} seconds"))


def replaced(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """For engines that replace rows of one sort key: the row of the largest version, or any one without a version.

    Other engines' rows stay as they are. An aggregate with partial results by key, without a sort.
    """
    import re

    found = re.fullmatch(r"ReplacingMergeTree(?:\((.*)\))?", spec.engine)
    if not found or not spec.sort_by:
        return rows
    version = re.split(r"\s*,\s*", (found[1] or "").strip())[0].strip("`")
    keys = [F.expr(k).alias(f"__key{i}") for i, k in enumerate(spec.sort_by)]
    row = F.struct(*rows.columns)
    best = F.max_by(row, F.col(version)) if version else F.max(row)
    return rows.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def joined(spark, inputs: list[str], output: str, spec: TableSpec, target_bytes: int = 150 * GIB) -> dict:
    """Join staged folders into one, file by partition; kept only if there are fewer files then.

    Returns inputs, outputs (files), rows and accepted. Files hold so many rows that, at the inputs' bytes a row, none is
    larger than the target. A failed or refused try leaves the inputs as they were.
    """
    from .rewrite import read_folders, staged

    def files(paths: list[str]):
        found = spark.read.schema(spec.schema).option("recursiveFileLookup", "true").parquet(*paths)
        each = found.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
        return each.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()

    before = files(inputs)
    if before["files"] < 2:
        return {"inputs": before["files"], "outputs": before["files"], "rows": 0, "accepted": False}
    whole = replaced(read_folders(spark, inputs, spec).select(*spec.schema.names), spec)
    most = max(1, before["rows"] * target_bytes // max(1, before["bytes"])) if before["bytes"] > target_bytes else 0
    staged(whole, spec, output, allow_empty=True, rows_per_file=most)
    after = files([output])
    return {"inputs": before["files"], "outputs": after["files"], "rows": after["rows"], "accepted": after["files"] < before["files"]}
