"""Job analytics over part-state rows. Every function is one aggregate or join over all jobs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import bytes_text, durations_text, entries_text, milliseconds_text, percent

from .compact import finalize_after, isolated, ready_since
from .state import CURRENT_OUTPUT, STATUSES

#: The stages of a rewrite in order.
STAGES = [
    "process_part", "prepare_work_dir", "download_source", "read_manifest", "prepare_worker_tables", "configure_compression", "attach_source_part",
    "insert_select", "configure_merge_settings", "restart_server", "wait_merges", "measure_destination_parts", "freeze_destination_parts",
    "archive_finished_parts", "delete_finished_artifact", "upload_finished_tarballs", "complete_part",
]
SETTLE_STAGE = "wait_merges"


def status_counts(rows: DataFrame) -> DataFrame:
    """job_id, status, n for all nine statuses, zero where a job has none."""
    known = F.explode(F.lit(STATUSES)).alias("status")
    every = rows.select("job_id").distinct().select("job_id", known)
    return every.join(rows.groupBy("job_id", "status").agg(F.count("*").alias("n")), ["job_id", "status"], "left").select("job_id", "status", F.coalesce("n", F.lit(0)).alias("n"))


def _n(*statuses: str) -> Column:
    return F.count(F.when(F.col("status").isin(list(statuses)), 1))


def overall_status(total: Column, n: dict[str, Column]) -> Column:
    """A job's status from the numbers of its parts; the first that holds."""
    done = n["SUPERSEDED"]
    return (
        F.when(total == 0, "EMPTY")
        .when(n["FAILED"] > 0, "FAILED")
        .when(n["IMPORTED"] + done == total, "IMPORTED")
        .when(n["IMPORTING"] > 0, "IMPORTING")
        .when(n["FINISHED"] + n["IMPORTING"] + n["IMPORTED"] + done == total, "READY_FOR_IMPORT")
        .when(n["COMPACTING"] + n["COMPACT_READY"] > 0, "COMPACTING")
        .when(n["IN_PROGRESS"] > 0, "REWRITING")
        .otherwise("READY")
    )


def summary(rows: DataFrame) -> DataFrame:
    """job_id, status, total, rewrite and import progress, sums of rows and bytes, failed merges."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read_rows", "read_bytes", "written_rows", "written_bytes", "destination_failed_merges") if c in rows.columns}
    own = rows.groupBy("job_id").agg(F.count("*").alias("total"), *[_n(s).alias(f"n_{s}") for s in STATUSES], *sums.values())
    n = {s: F.col(f"n_{s}") for s in STATUSES}
    rewritten = n["COMPACT_READY"] + n["COMPACTING"] + n["SUPERSEDED"] + n["FINISHED"] + n["IMPORTING"] + n["IMPORTED"]
    return own.select(
        "job_id", overall_status(F.col("total"), n).alias("status"), "total",
        rewritten.alias("rewrite_completed"), percent(rewritten, F.col("total")).alias("rewrite_percent"),
        n["IMPORTED"].alias("import_completed"), percent(n["IMPORTED"], F.col("total")).alias("import_percent"), *sums,
    )


def generated(rows: DataFrame) -> Column:
    """Whether a row is the output of a compaction."""
    return (F.coalesce(F.size("compact_input_part_ids"), F.lit(0)) > 0) | (F.coalesce("compact_generation", F.lit(0)) > 0)


def original_parts() -> Column:
    """Source parts of a row: what was counted, else one."""
    return F.when(F.col("source_active_part_count") > 0, F.col("source_active_part_count")).otherwise(F.lit(1)).cast("long")


def input_parts(rows: DataFrame) -> DataFrame:
    """job_id, input_parts: over the rows that no compaction made."""
    return rows.groupBy("job_id").agg(F.coalesce(F.sum(F.when(~generated(rows), original_parts())), F.lit(0)).alias("input_parts"))


def row_parts(rows: DataFrame) -> DataFrame:
    """job_id, part_id, status, worker_id, compact_output_part_id, parts_in, parts_out of each row.

    A superseded row has none; a running batch has what it reported; a compaction's output has the parts of its
    inputs, at least one each, by a join of its inputs with the rows; a READY row has no output yet.
    """
    inputs = rows.filter(F.size("compact_input_part_ids") > 0).select("job_id", F.col("part_id").alias("output"), F.explode("compact_input_part_ids").alias("part_id"))
    found = inputs.join(rows.select("job_id", "part_id", F.col("destination_active_part_count").alias("n")), ["job_id", "part_id"], "left")
    sums = found.groupBy("job_id", "output").agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("from_inputs")).withColumnRenamed("output", "part_id")
    gone, running = F.col("status") == "SUPERSEDED", (F.col("status") == "COMPACTING") & (F.coalesce("compact_input_part_count", F.lit(0)) > 0)
    own = rows.join(sums, ["job_id", "part_id"], "left")
    parts_in = F.when(gone, 0).when(running, F.col("compact_input_part_count")).otherwise(F.coalesce("from_inputs", original_parts()))
    parts_out = F.when(gone | (F.col("status") == "READY"), 0).when(running, F.coalesce("compact_output_part_count", F.lit(0))).otherwise(F.coalesce("destination_active_part_count", F.lit(0)))
    return own.select("job_id", "part_id", "status", "worker_id", "compact_output_part_id", "rewrite_stage", parts_in.cast("long").alias("parts_in"), parts_out.cast("long").alias("parts_out"), running.alias("running"))


def counted_once(rows: DataFrame) -> DataFrame:
    """row_parts, with a running batch's numbers on the first of its rows alone."""
    own = row_parts(rows)
    batch = F.col("running") & (F.trim(F.coalesce("compact_output_part_id", F.lit(""))) != "")
    # rows of no batch are each alone, so that none of them has to meet the others
    alone = F.when(batch, F.lit(None)).otherwise(F.col("part_id"))
    w = Window.partitionBy("job_id", "worker_id", "compact_output_part_id", alone).orderBy("part_id")
    first = ~batch | (F.row_number().over(w) == 1)
    return own.select(*[c for c in own.columns if c not in ("parts_in", "parts_out")], F.when(first, F.col("parts_in")).otherwise(0).alias("parts_in"), F.when(first, F.col("parts_out")).otherwise(0).alias("parts_out"))


def current_output(rows: DataFrame) -> DataFrame:
    own = counted_once(rows)
    return own.groupBy("job_id").agg(F.coalesce(F.sum(F.when(F.col("status").isin(CURRENT_OUTPUT), F.col("parts_out"))), F.lit(0)).alias("output_parts"))


def by_status(rows: DataFrame) -> DataFrame:
    """job_id, status, n, parts_in, parts_out."""
    return counted_once(rows).groupBy("job_id", "status").agg(F.count("*").alias("n"), F.sum("parts_in").alias("parts_in"), F.sum("parts_out").alias("parts_out"))


def stage_histogram(rows: DataFrame) -> DataFrame:
    """job_id, stage, n, place: IN_PROGRESS rows by stage, known stages in order and then others by name."""
    stage = F.when(F.trim(F.coalesce("rewrite_stage", F.lit(""))) == "", "unknown").otherwise(F.trim("rewrite_stage"))
    counts = rows.filter("status = 'IN_PROGRESS'").groupBy("job_id", stage.alias("stage")).agg(F.count("*").alias("n"))
    known = F.array_position(F.lit(STAGES), F.col("stage"))
    order = F.when(known > 0, known).otherwise(len(STAGES) + 1)
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(order, "stage")))


def failed_parts(rows: DataFrame) -> DataFrame:
    return rows.filter("status = 'FAILED'").select("job_id", "part_id", "updated_at", "error").orderBy("job_id", "part_id")


def compact_summary(rows: DataFrame, window_seconds: int, now) -> DataFrame:
    """job_id, ready, compacting, finalize_status, blocked_by, seconds_left of jobs that have parts to join."""
    now = now if hasattr(now, "alias") else F.lit(now)
    jobs = rows.groupBy("job_id").agg(*[_n(s).alias(s) for s in ("READY", "IN_PROGRESS", "COMPACT_READY", "COMPACTING", "FAILED")]).filter("COMPACT_READY + COMPACTING > 0")
    alone = isolated(rows).select("job_id", F.lit(True).alias("alone")).distinct()
    own = jobs.join(alone, "job_id", "left").join(finalize_after(rows, window_seconds), "job_id", "left")
    blockers = F.array_join(F.filter(F.array(*[F.when(F.col(s) > 0, F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) for s in ("READY", "IN_PROGRESS", "COMPACTING", "FAILED")]), lambda x: x.isNotNull()), ", ")
    at_once = F.coalesce("alone", F.lit(False)) & (F.col("READY") + F.col("IN_PROGRESS") + F.col("FAILED") == 0)
    ends = F.col("finalize_after") if window_seconds > 0 else now
    state = (
        F.when(F.col("COMPACT_READY") == 0, "waiting_for_compacting")
        .when(at_once, "ready")
        .when(ends.isNull(), "unknown")
        .when(blockers != "", "blocked")
        .when(now < ends, "waiting")
        .otherwise("ready")
    )
    left = F.when(state == "waiting_for_compacting", None).when(state == "ready", 0).otherwise(remaining(ends, now))
    return own.select("job_id", F.col("COMPACT_READY").alias("ready"), F.col("COMPACTING").alias("compacting"), state.alias("finalize_status"), blockers.alias("blocked_by"), left.cast("long").alias("seconds_left"))


def remaining(until: Column, now: Column) -> Column:
    """Whole seconds until a time, 0 if it is past."""
    return F.greatest(F.lit(0), F.round(_seconds(until) - _seconds(now))).cast("long")


def elapsed(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.round(_seconds(now) - _seconds(since))).cast("long")


def _seconds(at: Column) -> Column:
    """Seconds since 1970 of a time without zone, with fractions."""
    return F.unix_micros(at.cast("timestamp")) / 1e6


def partitions_text(rows: DataFrame) -> DataFrame:
    """job_id, part_id, partitions: hidden for parts that aren't rewritten yet."""
    text = F.when(F.col("status").isin("READY", "IN_PROGRESS"), "").otherwise(entries_text(F.col("destination_active_partition_counts")))
    return rows.select("job_id", "part_id", text.alias("partitions"))


def settle_wait(durations: Column, stage: Column, elapsed_ms: Column) -> Column:
    """Milliseconds that a part waited for merges: of the finished stage, else of the running one."""
    return F.coalesce(F.element_at(durations, SETTLE_STAGE), F.when(stage == SETTLE_STAGE, elapsed_ms))


def visible(rows: DataFrame, all_rows: bool = False) -> DataFrame:
    return rows if all_rows else rows.filter("status <> 'SUPERSEDED'")


#: The columns of the two reports over parts, in order.
ROW_REPORT = "part_id status attempts worker read_rows read_size written_rows written_size source_rows dest_rows input_parts output_parts partitions failed_merges settle_wait compact_ready_for progress_at updated_at error".split()
DETAIL_REPORT = "part_id status attempts worker stage stage_elapsed total_elapsed stage_started progress_at updated_at stage_durations error".split()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def row_report(rows: DataFrame, now) -> DataFrame:
    """One row a part as people read it: progress, sizes, partitions, waits, errors. Absent values are empty or zero."""
    counted = row_parts(rows).select("job_id", "part_id", "parts_in", "parts_out")
    since = ready_since("compact_ready_at", "progress_updated_at", "updated_at").cast("timestamp_ntz")
    waited = settle_wait(F.col("rewrite_stage_durations_ms"), F.col("rewrite_stage"), F.col("rewrite_stage_elapsed_ms"))
    ready = F.when(F.col("status") != "COMPACT_READY", "").when(since.isNull(), "unknown").otherwise(milliseconds_text(elapsed(since, now) * 1000))
    shown = F.when(F.col("status").isin("READY", "IN_PROGRESS"), "").otherwise(entries_text(F.col("destination_active_partition_counts")))
    values = [
        F.col("part_id"), F.col("status"), _number("attempts"), _text("worker_id"), _number("read_rows"), bytes_text(_number("read_bytes")), _number("written_rows"), bytes_text(_number("written_bytes")),
        _number("source_active_part_rows"), _number("destination_active_part_rows"), _number("parts_in"), _number("parts_out"), shown, _number("destination_failed_merges"),
        F.coalesce(milliseconds_text(waited), F.lit("")), ready, _text("progress_updated_at"), _text("updated_at"), _text("error"),
    ]
    return rows.join(counted, ["job_id", "part_id"]).select(*[v.alias(n) for v, n in zip(values, ROW_REPORT)])


def detail_report(rows: DataFrame) -> DataFrame:
    """One row a part: its stage, how long that and all stages took."""
    staged = F.coalesce(F.trim("rewrite_stage"), F.lit("")) != ""
    spent = lambda name: F.when(staged, milliseconds_text(_number(name))).otherwise("")
    values = [
        F.col("part_id"), F.col("status"), _number("attempts"), _text("worker_id"), _text("rewrite_stage"), spent("rewrite_stage_elapsed_ms"), spent("rewrite_total_elapsed_ms"),
        _text("rewrite_stage_started_at"), _text("progress_updated_at"), _text("updated_at"), durations_text(F.col("rewrite_stage_durations_ms")), _text("error"),
    ]
    return rows.select(*[v.alias(n) for v, n in zip(values, DETAIL_REPORT)])
