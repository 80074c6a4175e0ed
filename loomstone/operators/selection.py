"""What administrators choose: rows to retry, delete, set, reset or import, and whether lineage allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.sources.store import written

from .state import STATUSES
from .status import generated


class Missing(ValueError):
    """Ids that were asked for and aren't there."""


def by_status(rows: DataFrame, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"there is no status {status}")
    return rows.filter(F.col("status") == status)


def by_ids(rows: DataFrame, ids: list[str], strict: bool = True) -> DataFrame:
    """Rows of the given part ids with `asked`, their place in the list; repeated ids count once, missing ones are an error."""
    clean = [i.strip() for i in ids]
    if "" in clean:
        raise ValueError("an id is blank")
    order = rows.sparkSession.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(clean), 1)], "part_id string, asked int")
    if strict:
        gone = [r["part_id"] for r in order.join(rows, "part_id", "left_anti").orderBy("asked").limit(20).collect()]
        if gone:
            raise Missing(f"parts {', '.join(gone)} aren't in the job")
    return rows.join(order, "part_id")


def retry(rows: DataFrame, in_progress: bool = False, force: bool = False) -> DataFrame:
    """FAILED rows; with in_progress those being rewritten too; with force all."""
    return rows if force else rows.filter(F.col("status").isin(["FAILED", *(["IN_PROGRESS"] if in_progress else [])]))


def stale_retry(rows: DataFrame, now, seconds: int = 300) -> DataFrame:
    """IN_PROGRESS rows whose last progress is over `seconds` back; rows without a time don't count."""
    if seconds <= 0:
        raise ValueError("the time must be more than zero")
    now = now if hasattr(now, "alias") else F.lit(now)
    return rows.filter("status = 'IN_PROGRESS'").filter(F.col("progress_updated_at") < now - F.expr(f"interval {seconds} seconds"))


def compacting(rows: DataFrame, output: str | None = None) -> DataFrame:
    """COMPACTING rows, all or of one output."""
    own = rows.filter("status = 'COMPACTING'")
    return own if output is None else own.filter(F.col("compact_output_part_id") == output)


def importable(rows: DataFrame, part: str | None = None) -> DataFrame:
    """FINISHED rows in the order of their keys, all or one."""
    own = rows.filter("status = 'FINISHED'")
    return (own if part is None else own.filter(F.col("part_id") == part)).orderBy("finished_key")


def lineage_edges(rows: DataFrame) -> DataFrame:
    """job_id, output, input of all compactions."""
    return rows.filter(F.size("compact_input_part_ids") > 0).select("job_id", F.col("part_id").alias("output"), F.explode("compact_input_part_ids").alias("input"))


def lineage_problems(rows: DataFrame) -> DataFrame:
    """job_id, part_id, problem: every way in which compactions' inputs don't fit together, but for cycles.

    An input may be blank, the output itself, named twice, missing, or superseded by another output. A row may be
    superseded by one that is no compaction or doesn't name it; that its output is gone is no problem.
    """
    edges = lineage_edges(rows).withColumn("input", F.trim("input"))
    blank = edges.filter("input = ''").select("job_id", "output", F.lit("blank input").alias("problem"))
    edges = edges.filter("input <> ''")
    self_ = edges.filter("input = output").select("job_id", "output", F.lit("own input").alias("problem"))
    twice = edges.groupBy("job_id", "output", "input").agg(F.count("*").alias("n")).filter("n > 1").select("job_id", "output", F.lit("input named twice").alias("problem"))
    parts = rows.select("job_id", F.col("part_id").alias("input"), F.trim("superseded_by").alias("superseded_by"), F.lit(True).alias("there"))
    found = edges.distinct().join(parts, ["job_id", "input"], "left")
    missing = found.filter("there is null").select("job_id", "output", F.lit("missing input").alias("problem"))
    other = found.filter("superseded_by <> '' and superseded_by <> output").select("job_id", "output", F.lit("input of another output").alias("problem"))
    back = rows.filter("trim(superseded_by) <> ''").select("job_id", "part_id", F.trim("superseded_by").alias("output"))
    outputs = rows.select("job_id", F.col("part_id").alias("output"), generated(rows).alias("made"))
    claimed = back.join(outputs, ["job_id", "output"])
    plain = claimed.filter("not made").select("job_id", "part_id", F.lit("superseded by a part that is no compaction").alias("problem"))
    named = edges.select("job_id", "output", F.col("input").alias("part_id"))
    unnamed = claimed.filter("made").join(named, ["job_id", "output", "part_id"], "left_anti").select("job_id", "part_id", F.lit("superseded by a part that doesn't name it").alias("problem"))
    out = blank.unionAll(self_).unionAll(twice).unionAll(missing).unionAll(other).withColumnRenamed("output", "part_id")
    return out.unionAll(plain).unionAll(unnamed)


def _peeled(edges: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """job_id, output, depth of the outputs of which a chain of inputs comes to an end, and the edges from which one never does.

    Each round keeps the edges whose input is an output of what was left before: those that begin a chain longer by
    one. It ends when none goes, however deep the chains. Lineage is cut after every few rounds.
    """
    left = written(edges.select("job_id", "output", "input").distinct(), "lineage")
    n, depth, found = left.count(), 0, left.select("job_id", "output", F.lit(0).alias("depth")).limit(0)
    while n:
        for _ in range(rounds):
            depth += 1
            outputs = left.select("job_id", "output").distinct()
            found = found.unionAll(outputs.withColumn("depth", F.lit(depth)))
            left = left.join(outputs.withColumnRenamed("output", "input"), ["job_id", "input"], "left_semi").select("job_id", "output", "input")
        left = written(left, "lineage")
        found = written(found.groupBy("job_id", "output").agg(F.max("depth").alias("depth")), "lineage-depth")
        before, n = n, left.count()
        if n == before:
            break
    return found, left


def lineage_cycles(edges: DataFrame) -> DataFrame:
    """job_id, output of the edges (job_id, output, input) that lie on or above a cycle."""
    return _peeled(edges)[1].select("job_id", "output").distinct()


def lineage_depth(edges: DataFrame) -> DataFrame:
    """job_id, output, depth: generations below each output; null on or above a cycle, where there is no end to them."""
    depths, cyclic = _peeled(edges)
    return depths.join(cyclic.select("job_id", "output", F.lit(True).alias("endless")).distinct(), ["job_id", "output"], "left").select("job_id", "output", F.when(F.col("endless").isNull(), F.col("depth")).alias("depth"))


def reset_blockers(rows: DataFrame, compaction: bool) -> DataFrame:
    """job_id, part_id, problem: why a job can't be reset, but for its lineage."""
    begun = F.col("status").isin("IMPORTING", "IMPORTED") | (F.trim(F.coalesce("importing_at", F.lit(""))) != "") | (F.trim(F.coalesce("imported_at", F.lit(""))) != "")
    out = rows.filter(begun).select("job_id", "part_id", F.lit("import has begun").alias("problem"))
    out = out.unionAll(rows.groupBy("job_id", "part_id").agg(F.count("*").alias("n")).filter("n > 1").select("job_id", "part_id", F.lit("part is there twice").alias("problem")))
    empty = rows.filter(generated(rows) & (F.coalesce(F.size("compact_input_part_ids"), F.lit(0)) <= 0))
    out = out.unionAll(empty.select("job_id", "part_id", F.lit("compaction without inputs").alias("problem")))
    jobs = rows.groupBy("job_id").agg(F.count(F.when(~generated(rows), 1)).alias("originals")).filter("originals = 0")
    out = out.unionAll(jobs.select("job_id", F.lit(None).cast("string").alias("part_id"), F.lit("no original parts").alias("problem")))
    return out.unionAll(reset_preconditions(rows)) if compaction else out


def reset_preconditions(rows: DataFrame) -> DataFrame:
    """job_id, part_id, problem: originals that can't go back to COMPACT_READY."""
    own = rows.filter(~generated(rows))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    problem = (
        F.when(blank("finished_key"), "no finished key")
        .when(blank("destination_database") | blank("destination_table") | blank("destination_schema"), "no destination")
        .when((F.col("destination_active_part_count") > 0) & (F.coalesce(F.size("destination_active_partition_counts"), F.lit(0)) <= 0), "no partition counts")
    )
    return own.select("job_id", "part_id", problem.alias("problem")).filter("problem is not null")


def reset_plan(rows: DataFrame, compaction: bool) -> DataFrame:
    """job_id, part_id, action, status: compactions' outputs go, originals go back."""
    made = generated(rows)
    target = "COMPACT_READY" if compaction else "READY"
    return rows.select("job_id", "part_id", F.when(made, "delete").otherwise("reset").alias("action"), F.when(made, None).otherwise(target).alias("status"))


def reset_prefixes(rows: DataFrame, compaction: bool) -> DataFrame:
    """bucket, prefix of the data a reset deletes: compactions' outputs, and without `compaction` all rewritten parts."""
    own = rows.filter(generated(rows)) if compaction else rows
    return own.filter((F.trim(F.coalesce("bucket", F.lit(""))) != "") & (F.trim(F.coalesce("finished_key", F.lit(""))) != "")).select("bucket", F.col("finished_key").alias("prefix")).distinct().orderBy("bucket", "prefix")
