"""Queries over part-state rows: selection, compaction planning, lineage, job analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import ids
from loomstone.operators import compact, selection, state, status

from . import fixtures
from .fixtures import DUCKDB, NOW
from .registry import query

def _now():
    return F.lit(NOW).cast("timestamp_ntz")


_AT = f"TIMESTAMP '{NOW}'"
_G = "job_id, bucket, destination_database"
_NAMED = "trim(destination_database) <> ''"


def _keys(df):
    return df.select("job_id", "part_id")


@query("jobs_by_status", DUCKDB + "SELECT DISTINCT job_id FROM st WHERE status IN ('READY', 'FAILED')")
def jobs_by_status(spark, sf_dir):
    """Jobs that have a part in one of some statuses (rows 61, 136)."""
    return state.distinct_jobs(fixtures.state(spark, sf_dir), ["READY", "FAILED"])


@query("list_jobs", DUCKDB + "SELECT DISTINCT job_id FROM st")
def list_jobs(spark, sf_dir):
    return state.distinct_jobs(fixtures.state(spark, sf_dir))


@query("claim_order", DUCKDB + "SELECT job_id, part_id, CAST(row_number() OVER (ORDER BY updated_at, job_id, part_id) AS BIGINT) AS place FROM st WHERE status = 'READY'")
def claim_order(spark, sf_dir):
    """READY parts of all jobs in the order in which workers take them (rows 59, 60)."""
    return state.claim_order(fixtures.state(spark, sf_dir)).select("job_id", "part_id", "place")


@query("claim_next", DUCKDB + "SELECT job_id, part_id FROM st WHERE status = 'READY' ORDER BY updated_at, job_id, part_id LIMIT 1")
def claim_next(spark, sf_dir):
    """The part that a worker takes next (row 60)."""
    return _keys(state.claim_next(fixtures.state(spark, sf_dir)))


@query("job_parts", DUCKDB + "SELECT part_id, status FROM st WHERE job_id = 'job-0006'")
def job_parts(spark, sf_dir):
    """A job's parts by id (row 62)."""
    return fixtures.state(spark, sf_dir).filter("job_id = 'job-0006'").select("part_id", "status").orderBy("part_id")


@query("finished_parts", DUCKDB + "SELECT job_id, part_id, finished_key FROM st WHERE status = 'FINISHED'")
def finished_parts(spark, sf_dir):
    """Parts ready for import by key (rows 63, 82)."""
    return selection.importable(fixtures.state(spark, sf_dir)).select("job_id", "part_id", "finished_key")


@query("visible_parts", DUCKDB + "SELECT job_id, part_id FROM st WHERE status <> 'SUPERSEDED'")
def visible_parts(spark, sf_dir):
    """Parts without superseded ones (row 83)."""
    return _keys(status.visible(fixtures.state(spark, sf_dir)))


_CANDIDATES = f"candidates AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY compact_generation, updated_at, part_id) AS place FROM st WHERE status = 'COMPACT_READY' AND {_NAMED})"


@query("compact_groups", DUCKDB + f", {_CANDIDATES} SELECT job_id, bucket, part_id, CAST(place AS INTEGER) AS place FROM candidates")
def compact_groups(spark, sf_dir):
    """Candidates of each group in order (row 64)."""
    return compact.candidates(fixtures.state(spark, sf_dir)).select("job_id", "bucket", "part_id", "place")


@query("claim_options", DUCKDB + f"SELECT DISTINCT job_id, part_id FROM entries WHERE status = 'COMPACT_READY' AND {_NAMED} AND bucket = 'bucket-1' AND job_id NOT IN ('job-0002', 'job-0006') AND partition_id IN ('199601', '199702', '199803')")
def claim_options(spark, sf_dir):
    """Candidates of one bucket that touch some partitions, without some jobs (row 65)."""
    options = compact.Options(excluded_jobs=("job-0002", "job-0006"), required_partitions=("199601", "199702", "199803"), match={"bucket": "bucket-1"})
    return _keys(compact.candidates(fixtures.state(spark, sf_dir), options))


@query("busy_partitions", DUCKDB + f"SELECT DISTINCT job_id, bucket, partition_id FROM entries WHERE status = 'COMPACTING' AND {_NAMED}")
def busy_partitions(spark, sf_dir):
    """Partitions that running compactions hold (row 66)."""
    return compact.busy_partitions(fixtures.state(spark, sf_dir)).select("job_id", "bucket", "partition_id")


_RANKED = (
    f"{_CANDIDATES}, ranked AS (SELECT e.job_id, e.bucket, e.partition_id, row_number() OVER (PARTITION BY e.job_id, e.bucket ORDER BY min(c.place), e.partition_id) AS rank"
    " FROM entries e JOIN candidates c ON e.job_id = c.job_id AND e.part_id = c.part_id GROUP BY e.job_id, e.bucket, e.partition_id)"
)


@query("candidate_order", DUCKDB + f", {_RANKED} SELECT job_id, bucket, partition_id, CAST(rank AS INTEGER) AS rank FROM ranked")
def candidate_order(spark, sf_dir):
    """Partitions in the order in which candidates name them (row 67)."""
    own = compact.candidates(fixtures.state(spark, sf_dir))
    return compact.candidate_partitions(own).select("job_id", "bucket", "partition_id", "rank")


@query(
    "idle_and_busy",
    DUCKDB + f", {_RANKED} SELECT r.job_id, r.bucket, r.partition_id, EXISTS (SELECT 1 FROM entries e WHERE e.status = 'COMPACTING' AND trim(e.destination_database) <> '' AND e.job_id = r.job_id AND e.bucket = r.bucket AND e.partition_id = r.partition_id) AS busy FROM ranked r",
)
def idle_and_busy(spark, sf_dir):
    """Candidate partitions and whether they are busy (row 68)."""
    rows = fixtures.state(spark, sf_dir)
    return compact.split_by_busy(compact.candidate_partitions(compact.candidates(rows)), compact.busy_partitions(rows)).select("job_id", "bucket", "partition_id", "busy")


@query(
    "compact_batch_single_partition",
    DUCKDB + f", {_CANDIDATES}, e AS (SELECT e.job_id, e.bucket, e.partition_id, e.part_id, e.n, c.part_bytes, row_number() OVER w AS rn, sum(c.part_bytes) OVER w AS total FROM entries e JOIN candidates c ON e.job_id = c.job_id AND e.part_id = c.part_id"
    " WINDOW w AS (PARTITION BY e.job_id, e.bucket, e.partition_id ORDER BY c.place, e.part_id ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, sum(n) OVER (PARTITION BY job_id, bucket, partition_id) AS s FROM e WHERE rn <= 3 AND (total <= 120 OR rn = 1))"
    " SELECT job_id, bucket, partition_id, part_id, CAST(rn AS INTEGER) AS rn FROM f WHERE s >= 3",
)
def compact_batch_single_partition(spark, sf_dir):
    """The bounded batch of each partition by itself (row 69)."""
    own = compact.partition_entries(compact.candidates(fixtures.state(spark, sf_dir)), "place", "destination_active_part_bytes").withColumnRenamed("destination_active_part_bytes", "bytes")
    return compact.single_partition_fill(own, compact.Options(min_parts=3, max_artifacts=3, max_bytes=120), compact.GROUP).select("job_id", "bucket", "partition_id", "part_id", "rn")


@query("compact_batch_multi_partition")
def compact_batch_multi_partition(spark, sf_dir):
    """The next batch of every group over all its partitions (rows 68, 70); tested case by case and against a plain fold."""
    return compact.batches(fixtures.state(spark, sf_dir), compact.Options(max_bytes=400)).select("job_id", "bucket", "part_id", "seq")


@query(
    "batch_totals",
    DUCKDB + f"SELECT job_id, bucket, CAST(count(*) AS BIGINT) AS inputs, CAST(sum(destination_active_part_count) AS BIGINT) AS parts, CAST(sum(part_rows) AS BIGINT) AS rows, CAST(sum(part_bytes) AS BIGINT) AS bytes, CAST(max(compact_generation) + 1 AS BIGINT) AS generation FROM st WHERE status = 'COMPACT_READY' AND {_NAMED} GROUP BY ALL",
)
def batch_totals(spark, sf_dir):
    """Sums of a batch, and the generation it makes (row 71)."""
    return compact.batch_totals(compact.candidates(fixtures.state(spark, sf_dir))).drop("destination_database", "destination_table", "destination_schema")


@query("stale_leases", DUCKDB + f"SELECT job_id, part_id FROM st WHERE status = 'COMPACTING' AND least(updated_at, compacting_at) <= {_AT} - INTERVAL 36000000 SECOND")
def stale_leases(spark, sf_dir):
    """Compactions whose older time is long past (row 73)."""
    return _keys(compact.stale_leases(fixtures.state(spark, sf_dir), _now(), 36000000))


@query(
    "ready_time",
    DUCKDB + ", t AS (SELECT job_id, part_id, CASE WHEN part_rows % 4 = 0 THEN '  ' WHEN part_rows % 4 = 1 THEN 'first' END AS a, CASE WHEN part_rows % 3 = 0 THEN '' ELSE 'second' END AS b, CASE WHEN part_rows % 5 > 0 THEN 'third' END AS c FROM st)"
    " SELECT job_id, part_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), 'none') AS ready FROM t",
)
def ready_time(spark, sf_dir):
    """Since when a part is ready: the first time, as text, that isn't blank (row 74)."""
    n = F.col("destination_active_part_rows")
    times = {"a": F.when(n % 4 == 0, "  ").when(n % 4 == 1, "first"), "b": F.when(n % 3 == 0, "").otherwise("second"), "c": F.when(n % 5 > 0, "third")}
    rows = fixtures.state(spark, sf_dir).withColumns(times)
    return rows.select("job_id", "part_id", F.coalesce(compact.ready_since("a", "b", "c"), F.lit("none")).alias("ready"))


_AFTER = "after AS (SELECT job_id, max(coalesce(compact_ready_at, progress_updated_at, updated_at)) + INTERVAL 86400 SECOND AS finalize_after FROM st WHERE status IN ('COMPACT_READY', 'COMPACTING') GROUP BY job_id)"


@query("finalize_after", DUCKDB + f", {_AFTER} SELECT job_id, CAST(finalize_after AS VARCHAR) AS finalize_after FROM after")
def finalize_after(spark, sf_dir):
    """When each job's compact window ends (rows 77, 79)."""
    return compact.finalize_after(fixtures.state(spark, sf_dir), 86400).select("job_id", F.col("finalize_after").cast("string").alias("finalize_after"))


@query("window_expired", DUCKDB + f", {_AFTER}, middle AS (SELECT median(finalize_after) AS t FROM after) SELECT job_id FROM after, middle WHERE finalize_after <= t")
def window_expired(spark, sf_dir):
    """Jobs whose window has ended, at a time when half of them have (row 78)."""
    rows = fixtures.state(spark, sf_dir)
    ends = compact.finalize_after(rows, 86400)
    middle = ends.agg(F.median(F.unix_micros(F.col("finalize_after").cast("timestamp"))).alias("t")).select(F.timestamp_micros(F.col("t").cast("long")).cast("timestamp_ntz").alias("t")).first()["t"]
    return compact.window_expired(rows, 86400, F.lit(middle).cast("timestamp_ntz"))


_ISOLATED = (
    "active AS (SELECT * FROM entries WHERE status IN ('COMPACT_READY', 'COMPACTING')), alone AS (SELECT job_id, partition_id FROM active GROUP BY 1, 2 HAVING sum(n) = 1),"
    " isolated AS (SELECT a.job_id, a.part_id FROM active a JOIN alone l ON a.job_id = l.job_id AND a.partition_id = l.partition_id WHERE a.status = 'COMPACT_READY' AND a.destination_active_part_count = 1 AND a.n = 1)"
)


@query("isolated_parts", DUCKDB + f", {_ISOLATED} SELECT job_id, part_id FROM isolated")
def isolated_parts(spark, sf_dir):
    """Parts to which nothing can be joined (row 76)."""
    return compact.isolated(fixtures.state(spark, sf_dir))


_JOBS = "jobs AS (SELECT job_id, bool_or(status IN ('READY', 'IN_PROGRESS', 'FAILED')) AS blocked, bool_or(status = 'COMPACTING') AS running FROM st GROUP BY job_id)"


@query(
    "finalizable_jobs",
    DUCKDB + f", {_ISOLATED}, {_AFTER}, {_JOBS}, own AS (SELECT i.* FROM isolated i JOIN jobs USING (job_id) WHERE NOT blocked) SELECT job_id, part_id FROM own UNION ALL SELECT s.job_id, s.part_id FROM st s JOIN jobs j USING (job_id) JOIN after a USING (job_id)"
    f" WHERE s.status = 'COMPACT_READY' AND NOT blocked AND NOT running AND finalize_after <= {_AT} AND s.job_id NOT IN (SELECT job_id FROM own)",
)
def finalizable_jobs(spark, sf_dir):
    """Parts that may become FINISHED now (rows 75, 152)."""
    return compact.finalizable(fixtures.state(spark, sf_dir), 86400, _now())


@query("retry_selection", DUCKDB + "SELECT job_id, part_id, status FROM st WHERE status IN ('FAILED', 'IN_PROGRESS')")
def retry_selection(spark, sf_dir):
    """Failed parts and those at work (rows 80, 138)."""
    return selection.retry(fixtures.state(spark, sf_dir), in_progress=True).select("job_id", "part_id", "status")


@query("stale_retry", DUCKDB + f"SELECT job_id, part_id FROM st WHERE status = 'IN_PROGRESS' AND progress_updated_at < {_AT} - INTERVAL 300 SECOND")
def stale_retry(spark, sf_dir):
    """Parts at work without progress for long (row 80)."""
    return _keys(selection.stale_retry(fixtures.state(spark, sf_dir), _now(), 300))


@query("selection_by_ids", DUCKDB + "SELECT part_id, status, CAST(list_position(['part-00000007', 'part-00000003', 'part-00000011'], part_id) AS INTEGER) AS asked FROM st WHERE part_id IN ('part-00000007', 'part-00000003', 'part-00000011')")
def selection_by_ids(spark, sf_dir):
    """Parts by id in the order asked for, each once (rows 81, 139, 143)."""
    return selection.by_ids(fixtures.state(spark, sf_dir), ["part-00000007", "part-00000003", "part-00000007", "part-00000011"], strict=False).select("part_id", "status", "asked")


@query("selection_by_status", DUCKDB + "SELECT job_id, part_id FROM st WHERE status = 'COMPACTING' AND compact_output_part_id = 'out-3'")
def selection_by_status(spark, sf_dir):
    """Running compactions of one output (rows 81, 140)."""
    return _keys(selection.compacting(fixtures.state(spark, sf_dir), "out-3"))


@query("lineage_missing_inputs", DUCKDB + "SELECT DISTINCT l.job_id, l.output_id AS part_id FROM lineage l WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.part_id = l.input_id AND st.job_id = l.job_id)")
def lineage_missing_inputs(spark, sf_dir):
    """Compactions with an input that isn't there (row 84)."""
    found = selection.lineage_problems(fixtures.state_with_outputs(spark, sf_dir))
    return _keys(found.filter("problem = 'missing input'")).distinct()


@query(
    "lineage_problems",
    DUCKDB + "SELECT l.job_id, l.output_id AS part_id, 'missing input' AS problem, CAST(count(*) AS BIGINT) AS n FROM lineage l WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.part_id = l.input_id AND st.job_id = l.job_id) GROUP BY ALL"
    " UNION ALL SELECT s.job_id, s.part_id, 'superseded by a part that doesn''t name it', 1 FROM st s WHERE status = 'SUPERSEDED' AND NOT EXISTS (SELECT 1 FROM lineage l WHERE l.output_id = s.superseded_by AND l.input_id = s.part_id)",
)
def lineage_problems(spark, sf_dir):
    """All that doesn't fit in compactions' inputs (row 84)."""
    return selection.lineage_problems(fixtures.state_with_outputs(spark, sf_dir)).groupBy("job_id", "part_id", "problem").agg(F.count("*").alias("n"))


_CHAIN = "chain AS (SELECT 'j' || (CASE WHEN p_partkey < 10 THEN 0 ELSE p_partkey % 3 END) AS job_id, p_partkey AS o, CASE WHEN p_partkey < 10 THEN p_partkey - 1 ELSE p_partkey - 3 END AS i FROM part WHERE p_partkey > 0 AND p_partkey < 40)"


def _chain(spark, sf_dir, input_="CASE WHEN p_partkey < 10 THEN p_partkey - 1 ELSE p_partkey - 3 END"):
    """Chains of parts, each made of another: of 9 generations in one job, which one of 10 goes on from, and of 10 in two others."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 0 and p_partkey < 40")
    job = "concat('j', CASE WHEN p_partkey < 10 THEN 0 ELSE p_partkey % 3 END)"
    return part.selectExpr(f"{job} AS job_id", "concat('c', p_partkey) AS output", f"concat('c', {input_}) AS input")


@query("lineage_depth", f"WITH RECURSIVE {_CHAIN}, below AS (SELECT job_id, o, i, 1 AS depth FROM chain UNION ALL SELECT b.job_id, b.o, c.i, b.depth + 1 FROM below b JOIN chain c ON b.job_id = c.job_id AND b.i = c.o) SELECT job_id, 'c' || o AS output, CAST(max(depth) AS INTEGER) AS depth FROM below GROUP BY ALL")
def lineage_depth(spark, sf_dir):
    """Generations below each output (row 84)."""
    return selection.lineage_depth(_chain(spark, sf_dir))


@query("lineage_cycles", f"WITH {_CHAIN} SELECT job_id, 'c' || o AS output FROM chain WHERE o >= 5 AND (o < 10 OR o % 3 = 0) OR o >= 22 AND o % 3 = 1")
def lineage_cycles(spark, sf_dir):
    """Outputs on a cycle or above one: 5 is made of 7, and 22 of 25 (row 84)."""
    return selection.lineage_cycles(_chain(spark, sf_dir, "CASE WHEN p_partkey = 5 THEN 7 WHEN p_partkey = 22 THEN 25 WHEN p_partkey < 10 THEN p_partkey - 1 ELSE p_partkey - 3 END"))


@query("reset_plan", DUCKDB + "SELECT job_id, part_id, 'reset' AS action, 'READY' AS status FROM st WHERE compact_generation = 0 UNION ALL SELECT job_id, part_id, 'delete', '' FROM st WHERE compact_generation > 0 UNION ALL SELECT job_id, output_id, 'delete', '' FROM outputs")
def reset_plan(spark, sf_dir):
    """What a reset does to each row (rows 85, 142)."""
    return selection.reset_plan(fixtures.state_with_outputs(spark, sf_dir), False).withColumn("status", F.coalesce("status", F.lit("")))


@query("reset_blockers", DUCKDB + "SELECT job_id, part_id, 'import has begun' AS problem FROM st WHERE status IN ('IMPORTING', 'IMPORTED') UNION ALL SELECT job_id, part_id, 'compaction without inputs' FROM st WHERE compact_generation > 0 UNION ALL SELECT job_id, '', 'no original parts' FROM st GROUP BY job_id HAVING sum(CASE WHEN compact_generation = 0 THEN 1 ELSE 0 END) = 0")
def reset_blockers(spark, sf_dir):
    """Why jobs can't be reset (row 85)."""
    return selection.reset_blockers(fixtures.state(spark, sf_dir), False).withColumn("part_id", F.coalesce("part_id", F.lit("")))


@query("reset_preconditions", DUCKDB + "SELECT job_id, part_id, 'no destination' AS problem FROM st WHERE compact_generation = 0 AND trim(destination_database) = ''")
def reset_preconditions(spark, sf_dir):
    """Originals that can't go back to COMPACT_READY (row 86)."""
    return selection.reset_preconditions(fixtures.state(spark, sf_dir))


@query("distinct_prefixes", DUCKDB + "SELECT DISTINCT bucket, finished_key AS prefix FROM st WHERE compact_generation > 0")
def distinct_prefixes(spark, sf_dir):
    """Data that a reset of compactions deletes (row 87)."""
    return selection.reset_prefixes(fixtures.state(spark, sf_dir), True)


@query("job_prefixes", DUCKDB + "SELECT DISTINCT bucket, 'stage/jobs/' || job_id AS prefix FROM st")
def job_prefixes(spark, sf_dir):
    """Folders of each job (rows 87, 144)."""
    return fixtures.state(spark, sf_dir).select("bucket", ids.job_prefix_column(F.col("job_id"), F.col("finished_key")).alias("prefix")).distinct()


@query("job_status_counts", DUCKDB + ", s AS (SELECT unnest(['READY', 'IN_PROGRESS', 'COMPACT_READY', 'COMPACTING', 'SUPERSEDED', 'FINISHED', 'IMPORTING', 'IMPORTED', 'FAILED']) AS status) SELECT j.job_id, s.status, CAST(count(st.part_id) AS BIGINT) AS n FROM (SELECT DISTINCT job_id FROM st) j CROSS JOIN s LEFT JOIN st ON st.job_id = j.job_id AND st.status = s.status GROUP BY ALL")
def job_status_counts(spark, sf_dir):
    """Parts of each job by status, zeros too (row 88)."""
    return status.status_counts(fixtures.state(spark, sf_dir))


@query(
    "job_overall_status",
    DUCKDB + ", c AS (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'IMPORTED') AS im, count(*) FILTER (status = 'SUPERSEDED') AS su, count(*) FILTER (status = 'IMPORTING') AS ing, count(*) FILTER (status = 'FINISHED') AS fi, count(*) FILTER (status IN ('COMPACTING', 'COMPACT_READY')) AS co, count(*) FILTER (status = 'IN_PROGRESS') AS ip FROM st GROUP BY job_id)"
    " SELECT job_id, CASE WHEN f > 0 THEN 'FAILED' WHEN im + su = total THEN 'IMPORTED' WHEN ing > 0 THEN 'IMPORTING' WHEN fi + ing + im + su = total THEN 'READY_FOR_IMPORT' WHEN co > 0 THEN 'COMPACTING' WHEN ip > 0 THEN 'REWRITING' ELSE 'READY' END AS status FROM c",
)
def job_overall_status(spark, sf_dir):
    """One status for each job (row 89)."""
    return status.summary(fixtures.state(spark, sf_dir)).select("job_id", "status")


@query(
    "job_progress",
    DUCKDB + ", c AS (SELECT job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status IN ('COMPACT_READY', 'COMPACTING', 'SUPERSEDED', 'FINISHED', 'IMPORTING', 'IMPORTED')) AS BIGINT) AS rewrite_completed, CAST(count(*) FILTER (status = 'IMPORTED') AS BIGINT) AS import_completed,"
    " CAST(sum(read_rows) AS BIGINT) AS read_rows, CAST(sum(read_bytes) AS BIGINT) AS read_bytes, CAST(sum(written_rows) AS BIGINT) AS written_rows, CAST(sum(written_bytes) AS BIGINT) AS written_bytes, CAST(coalesce(sum(destination_failed_merges), 0) AS BIGINT) AS destination_failed_merges FROM st GROUP BY job_id)"
    " SELECT *, rewrite_completed * 100.0::DOUBLE / total AS rewrite_percent, import_completed * 100.0::DOUBLE / total AS import_percent FROM c",
)
def job_progress(spark, sf_dir):
    """Progress and sums of each job (rows 90-92, 137)."""
    return status.summary(fixtures.state(spark, sf_dir)).drop("status")


@query("input_parts", DUCKDB + "SELECT job_id, CAST(coalesce(sum(CASE WHEN compact_generation = 0 THEN greatest(source_active_part_count, 1) END), 0) AS BIGINT) AS input_parts FROM st GROUP BY job_id")
def input_parts(spark, sf_dir):
    """Source parts of each job (row 93)."""
    return status.input_parts(fixtures.state(spark, sf_dir))


_PARTS = (
    "row_parts AS (SELECT job_id, part_id, status, worker_id, compact_output_part_id, rewrite_stage, CAST(CASE WHEN status = 'SUPERSEDED' THEN 0 WHEN status = 'COMPACTING' AND compact_input_part_count > 0 THEN compact_input_part_count ELSE greatest(source_active_part_count, 1) END AS BIGINT) AS parts_in,"
    " CAST(CASE WHEN status IN ('SUPERSEDED', 'READY') THEN 0 WHEN status = 'COMPACTING' AND compact_input_part_count > 0 THEN compact_output_part_count ELSE destination_active_part_count END AS BIGINT) AS parts_out, status = 'COMPACTING' AND coalesce(compact_input_part_count, 0) > 0 AS running FROM st"
    " UNION ALL SELECT o.job_id, o.output_id, 'COMPACT_READY', NULL, NULL, NULL, CAST(sum(greatest(coalesce(s.destination_active_part_count, 0), 1)) AS BIGINT), max(o.n), FALSE FROM outputs o JOIN lineage l ON l.output_id = o.output_id LEFT JOIN st s ON s.part_id = l.input_id AND s.job_id = l.job_id GROUP BY o.job_id, o.output_id)"
)
_ONCE = "once AS (SELECT * REPLACE (CASE WHEN running AND row_number() OVER (PARTITION BY job_id, worker_id, compact_output_part_id, running ORDER BY part_id) > 1 THEN 0 ELSE parts_in END AS parts_in, CASE WHEN running AND row_number() OVER (PARTITION BY job_id, worker_id, compact_output_part_id, running ORDER BY part_id) > 1 THEN 0 ELSE parts_out END AS parts_out) FROM row_parts)"


@query("row_input_output", DUCKDB + f", {_PARTS} SELECT job_id, part_id, parts_in, parts_out FROM row_parts")
def row_input_output(spark, sf_dir):
    """Parts that went into and came out of each row (row 94)."""
    return status.row_parts(fixtures.state_with_outputs(spark, sf_dir)).select("job_id", "part_id", "parts_in", "parts_out")


@query("batch_counted_once", DUCKDB + f", {_PARTS}, {_ONCE} SELECT job_id, part_id, CAST(parts_in AS BIGINT) AS parts_in, CAST(parts_out AS BIGINT) AS parts_out FROM once")
def batch_counted_once(spark, sf_dir):
    """The same with running batches counted once (row 95)."""
    return status.counted_once(fixtures.state_with_outputs(spark, sf_dir)).select("job_id", "part_id", F.col("parts_in").cast("long").alias("parts_in"), F.col("parts_out").cast("long").alias("parts_out"))


@query("current_output_parts", DUCKDB + f", {_PARTS}, {_ONCE} SELECT job_id, CAST(coalesce(sum(CASE WHEN status NOT IN ('READY', 'SUPERSEDED') THEN parts_out END), 0) AS BIGINT) AS output_parts FROM once GROUP BY job_id")
def current_output_parts(spark, sf_dir):
    """Current output of each job (row 96)."""
    return status.current_output(fixtures.state_with_outputs(spark, sf_dir))


@query("state_part_stats", DUCKDB + f", {_PARTS}, {_ONCE} SELECT job_id, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(parts_in) AS BIGINT) AS parts_in, CAST(sum(parts_out) AS BIGINT) AS parts_out FROM once GROUP BY ALL")
def state_part_stats(spark, sf_dir):
    """Input and output by status (row 97)."""
    return status.by_status(fixtures.state_with_outputs(spark, sf_dir))


@query(
    "stage_histogram",
    DUCKDB + f", h AS (SELECT job_id, coalesce(rewrite_stage, 'unknown') AS stage, count(*) AS n FROM st WHERE status = 'IN_PROGRESS' GROUP BY ALL) SELECT job_id, stage, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY job_id ORDER BY coalesce(list_position({status.STAGES}, stage), 99), stage) AS INTEGER) AS place FROM h",
)
def stage_histogram(spark, sf_dir):
    """Parts at work by stage, in the stages' order (row 98)."""
    return status.stage_histogram(fixtures.state(spark, sf_dir))


@query("failed_parts", DUCKDB + "SELECT job_id, part_id, CAST(updated_at AS VARCHAR) AS updated_at, error FROM st WHERE status = 'FAILED'")
def failed_parts(spark, sf_dir):
    """Failed parts with their errors (row 99)."""
    return status.failed_parts(fixtures.state(spark, sf_dir)).withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "compact_summary",
    DUCKDB + f", {_ISOLATED}, {_AFTER}, c AS (SELECT job_id, count(*) FILTER (status = 'READY') AS r, count(*) FILTER (status = 'IN_PROGRESS') AS ip, count(*) FILTER (status = 'COMPACT_READY') AS cr, count(*) FILTER (status = 'COMPACTING') AS co, count(*) FILTER (status = 'FAILED') AS f FROM st GROUP BY job_id),"
    " b AS (SELECT c.*, finalize_after, concat_ws(', ', CASE WHEN r > 0 THEN 'READY=' || r END, CASE WHEN ip > 0 THEN 'IN_PROGRESS=' || ip END, CASE WHEN co > 0 THEN 'COMPACTING=' || co END, CASE WHEN f > 0 THEN 'FAILED=' || f END) AS blocked_by, job_id IN (SELECT job_id FROM isolated) AND r + ip + f = 0 AS at_once FROM c LEFT JOIN after USING (job_id) WHERE cr + co > 0),"
    f" s AS (SELECT *, CASE WHEN cr = 0 THEN 'waiting_for_compacting' WHEN at_once THEN 'ready' WHEN finalize_after IS NULL THEN 'unknown' WHEN blocked_by <> '' THEN 'blocked' WHEN {_AT} < finalize_after THEN 'waiting' ELSE 'ready' END AS finalize_status FROM b)"
    f" SELECT job_id, CAST(cr AS BIGINT) AS ready, CAST(co AS BIGINT) AS compacting, finalize_status, blocked_by, CASE WHEN finalize_status = 'waiting_for_compacting' THEN -1 WHEN finalize_status = 'ready' THEN 0 ELSE greatest(0, CAST(round(epoch(finalize_after) - epoch({_AT})) AS BIGINT)) END AS seconds_left FROM s",
)
def compact_summary(spark, sf_dir):
    """Whether each job's parts can become FINISHED, and what they wait for (rows 100, 101)."""
    return status.compact_summary(fixtures.state(spark, sf_dir), 86400, _now()).withColumn("seconds_left", F.coalesce("seconds_left", F.lit(-1).cast("long")))


@query("remaining_elapsed", DUCKDB + f"SELECT part_id, greatest(0, CAST(epoch(updated_at) - epoch({_AT}) AS BIGINT)) AS remaining, greatest(0, CAST(epoch({_AT}) - epoch(updated_at) AS BIGINT)) AS elapsed FROM st")
def remaining_elapsed(spark, sf_dir):
    """Seconds to and since a time, never negative (row 101)."""
    return fixtures.state(spark, sf_dir).select("part_id", status.remaining(F.col("updated_at"), _now()).alias("remaining"), status.elapsed(F.col("updated_at"), _now()).alias("elapsed"))


@query("partition_rendering", DUCKDB + "SELECT job_id, part_id, CASE WHEN status IN ('READY', 'IN_PROGRESS') THEN '' WHEN count(*) = 1 THEN max(partition_id) ELSE string_agg(partition_id || ':' || n, ',' ORDER BY partition_id) END AS partitions FROM entries GROUP BY job_id, part_id, status")
def partition_rendering(spark, sf_dir):
    """Partitions as text (row 102)."""
    return status.partitions_text(fixtures.state(spark, sf_dir))


_MS = "CAST(part_rows AS BIGINT) * part_rows * part_bytes * 10"
_SHOWN = (
    "CASE WHEN {0} = 0 THEN '0s' WHEN {0} < 1000 THEN {0} || 'ms' ELSE CASE WHEN {0} >= 3600000 THEN ({0} // 3600000) || 'h' ELSE '' END || CASE WHEN {0} >= 60000 THEN ({0} // 60000 % 60) || 'm' ELSE '' END"
    " || ({0} // 1000 % 60) || CASE WHEN {0} % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'), '0') END || 's' END"
)


@query("stage_durations", DUCKDB + f", m AS (SELECT part_id, {_MS} AS a, CAST(part_bytes AS BIGINT) AS b FROM st) SELECT part_id, 'insert_select=' || {_SHOWN.format('a')} || ',wait_merges=' || {_SHOWN.format('b')} AS durations, b AS settle FROM m")
def stage_durations(spark, sf_dir):
    """Stage times as people read them, and how long a part waited for merges (rows 103, 104)."""
    from loomstone.functions.text import durations_text

    rows_, bytes_ = F.col("destination_active_part_rows"), F.col("destination_active_part_bytes")
    spent = F.create_map(F.lit("wait_merges"), bytes_, F.lit("insert_select"), rows_ * rows_ * bytes_ * 10)
    rows = fixtures.state(spark, sf_dir).withColumn("spent", spent)
    return rows.select("part_id", durations_text(F.col("spent")).alias("durations"), status.settle_wait(F.col("spent"), F.col("rewrite_stage"), F.lit(0).cast("long")).alias("settle"))


@query("state_current_view", DUCKDB + "SELECT job_id, part_id, CASE WHEN part_rows % 2 = 0 THEN 'FAILED' ELSE status END AS status FROM st WHERE part_rows % 5 > 0")
def state_current_view(spark, sf_dir):
    """The latest rows of a log, without deleted ones (rows 62, 143)."""
    first = fixtures.state(spark, sf_dir).select("job_id", "part_id", "status", "destination_active_part_rows").withColumn("version", F.lit(1).cast("long")).withColumn("deleted", F.lit(False))
    second = first.filter("destination_active_part_rows % 2 = 0").withColumns({"status": F.lit("FAILED"), "version": F.lit(2).cast("long")})
    third = first.filter("destination_active_part_rows % 5 = 0").withColumns({"version": F.lit(3).cast("long"), "deleted": F.lit(True)})
    return state.current(first.unionAll(second).unionAll(third)).select("job_id", "part_id", "status")


@query("state_violations", DUCKDB + "SELECT job_id, part_id FROM st WHERE part_rows % 3 = 0")
def state_violations(spark, sf_dir):
    """Rows that lack what every row needs (row 151)."""
    bad = F.when(F.col("destination_active_part_rows") % 3 == 0, F.lit(" ")).otherwise(F.col("bucket"))
    return state.violations(fixtures.state(spark, sf_dir).withColumn("bucket", bad))


@query("progress_merge", DUCKDB + "SELECT job_id, part_id, CASE WHEN part_rows % 2 = 0 THEN part_rows ELSE read_rows END AS read_rows FROM st")
def progress_merge(spark, sf_dir):
    """A partial update of progress (rows 147, 148)."""
    rows = fixtures.state(spark, sf_dir).select("job_id", "part_id", "read_rows", "destination_active_part_rows")
    new = rows.filter("destination_active_part_rows % 2 = 0").select("job_id", "part_id", F.col("destination_active_part_rows").alias("read_rows"))
    return state.merged_progress(rows, new, ["job_id", "part_id"], ["read_rows"]).select("job_id", "part_id", "read_rows")


@query("partition_counts_clean", DUCKDB + "SELECT part_id, CASE WHEN part_rows % 2 = 0 THEN 'none' ELSE '202401:2,202402:' || (part_rows % 3 + 1) END AS counts FROM st")
def partition_counts_clean(spark, sf_dir):
    """Partition counts without blank ids and zeros; none is null (row 154)."""
    rows = F.col("destination_active_part_rows")
    counts = F.create_map(F.lit("202401"), F.when(rows % 2 == 0, 0).otherwise(2).cast("long"), F.lit(" "), F.lit(5).cast("long"), F.lit("202402"), F.when(rows % 2 == 0, 0).otherwise(rows % 3 + 1))
    clean = state.clean_counts_column(counts)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(clean)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return fixtures.state(spark, sf_dir).select("part_id", F.coalesce(F.when(clean.isNotNull(), shown), F.lit("none")).alias("counts"))
