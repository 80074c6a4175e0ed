"""Queries over parts: statistics, mergeability, listings, identifiers, sizes, metrics, streams."""

from __future__ import annotations


from pyspark.sql import functions as F


from loomstone.functions import ids, sizing, text
from loomstone.operators import metrics
from loomstone.operators import parts as ops
from loomstone.sources import manifest


from . import fixtures
from .fixtures import DUCKDB
from .each import each
from .queries_rewrite import EVENTS, _scratch, _table
from .registry import query

BIG = "CAST(coalesce(sum({0}), 0) AS BIGINT) AS {0}"
_COUNTS = f"CAST(count(*) AS BIGINT) AS part_count, {BIG.format('part_rows')}, {BIG.format('part_bytes')}"


@query("part_stats_total", DUCKDB + f"SELECT {_COUNTS} FROM parts WHERE partition_id > 199500")
def part_stats_total(spark, sf_dir):
    """Count, rows and bytes of the active parts of the partitions that the WHERE clause keeps (row 38)."""
    return ops.totals(fixtures.parts(spark, sf_dir).filter("partition_id > 199500"))


@query("part_stats_all", DUCKDB + f"SELECT {_COUNTS} FROM parts")
def part_stats_all(spark, sf_dir):
    """The same of all active parts (row 38)."""
    return ops.totals(fixtures.parts(spark, sf_dir))


@query("part_stats_of_none", DUCKDB + f"SELECT {_COUNTS} FROM parts WHERE partition_id < 0")
def part_stats_of_none(spark, sf_dir):
    """The same without parts: one row of zeros (row 38)."""
    return ops.totals(fixtures.parts(spark, sf_dir).filter("partition_id < 0"))


@query("part_stats_by_partition", DUCKDB + f"SELECT partition_id, {_COUNTS} FROM parts GROUP BY partition_id")
def part_stats_by_partition(spark, sf_dir):
    """The same by partition (row 39)."""
    return ops.by_partition(fixtures.parts(spark, sf_dir))


@query("part_stats_rollup", DUCKDB + f"SELECT coalesce(partition_id, 0) AS partition_id, {_COUNTS} FROM parts GROUP BY ROLLUP (partition_id)")
def part_stats_rollup(spark, sf_dir):
    """Partitions and the total, here of partition 0, at once (row 40)."""
    return ops.rolled_up(fixtures.parts(spark, sf_dir)).withColumn("partition_id", F.coalesce("partition_id", F.lit(0).cast("long")))


@query("part_snapshot", DUCKDB + "SELECT CAST(count(*) AS BIGINT) AS part_count, CAST(sum(part_bytes) AS BIGINT) AS part_bytes, max(part_bytes) AS largest FROM parts")
def part_snapshot(spark, sf_dir):
    """Count, bytes and the largest part (row 41)."""
    return ops.snapshot(fixtures.parts(spark, sf_dir))


@query(
    "snapshot_changes",
    DUCKDB + ", a AS (SELECT partition_id, count(*) AS n, sum(part_bytes) AS b FROM parts GROUP BY 1), z AS (SELECT partition_id, count(*) AS n, sum(part_bytes) AS b FROM parts WHERE source_part <> 'part-0003' OR partition_id % 2 = 0 GROUP BY 1)"
    " SELECT coalesce(a.partition_id, z.partition_id) AS partition_id FROM a FULL JOIN z ON a.partition_id = z.partition_id WHERE a.n IS DISTINCT FROM z.n OR a.b IS DISTINCT FROM z.b",
)
def snapshot_changes(spark, sf_dir):
    """Partitions that differ between two snapshots (row 42)."""
    parts = fixtures.parts(spark, sf_dir)
    return ops.changed(ops.by_partition(parts), ops.by_partition(parts.filter("source_part <> 'part-0003' or partition_id % 2 = 0")), "partition_id", "part_count", "part_bytes")


@query(
    "mergeable_smallest_two",
    DUCKDB + "SELECT partition_id, CAST(sum(part_bytes) AS BIGINT) AS smallest_two FROM (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY part_bytes) AS rn, count(*) OVER (PARTITION BY partition_id) AS n FROM parts) WHERE rn <= 2 AND n >= 2 GROUP BY partition_id HAVING sum(part_bytes) <= 28000",
)
def mergeable_smallest_two(spark, sf_dir):
    """Partitions whose two smallest parts fit the target together (row 43)."""
    return ops.mergeable_pairs(fixtures.parts(spark, sf_dir), 28000)


@query("mergeable_partitions", DUCKDB + f"SELECT partition_id, {_COUNTS} FROM parts GROUP BY partition_id HAVING count(*) > 1 AND sum(part_bytes) <= 330000")
def mergeable_partitions(spark, sf_dir):
    """Partitions that fit the target as a whole (rows 29, 44)."""
    return ops.mergeable_partitions(fixtures.parts(spark, sf_dir), 330000)


@query(
    "merge_decisions",
    DUCKDB + ", p AS (SELECT partition_id, count(*) AS n, sum(part_bytes) AS b, list_sum(list_slice(list(part_bytes ORDER BY part_bytes), 1, 2)) AS two FROM parts GROUP BY 1)"
    " SELECT partition_id, CASE WHEN n <= 1 THEN 'settled_parts' WHEN two > 28000 THEN 'settled_target' WHEN b <= 330000 THEN 'merge' ELSE 'compact' END AS decision FROM p",
)
def merge_decisions(spark, sf_dir):
    """What remains to do for each partition (row 121). Pairs are judged by a smaller target than wholes, so that all outcomes occur."""
    parts = fixtures.parts(spark, sf_dir)
    whole = ops.mergeable_partitions(parts, 330000).select("partition_id", F.lit(True).alias("whole"))
    own = ops.settled(parts, 28000).join(whole, "partition_id", "left")
    return own.select("partition_id", F.when(F.col("decision").startswith("settled"), F.col("decision")).when(F.col("whole"), "merge").otherwise("compact").alias("decision"))


_LOG = "log AS (SELECT 'db-' || CAST(user_id % 4 AS VARCHAR) AS database, 't-' || CAST(event_id % 3 AS VARCHAR) AS \"table\", CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'MergeParts' ELSE 'NewPart' END AS event_type, CASE WHEN event_id % 7 = 0 THEN 241 ELSE 0 END AS error FROM events)"


def _part_log(spark, sf_dir):
    """The events as a log of parts: database, table, event_type, error."""
    events = _table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    kind = F.when(F.col("event_type") == first, "MergeParts").otherwise("NewPart")
    error = F.when(F.col("event_id") % 7 == 0, 241).otherwise(0)
    return events.select(F.concat(F.lit("db-"), (F.col("user_id") % 4).cast("string")).alias("database"), F.concat(F.lit("t-"), (F.col("event_id") % 3).cast("string")).alias("table"), kind.alias("event_type"), error.alias("error"))


@query("active_merge_count", f"WITH {_LOG} SELECT CAST(count(*) AS BIGINT) AS n FROM log WHERE event_type = 'MergeParts' AND database = 'db-1' AND \"table\" = 't-2'")
def active_merge_count(spark, sf_dir):
    """Merges of one table (row 45)."""
    return ops.merges_running(_part_log(spark, sf_dir).filter("event_type = 'MergeParts'"), "db-1", "t-2")


@query("failed_merge_count", f"WITH {_LOG} SELECT CAST(count(*) AS BIGINT) AS n FROM log WHERE event_type = 'MergeParts' AND error <> 0 AND database = 'db-1' AND \"table\" = 't-2'")
def failed_merge_count(spark, sf_dir):
    """Merges of one table that failed (row 46)."""
    return ops.merges_failed(_part_log(spark, sf_dir), "db-1", "t-2")


_PROGRESS = "CAST(read_rows AS BIGINT) AS read_rows, CAST(read_bytes AS BIGINT) AS read_bytes, CAST(written_rows AS BIGINT) AS written_rows, CAST(written_bytes AS BIGINT) AS written_bytes"


@query(
    "progress_lookup",
    DUCKDB + ", q(query_id) AS (SELECT min(part_id) FROM st WHERE status = 'IN_PROGRESS' UNION ALL SELECT min(part_id) FROM st WHERE status = 'FINISHED' UNION ALL SELECT 'nowhere')"
    f" SELECT query_id, CASE status WHEN 'IN_PROGRESS' THEN 'running' WHEN 'FINISHED' THEN 'finished' ELSE 'unknown' END AS state, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ops.PROGRESS)} FROM q LEFT JOIN st ON part_id = query_id",
)
def progress_lookup(spark, sf_dir):
    """Progress of a query that runs, of one that has ended, and of one that nothing knows (row 47)."""
    rows = fixtures.state(spark, sf_dir).withColumn("query_id", F.col("part_id"))
    running, finished = rows.filter("status = 'IN_PROGRESS'"), rows.filter("status = 'FINISHED'")
    out = None
    for query_id in (running.agg(F.min("query_id")).first()[0], finished.agg(F.min("query_id")).first()[0], "nowhere"):
        found = ops.progress_of(running, finished, query_id)
        out = found if out is None else out.unionAll(found)
    return out


@query("latest_query_log", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'view') WHERE rn = 1")
def latest_query_log(spark, sf_dir):
    """The last log row of each key (row 48)."""
    log = _table(spark, sf_dir, "events").filter("event_type <> 'view'").select("user_id", "event_id", "event_type", "ts")
    return ops.latest(log, "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("latest_one", "SELECT event_id, ts::VARCHAR AS ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_one(spark, sf_dir):
    """The last row of all: a top-1 (row 48)."""
    return _table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", F.col("ts").cast("string").alias("ts"))


@query("databases_sorted", f"WITH {_LOG} SELECT DISTINCT database AS name FROM log")
def databases_sorted(spark, sf_dir):
    """Names in order (rows 37, 49)."""
    return ops.names(_part_log(spark, sf_dir), "database")


@query("tables_not_in", "SELECT r_name AS database, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def tables_not_in(spark, sf_dir):
    """A listing without some databases, in order of two keys (row 50)."""
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ops.tables(both.select(F.col("r_name").alias("database"), F.col("n_name").alias("name")), ["ASIA", "EUROPE"])


@query("element_at_first", "SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN embedding[1] END AS first FROM embeddings")
def element_at_first(spark, sf_dir):
    """The first element of an array, counted from one; null where there is none (row 51)."""
    paths = F.when(F.col("vec_id") % 5 > 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 0))
    return ops.first_path(_table(spark, sf_dir, "embeddings").select("vec_id", paths.alias("paths")), "paths").select("vec_id", "first")


_DISKS = [("default", "/var/lib/"), ("cold", "/var/lib/cold/"), ("colder", "/var/lib/cold/er/"), ("other", "/mnt/x")]


@query(
    "longest_prefix_disk",
    "WITH d(disk, p) AS (VALUES " + ", ".join(str(d) for d in _DISKS) + "), f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN '/var/lib/' WHEN 1 THEN '/var/lib/cold/' WHEN 2 THEN '/var/lib/cold/er/' ELSE '/mnt/xy/' END || p_partkey AS path FROM part)"
    " SELECT path, coalesce((SELECT disk FROM d WHERE starts_with(path, rtrim(p, '/') || '/') OR path = p ORDER BY length(p) DESC LIMIT 1), 'none') AS disk FROM f",
)
def longest_prefix_disk(spark, sf_dir):
    """The disk whose path is the longest that holds a file (row 52)."""
    root = F.when(F.col("p_partkey") % 4 == 0, "/var/lib/").when(F.col("p_partkey") % 4 == 1, "/var/lib/cold/").when(F.col("p_partkey") % 4 == 2, "/var/lib/cold/er/").otherwise("/mnt/xy/")
    files = _table(spark, sf_dir, "part").select(F.concat(root, F.col("p_partkey").cast("string")).alias("path"))
    return ops.longest_prefix(files, spark.createDataFrame(_DISKS, "disk string, disk_path string")).withColumn("disk", F.coalesce("disk", F.lit("none")))


@query("require_empty", "SELECT count(*) = 0 AS empty FROM events WHERE value < -1e18")
def require_empty(spark, sf_dir):
    """Whether a table has no rows; reads no more than one (row 53)."""
    return spark.createDataFrame([(ops.is_empty(_table(spark, sf_dir, "events").filter("value < -1e18")),)], "empty boolean")


@query("schema_capture", "SELECT column_name AS name, lower(column_type) AS type, CAST(row_number() OVER () AS INTEGER) AS place FROM (DESCRIBE SELECT n_nationkey, n_name, n_regionkey, CAST(1.5 AS DOUBLE) AS share, DATE '2024-01-01' AS day FROM nation)")
def schema_capture(spark, sf_dir):
    """A source's columns with their types, in order (rows 54, 57)."""
    from .ddl import columns_of

    names = {"integer": "integer", "int": "integer", "long": "bigint", "string": "varchar"}
    source = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(1.5).alias("share"), F.lit("2024-01-01").cast("date").alias("day"))
    return spark.createDataFrame([(n, names.get(t, t), k) for n, t, k in columns_of(source)], "name string, type string, place int")


@query("parts_by_disk", "WITH d(disk) AS (VALUES ('a'), ('b'), ('c'), ('z')) SELECT disk, CAST(count(p_partkey) AS BIGINT) AS n FROM d LEFT JOIN (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS disk FROM part) USING (disk) GROUP BY disk")
def parts_by_disk(spark, sf_dir):
    """Parts of each disk, also of those that have none (row 107)."""
    disk = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "b").otherwise("c")
    return ops.count_by_disk(_table(spark, sf_dir, "part").select(disk.alias("disk")), spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "disk string"))


@query("short_hash_ids", "SELECT n_nationkey, substring(sha256(n_name || chr(0) || CAST(n_regionkey AS VARCHAR) || chr(0)), 1, 16) AS id FROM nation")
def short_hash_ids(spark, sf_dir):
    """Ids from a hash of values (part and job ids)."""
    return _table(spark, sf_dir, "nation").select("n_nationkey", ids.short_hash_column(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("id"))


@query(
    "compact_ids",
    DUCKDB + "SELECT output_id, 'compact-' || substring(sha256('3' || chr(0) || array_to_string(list_transform(inputs, lambda x: x || chr(0)), '')), 1, 16) AS id FROM outputs",
)
def compact_ids(spark, sf_dir):
    """Ids of compactions from their inputs in any order."""
    found = fixtures.lineage(spark, sf_dir).groupBy(F.col("output").alias("output_id")).agg(F.collect_list("input").alias("inputs"))
    return found.select("output_id", ids.compact_id_column(F.lit(3), F.col("inputs")).alias("id"))


_SIZE = "CAST(o_orderkey AS BIGINT) * o_orderkey * (o_orderkey % 4) * 64 - CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 0 END"


@query(
    "byte_formatting",
    f"WITH b AS (SELECT o_orderkey, {_SIZE} AS v FROM orders), u AS (SELECT *, CAST(floor(log2(greatest(v, 1)) / 10) AS INTEGER) AS k FROM b), s AS (SELECT *, CAST(v AS DOUBLE) / pow(1024, k) AS x FROM u)"
    " SELECT o_orderkey, CASE WHEN v < 0 THEN CAST(v AS VARCHAR) ELSE CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%.1f', x) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'][k + 1] END AS shown FROM s",
)
def byte_formatting(spark, sf_dir):
    """Byte counts as text (row 105)."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.bytes_text(F.expr(_SIZE)).alias("shown"))


@query("rates", "SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / (o_custkey % 5) ELSE 0.0 END AS rate FROM orders")
def rates(spark, sf_dir):
    """Amounts a second, zero without time (row 106)."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.rate(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("rate"))


@query("insert_sizing", "WITH l AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 3 AS c, (p_partkey % 700 + 1) * 1073741824 AS m FROM part) SELECT p_partkey, greatest(1, least(c // 4, (m * 70 // 100) // 12884901888)) AS threads, (m * 70 // 100) // (6 * greatest(1, least(c // 4, (m * 70 // 100) // 12884901888))) AS block_bytes FROM l")
def insert_sizing(spark, sf_dir):
    """Threads and block of a rewrite by CPUs and memory (row 131)."""

    def sized(row):
        found = sizing.insert_settings(sizing.Limits(row["p_size"] * 3, (row["p_partkey"] % 700 + 1) * sizing.GIB))
        return {"p_partkey": row["p_partkey"], "threads": found["threads"], "block_bytes": found["block_bytes"]}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), sized, "p_partkey long, threads long, block_bytes long")


@query("metric_deltas", "SELECT event_id, greatest(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0) AS delta FROM events")
def metric_deltas(spark, sf_dir):
    """Growth of a counter from sample to sample (row 135)."""
    return metrics.deltas(_table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "delta")


@query(
    "metric_histogram",
    "WITH b AS (SELECT unnest(list_transform(range(0, 16), lambda k: pow(2.0, k)) || ['Infinity'::DOUBLE]) AS le), t AS (SELECT DISTINCT event_type FROM events)"
    " SELECT t.event_type, b.le, CAST((SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= b.le) AS BIGINT) AS n FROM t, b",
)
def metric_histogram(spark, sf_dir):
    """Values at most each power of two (row 135)."""
    return metrics.histogram(_table(spark, sf_dir, "events"), F.col("value"), "event_type")


@query("metric_gauges", DUCKDB + "SELECT CASE status WHEN 'IN_PROGRESS' THEN 'insert' ELSE 'compact' END AS role, job_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(part_bytes) AS BIGINT) AS bytes FROM st WHERE status IN ('IN_PROGRESS', 'COMPACTING') GROUP BY ALL")
def metric_gauges(spark, sf_dir):
    """Parts at work by role and job (rows 135, 156)."""
    return metrics.gauges(fixtures.state(spark, sf_dir))


@query("manifest_round_trip", DUCKDB + "SELECT part_id, job_id, bucket, source_key, CAST(1 AS INTEGER) AS version FROM st")
def manifest_round_trip(spark, sf_dir):
    """Manifests written as JSON and read again (rows 111, 112)."""
    rows = fixtures.state(spark, sf_dir)
    form = rows.select(
        F.lit(1).alias("version"), "job_id", "part_id", F.lit("f").alias("freeze"), F.struct(F.lit("db").alias("database"), F.lit("s").alias("table")).alias("source"),
        F.struct(F.lit("db").alias("database"), F.col("destination_table").alias("table")).alias("dest"), F.struct(F.lit("default").alias("disk"), F.col("part_id").alias("name"), F.col("part_id").alias("relative_path")).alias("part"),
        F.struct(F.lit("s").alias("source_schema"), F.lit("d").alias("destination_schema"), F.lit("i").alias("insert_select")).alias("sql"),
        F.struct("bucket", "source_key", "finished_key").alias("s3"), F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("created_at"),
    )
    checked = manifest.checked(manifest.from_text(manifest.to_text(form)), rows)
    return checked.filter("problem is null and same").select("part_id", "job_id", "s3.bucket", "s3.source_key", "version")


@query(
    "manifest_problems",
    "SELECT CAST(o_orderkey AS VARCHAR) AS part_id, CASE WHEN o_orderkey % 5 = 0 THEN 'version isn''t 1' WHEN o_orderkey % 7 = 0 THEN 'source.table is missing' WHEN o_orderkey % 11 = 0 THEN 'sql.insert_select is missing' ELSE 's3.finished_key is missing' END AS problem"
    " FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
)
def manifest_problems(spark, sf_dir):
    """What manifests lack, the first of each (row 111)."""
    key = F.col("o_orderkey")
    part = key.cast("string")
    one = lambda k, bad, good: F.when(key % k == 0, bad).otherwise(good)
    form = F.struct(
        one(5, 2, 1).alias("version"), F.lit("j").alias("job_id"), part.alias("part_id"), F.struct(one(7, F.lit(None).cast("string"), F.lit("s")).alias("table")).alias("source"),
        F.struct(F.lit("d").alias("database"), F.lit("t").alias("table")).alias("dest"), F.struct(F.lit("n").alias("name")).alias("part"),
        F.struct(F.lit("x").alias("destination_schema"), one(11, " ", "i").alias("insert_select")).alias("sql"), F.struct(F.lit("b").alias("bucket"), F.lit("k").alias("source_key"), one(13, "", "f").alias("finished_key")).alias("s3"),
    )
    return manifest.problems(manifest.from_text(_table(spark, sf_dir, "orders").select(F.to_json(form).alias("manifest"))))


@query("directory_stats", "SELECT CAST(5 AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS part_rows, TRUE AS same_bytes FROM orders")
def directory_stats(spark, sf_dir):
    """Files, rows and bytes of a folder of five files: the listing's bytes are the files' own (rows 23, 24, 113)."""
    root = _scratch(spark)
    _table(spark, sf_dir, "orders").repartition(5).write.parquet(root)
    return ops.directory_stats(spark, root).select("files", "part_rows", ((F.col("bytes") == F.col("read_bytes")) & (F.col("bytes") > 0)).alias("same_bytes"))


@query("stream_rewrite", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS amount_text, CAST(ts AS DATE) AS event_date, CAST(1 AS SMALLINT) AS migrated FROM events WHERE value > 10")
def stream_rewrite(spark, sf_dir):
    """The flagship rewrite as a file stream, batch by batch, ended when all files are done (row 118)."""
    from loomstone.streaming.worker import stream, streamed

    root = _scratch(spark)
    events = _table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(f"{root}/in")
    job = stream(spark, f"{root}/in", events.schema, lambda df: df.filter("value > 10").selectExpr("event_id", "event_type", "cast(user_id AS string)", "cast(ts AS date)", "cast(1 AS short)"), EVENTS, f"{root}/out", f"{root}/checkpoint")
    job.awaitTermination(600)
    return streamed(spark, f"{root}/out", EVENTS)


@query("worker_end_to_end", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS amount_text, CAST(ts AS DATE) AS event_date, CAST(1 AS SMALLINT) AS migrated FROM events WHERE value > 10")
def worker_end_to_end(spark, sf_dir):
    """Register files, rewrite part by part, join parts, finish, import, and read the final table (rows 23-36, 108, 115, 118)."""
    from loomstone.operators.importer import import_finished, registered, submit
    from loomstone.operators.rewrite import read_staged
    from loomstone.operators.state import StateLog
    from loomstone.streaming.worker import Worker

    root = _scratch(spark)
    _table(spark, sf_dir, "events").repartition(3).write.parquet(f"{root}/in")
    log = StateLog(spark, f"{root}/state")
    select = lambda df: df.filter("value > 10").selectExpr("event_id", "event_type", "cast(user_id AS string)", "cast(ts AS date)", "cast(1 AS short)")
    submit(log, registered(spark, f"{root}/in", "job-1", "b", "stage", EVENTS, "events"), EVENTS)
    Worker(log, EVENTS, select, root).run()
    import_finished(log, "job-1", EVENTS, root, f"{root}/table")
    return read_staged(spark, f"{root}/table", EVENTS)


