"""Queries over the engine's rules: DDL, transitions, sizing, timing, configuration, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import config, sizing
from loomstone.operators import compact, metrics, state, status
from loomstone.operators import parts as ops

from . import ddl, fixtures
from .each import each
from .fixtures import DUCKDB, NOW
from .queries_rewrite import EVENTS, EVENTS_SELECT, _scratch, _table
from .registry import query

_OWN_ENGINE = "CASE p_partkey % 4 WHEN 0 THEN 'MergeTree' WHEN 1 THEN concat('ReplacingMergeTree(v', p_partkey, ')') WHEN 2 THEN 'MergeTree' ELSE concat('SummingMergeTree((v', p_partkey, ', w))') END"
_HEAD = "concat('CREATE TABLE `db`.`', replace(p_name, ' ', '``'), '`"
_BODY = " (k Int64, s String DEFAULT ''x, ENGINE = (y)'') ENGINE = '"


def _statement(row: dict) -> str:
    """A CREATE TABLE statement of a part: four kinds of engine, a quoted name, and a string that looks like a clause."""
    k = row["p_partkey"]
    engine = [f"ReplicatedMergeTree('/zone/{k}', '{{replica}}')", f"ReplicatedReplacingMergeTree('/zone/a,b', '{{replica}}', v{k})", "MergeTree", f"SummingMergeTree((v{k}, w))"][k % 4]
    name = row["p_name"].replace(" ", "``")
    return f"CREATE TABLE `db`.`{name}` (k Int64, s String DEFAULT 'x, ENGINE = (y)') ENGINE = {engine} PARTITION BY (a, b) ORDER BY k;  "


def _statements(spark, sf_dir):
    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), lambda r: r | {"statement": _statement(r)}, "p_partkey long, p_name string, statement string")


@query("ddl_normalized", f"SELECT p_partkey, {_HEAD}{_BODY}, {_OWN_ENGINE}, ' PARTITION BY (a, b) ORDER BY k') AS statement FROM part")
def ddl_normalized(spark, sf_dir):
    """Statements without replication and last semicolon, all else as it was (rows 14, 15, 18, 19)."""
    return each(_statements(spark, sf_dir), lambda r: {"p_partkey": r["p_partkey"], "statement": ddl.normalized(r["statement"])}, "p_partkey long, statement string")


@query(
    "ddl_rejected",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'no engine' WHEN 1 THEN 'other family' WHEN 2 THEN 'too few arguments' WHEN 3 THEN 'too few arguments' ELSE 'accepted' END AS verdict FROM part",
)
def ddl_rejected(spark, sf_dir):
    """Statements whose engine can't be used, by reason (row 15)."""
    engines = ["", " ENGINE = Log", " ENGINE = ReplicatedMergeTree", " ENGINE = ReplicatedMergeTree('/only/a/path')", " ENGINE = MergeTree()"]
    reasons = {"no ENGINE": "no engine", "isn't of": "other family", "needs a path": "too few arguments"}

    def judged(row):
        try:
            ddl.normalized(f"CREATE TABLE t{row['p_partkey']} (x Int8){engines[row['p_partkey'] % 5]}")
            verdict = "accepted"
        except ValueError as e:
            verdict = next(v for k, v in reasons.items() if k in str(e))
        return {"p_partkey": row["p_partkey"], "verdict": verdict}

    return each(_table(spark, sf_dir, "part").select("p_partkey"), judged, "p_partkey long, verdict string")


@query("ddl_retargeted", f"SELECT p_partkey, concat('CREATE TABLE `new``db`.`t', p_partkey, '`{_BODY}, {_OWN_ENGINE}, ' PARTITION BY (a, b) ORDER BY k') AS statement FROM part")
def ddl_retargeted(spark, sf_dir):
    """The same statements for another table (rows 16, 21)."""
    return each(_statements(spark, sf_dir), lambda r: {"p_partkey": r["p_partkey"], "statement": ddl.retargeted(ddl.normalized(r["statement"]), "new`db", f"t{r['p_partkey']}")}, "p_partkey long, statement string")


@query("ddl_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'db' ELSE '' END AS database, replace(p_name, ' ', '`') AS name, p_partkey % 2 = 0 AS destination FROM part")
def ddl_names(spark, sf_dir):
    """Names in statements, with and without a database, and whether they can be a destination (rows 17, 20, 21)."""

    def named(row):
        text = row["statement"] if row["p_partkey"] % 2 == 0 else row["statement"].replace("`db`.", "IF NOT EXISTS ", 1)
        database, name = ddl.table_name(text)
        try:
            whole = ddl.destination(text) == (database, name)
        except ValueError:
            whole = False
        return {"p_partkey": row["p_partkey"], "database": database, "name": name, "destination": whole}

    return each(_statements(spark, sf_dir), named, "p_partkey long, database string, name string, destination boolean")


@query("ddl_arguments", "SELECT p_partkey, CAST(p_partkey % 4 + 2 AS INTEGER) AS n, concat('f(a, ''', p_name, ','')') AS first, CASE WHEN p_partkey % 4 > 0 THEN concat('x', p_partkey % 4 - 1) ELSE concat('`', p_size, ',`') END AS last FROM part")
def ddl_arguments(spark, sf_dir):
    """Arguments between commas outside quotes and parentheses (row 18)."""

    def split(row):
        k = row["p_partkey"]
        found = ddl.split_arguments(f" f(a, {ddl.literal(row['p_name'] + ',')}) , `{row['p_size']},`" + "".join(f", x{i}" for i in range(k % 4)))
        return {"p_partkey": k, "n": len(found), "first": found[0], "last": found[-1]}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), split, "p_partkey long, n int, first string, last string")


@query("ddl_keyword", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE length(p_name) + 29 END AS INTEGER) AS at FROM part")
def ddl_keyword(spark, sf_dir):
    """Where a keyword stands outside quotes, comments and parentheses, as a whole word (row 19)."""

    def found(row):
        text = f"/* engine */ x_engine '{row['p_name']}' " + ("(engine)" if row["p_partkey"] % 3 == 0 else "(a) eNgInE b")
        return {"p_partkey": row["p_partkey"], "at": ddl.find_keyword(text, "ENGINE")}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), found, "p_partkey long, at int")


@query("ddl_quoting", "SELECT n_nationkey, '`' || replace(n_name, 'A', '``') || '`' AS name, '''' || replace(replace(n_name, 'I', ''''''), 'E', '\\') || '''' AS value FROM nation")
def ddl_quoting(spark, sf_dir):
    """Names and literals in quotes (row 21)."""
    return each(
        _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        lambda r: {"n_nationkey": r["n_nationkey"], "name": ddl.quoted(r["n_name"].replace("A", "`")), "value": ddl.literal(r["n_name"].replace("I", "'").replace("E", "\\"))}, "n_nationkey int, name string, value string",
    )


@query("replaced_rows", "SELECT o_custkey AS k, max(o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def replaced_rows(spark, sf_dir):
    """Of rows with one sort key the row of the largest version, as an engine's merges leave it (row 22)."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("status"))
    return compact.replaced(rows, ddl.TableSpec("db", "t", rows.schema, sort_by=("k",), engine="ReplacingMergeTree(v)"))


@query("query_settings", "SELECT 'UTC' AS before, 'Asia/Tokyo' AS inside, 'UTC' AS after, '2024-01-01 09:00:00' AS shown")
def query_settings(spark, sf_dir):
    """Settings for one query's time; the old ones come back (row 12)."""
    name = "spark.sql.session.timeZone"
    with config.settings(spark, spark__sql__session__timeZone="UTC"):
        before = spark.conf.get(name)
        with config.settings(spark, spark__sql__session__timeZone="Asia/Tokyo"):
            inside = spark.conf.get(name)
            shown = spark.sql("SELECT cast(timestamp_micros(1704067200000000) AS string) AS t").first()["t"]
        after = spark.conf.get(name)
    return spark.createDataFrame([(before, inside, after, shown)], "before string, inside string, after string, shown string")


@query("staged_twice", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS amount_text, CAST(ts AS DATE) AS event_date, CAST(1 AS SMALLINT) AS migrated FROM events WHERE value > 10")
def staged_twice(spark, sf_dir):
    """A part written anew after a first try that wrote other rows: nothing of that is left (row 34)."""
    from loomstone.operators.rewrite import read_staged, rewritten, staged

    path, events = _scratch(spark), _table(spark, sf_dir, "events")
    staged(rewritten(events.filter("event_id % 3 = 0"), EVENTS_SELECT.replace("value > 10", "value <= 10"), EVENTS), EVENTS, path, allow_empty=True)
    return read_staged(spark, staged(rewritten(events, EVENTS_SELECT, EVENTS), EVENTS, path), EVENTS)


@query("duplicate_part_names", "SELECT 'part-' || (p_partkey % 1500) AS name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_part_names(spark, sf_dir):
    """Names that more than one part has (row 35)."""
    return ops.duplicate_names(_table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), (F.col("p_partkey") % 1500).cast("string")).alias("name")))


@query("batch_defaults", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 2 ELSE p_partkey % 4 END AS BIGINT) AS least, CAST(CASE p_size WHEN 0 THEN 99 ELSE least(p_size * 3, 99) END AS BIGINT) AS most FROM part UNION ALL SELECT -1, 2, 8")
def batch_defaults(spark, sf_dir):
    """Bounds of a batch: zero parts means two, zero artifacts no bound but that of a commit; the defaults are in the row of -1 (row 72)."""

    def bounds(row):
        k = row["p_partkey"]
        found = compact.Options() if k < 0 else compact.Options(min_parts=k % 4, max_artifacts=row["p_size"] * 3)
        return {"p_partkey": k, "least": found.least, "most": found.most}

    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_size").unionAll(spark.createDataFrame([(-1, 0)], "p_partkey long, p_size int"))
    return each(rows, bounds, "p_partkey long, least long, most long")


_CPUS = "CAST(p_size AS BIGINT)"


@query(
    "merge_sizing",
    f"WITH l AS (SELECT p_partkey, {_CPUS} AS c, (p_partkey % 200 + 1) * 1073741824 AS m FROM part), b AS (SELECT *, least(greatest(m * 60 // 100 // c // 8, 4194304), 268435456) // 1048576 * 1048576 AS block FROM l)"
    " SELECT p_partkey, block AS block_bytes, least(greatest(block // 1024, 8192), 262144) // 8192 * 8192 AS block_rows, greatest(13, c) AS pool, greatest(2, c) AS concurrency, greatest(1, 256 // c) AS transfers, CAST(greatest(8, c * 3) AS VARCHAR) AS shuffle FROM b",
)
def merge_sizing(spark, sf_dir):
    """Sizes of a merge, transfers a worker, and shuffle partitions, by CPUs and memory (rows 33, 109, 132)."""

    def sized(row):
        found = sizing.Limits(row["p_size"], (row["p_partkey"] % 200 + 1) * sizing.GIB)
        return {"p_partkey": row["p_partkey"], **sizing.merge_settings(found), "transfers": sizing.transfer_workers(found.cpus), "shuffle": sizing.spark_settings(found)["spark.sql.shuffle.partitions"]}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), sized, "p_partkey long, block_bytes long, block_rows long, pool long, concurrency long, transfers long, shuffle string")


@query(
    "resource_limits",
    "WITH l AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS host, (p_partkey % 64 + 1) * 1073741824 AS memory, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE greatest(1, (p_partkey % 9) * 150000 // 100000) END AS quota, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 6 + 2 END AS own, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 31 + 1) * 1000000000 END AS most FROM part)"
    " SELECT p_partkey, least(host, coalesce(quota, host), coalesce(own, host)) AS cpus, least(memory, coalesce(most, memory)) AS memory FROM l",
)
def resource_limits(spark, sf_dir):
    """CPUs and memory: the least of the host's, the quota, the set of CPUs and the memory limit (row 130)."""

    def found(row):
        k = row["p_partkey"]
        quota = "max 100000" if k % 3 == 0 else f"{k % 9 * 150000} 100000\n"
        cpuset = "" if k % 4 == 0 else f"0-{k % 6},{k % 6 + 7}\n"
        memory = "max\n" if k % 5 == 0 else f"{(k % 31 + 1) * 10**9}\n"
        out = sizing.limits(row["p_size"], (k % 64 + 1) * sizing.GIB, quota, cpuset, memory)
        return {"p_partkey": k, "cpus": out.cpus, "memory": out.memory}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), found, "p_partkey long, cpus long, memory long")


@query("insert_retries", "SELECT p_partkey, list_aggregate(list_filter(list_transform(range(0, p_partkey % 5 + 1), lambda i: p_size // CAST(pow(2, i) AS BIGINT)), lambda x: x >= 1), 'string_agg', ',') AS threads, CAST(CASE WHEN p_partkey % 8 >= 5 THEN 10 WHEN p_partkey % 8 < 1 THEN 1 ELSE pow(2, p_partkey % 8 - 1) END AS BIGINT) AS wait FROM part")
def insert_retries(spark, sf_dir):
    """Threads of a rewrite's tries when memory runs out, and the wait before the next (row 120)."""

    def tries(row):
        return {"p_partkey": row["p_partkey"], "threads": ",".join(map(str, sizing.retry_threads(row["p_size"], row["p_partkey"] % 5 + 1))), "wait": sizing.retry_wait(row["p_partkey"] % 8)}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), tries, "p_partkey long, threads string, wait long")


@query(
    "waits",
    "WITH w AS (SELECT p_partkey, CAST(p_partkey % 9000 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) * 20 AS y FROM part) SELECT p_partkey, greatest(x, 300.0) AS stale, least(greatest(greatest(x, 300.0) / 20, 30.0), 300.0) AS heartbeat, CASE WHEN y % 40 = 0 THEN least(x, 300.0) ELSE x END AS source_wait,"
    " CASE WHEN x <= 0 THEN 0.0 ELSE least(greatest(x / 4, 1.0), y) END AS settle, CASE WHEN y % 60 = 0 THEN y ELSE greatest(0.0, least(y, x - 100)) END AS left_ FROM w",
)
def waits(spark, sf_dir):
    """Leases, heartbeats, caps and deadlines (rows 122, 127, 128)."""

    def waited(row):
        x, y = float(row["p_partkey"] % 9000), row["p_size"] * 20.0
        stale = sizing.stale_after(x)
        return {
            "p_partkey": row["p_partkey"], "stale": stale, "heartbeat": sizing.heartbeat(stale), "source_wait": sizing.source_wait_cap(x, y % 40 == 0), "settle": sizing.settle_wait(x, y),
            "left_": sizing.wait_until_deadline(y, 100.0, None if y % 60 == 0 else x),
        }

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), waited, "p_partkey long, stale double, heartbeat double, source_wait double, settle double, left_ double")


@query("claim_splay", "SELECT p_partkey, TRUE AS within FROM part")
def claim_splay(spark, sf_dir):
    """Random waits before a claim stay within their window; without one there is none (row 123)."""
    from loomstone.streaming.worker import splay

    def within(row):
        window = row["p_size"] * (row["p_partkey"] % 3 - 1)
        found = [splay(window) for _ in range(20)]
        return {"p_partkey": row["p_partkey"], "within": all(0 <= x <= max(0, window) / 1000 for x in found) and (window <= 9 or len(set(found)) > 1)}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), within, "p_partkey long, within boolean")


@query("worker_roles", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'unknown' WHEN p_partkey % 4 = 2 AND p_size % 2 = 0 THEN 'nothing to do' ELSE ['all', 'inserter', 'compactor'][p_partkey % 4 + 1] END AS role FROM part")
def worker_roles(spark, sf_dir):
    """Roles of workers with and without compaction (row 119)."""
    from loomstone.streaming.worker import check_role

    def checked(row):
        try:
            role = check_role(["all", "inserter", "compactor", "both"][row["p_partkey"] % 4], row["p_size"] % 2 == 1)
        except ValueError as e:
            role = "nothing to do" if "nothing to do" in str(e) else "unknown"
        return {"p_partkey": row["p_partkey"], "role": role}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), checked, "p_partkey long, role string")


@query("progress_gate", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 + 19 // (p_size % 7) END AS passed FROM part")
def progress_gate(spark, sf_dir):
    """Reports that pass in twenty seconds with one asked for each second: the first, then one an interval (rows 124, 159)."""

    def passed(row):
        now = [0.0]
        gate, n = metrics.Gate(row["p_size"] % 7, lambda: now[0]), 0
        for second in range(20):
            now[0] = float(second)
            n += gate()
        return {"p_partkey": row["p_partkey"], "passed": n}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), passed, "p_partkey long, passed int")


@query("stage_timer", "SELECT p_partkey, CAST(p_size * 1000 + 250 AS BIGINT) AS a, CAST(p_partkey % 9 * 500 AS BIGINT) AS b, CAST(p_size * 1000 + 250 + p_partkey % 9 * 500 + 125 AS BIGINT) AS total, CAST(125 AS BIGINT) AS running FROM part")
def stage_timer(spark, sf_dir):
    """Times of stages, of which one comes again, while a third runs (row 125)."""

    def timed(row):
        now = [0.0]
        timer = metrics.StageTimer(lambda: now[0])
        for stage, seconds in (("a", row["p_size"]), ("b", row["p_partkey"] % 9 / 2), ("a", 0.25), ("c", 0.125)):
            timer.start(stage)
            now[0] += seconds
        found = timer.progress()
        return {"p_partkey": row["p_partkey"], "a": found["rewrite_stage_durations_ms"]["a"], "b": found["rewrite_stage_durations_ms"]["b"], "total": found["rewrite_total_elapsed_ms"], "running": found["rewrite_stage_elapsed_ms"]}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), timed, "p_partkey long, a long, b long, total long, running long")


@query("config_resolution", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 100 ELSE p_size + 200 END AS max_rows, p_partkey % 2 = 0 AS dry_run, 'rest' || p_size AS rest FROM part")
def config_resolution(spark, sf_dir):
    """Values of a command line over those of a section over those at the top; unknown flags go with their value (row 134)."""
    from dataclasses import make_dataclass

    def resolved(row):
        import logging

        logging.getLogger(config.__name__).setLevel(logging.ERROR)
        kind = make_dataclass("Own", [("max_rows", int, 0), ("dry_run", bool, False)])
        k, n = row["p_partkey"], row["p_size"]
        words = ["--unknown", "value", *([f"--max-rows={n}"] if k % 3 == 0 else []), "--dry-run=" + ("yes" if k % 2 == 0 else "no"), f"rest{n}"]
        flags, rest = config.parse_flags(words, {"max_rows", "dry_run"})
        own = config.resolve(kind, flags, {"max-rows": str(n + 100)} if k % 3 == 1 else {}, {"max_rows": n + 200, "section": {"max_rows": 1}})
        return {"p_partkey": k, "max_rows": own.max_rows, "dry_run": own.dry_run, "rest": ",".join(rest)}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), resolved, "p_partkey long, max_rows int, dry_run boolean, rest string")


_ORDER = "['claim', 'compact_ready', 'release', 'fail', 'claim_compaction', 'release_compaction', 'supersede', 'finalize', 'import', 'imported', 'retry', 'progress', 'compact_progress', 'request_finalize', 'reset_compact_timer', 'force_retry']"
_EVENT = f"{_ORDER}[CAST(part_rows % 16 AS INTEGER) + 1]"


def _rows(spark, sf_dir):
    """Rows of the state as the log has them, with an event for each."""
    found = fixtures.state(spark, sf_dir)
    return found.select("job_id", "part_id", "status", "worker_id", "bucket", "source_key", "finished_key", "destination_active_part_rows", "read_rows", "compact_output_part_id", F.expr(f"{_ORDER.replace('[', 'array(').replace(']', ')')}[cast(destination_active_part_rows % 16 AS int)]").alias("event"))


def _row(r: dict) -> dict:
    own = {k: r[k] for k in ("status", "worker_id", "read_rows", "compact_output_part_id")}
    return state.new_row(r["job_id"], r["part_id"], r["bucket"], r["source_key"], r["finished_key"], "t0", **own, error="e", started_at="t0", compact_ready_at="t0" if r["status"] == "COMPACT_READY" else None)


@query(
    "transitions",
    DUCKDB + f", e AS (SELECT job_id, part_id, status, {_EVENT} AS event FROM st) SELECT job_id, part_id, event, CASE WHEN event = 'claim' AND status = 'READY' THEN 'IN_PROGRESS' WHEN event = 'compact_ready' AND status = 'IN_PROGRESS' THEN 'COMPACT_READY'"
    " WHEN event = 'release' AND status = 'IN_PROGRESS' THEN 'READY' WHEN event = 'fail' AND status IN ('IN_PROGRESS', 'IMPORTING') THEN 'FAILED' WHEN event = 'claim_compaction' AND status = 'COMPACT_READY' THEN 'COMPACTING' WHEN event = 'release_compaction' AND status = 'COMPACTING' THEN 'COMPACT_READY'"
    " WHEN event = 'supersede' AND status = 'COMPACTING' THEN 'SUPERSEDED' WHEN event = 'finalize' AND status = 'COMPACT_READY' THEN 'FINISHED' WHEN event = 'import' AND status = 'FINISHED' THEN 'IMPORTING' WHEN event = 'imported' AND status = 'IMPORTING' THEN 'IMPORTED'"
    " WHEN event = 'retry' AND status = 'FAILED' THEN 'READY' WHEN event = 'progress' AND status = 'IN_PROGRESS' THEN status WHEN event IN ('compact_progress', 'request_finalize') AND status = 'COMPACTING' THEN status WHEN event = 'reset_compact_timer' THEN status WHEN event = 'force_retry' THEN 'READY' ELSE 'illegal' END AS becomes FROM e",
)
def transitions(spark, sf_dir):
    """What each row becomes by an event, or that it can't (rows 129, 146, 150)."""

    def stepped(r):
        try:
            becomes = state.transition(_row(r), r["event"], "t1", r["worker_id"])["status"]
        except state.IllegalTransition:
            becomes = "illegal"
        return {"job_id": r["job_id"], "part_id": r["part_id"], "event": r["event"], "becomes": becomes}

    return each(_rows(spark, sf_dir), stepped, "job_id string, part_id string, event string, becomes string")


@query("released_parts", DUCKDB + "SELECT job_id, part_id, 'READY' AS status, 'STATUS#READY' AS gsi1pk, '' AS worker_id, '' AS started_at, CAST(-1 AS BIGINT) AS read_rows, 't1' AS updated_at FROM st WHERE status = 'IN_PROGRESS'")
def released_parts(spark, sf_dir):
    """Parts that a stopped worker gives back: what told of their progress is gone (rows 126, 149)."""

    def released(r):
        found = state.transition(_row(r), "release", "t1", r["worker_id"])
        return {k: found[k] or "" for k in ("job_id", "part_id", "status", "gsi1pk", "worker_id", "started_at", "updated_at")} | {"read_rows": -1 if found["read_rows"] is None else found["read_rows"]}

    schema = "job_id string, part_id string, status string, gsi1pk string, worker_id string, started_at string, updated_at string, read_rows long"
    return each(_rows(spark, sf_dir).filter("status = 'IN_PROGRESS'"), released, schema)


@query("reset_timers", DUCKDB + "SELECT job_id, part_id, status, 't1' AS compact_ready_at FROM st WHERE job_id = 'job-0002' OR job_id = 'job-0007'")
def reset_timers(spark, sf_dir):
    """The compact window of every row of some jobs begins anew, whatever its status (row 141)."""

    def reset(r):
        found = state.transition(_row(r), "reset_compact_timer", "t1")
        return {k: found[k] for k in ("job_id", "part_id", "status", "compact_ready_at")}

    return each(_rows(spark, sf_dir).filter("job_id in ('job-0002', 'job-0007')"), reset, "job_id string, part_id string, status string, compact_ready_at string")


@query(
    "compact_progress",
    DUCKDB + ", p AS (SELECT job_id, part_id, part_rows % 5 AS i, part_bytes % 5 AS o FROM st WHERE status = 'COMPACTING') SELECT job_id, part_id, CASE WHEN o > i THEN -1 ELSE CAST(i AS BIGINT) END AS inputs, CASE WHEN o > i THEN -1 ELSE CAST(o AS BIGINT) END AS outputs FROM p",
)
def compact_progress(spark, sf_dir):
    """Progress written on rows of running compactions; more parts out than in is an error (row 147)."""

    def written(r):
        counts = {"compact_input_part_count": r["destination_active_part_rows"] % 5, "compact_output_part_count": r["bytes"] % 5}
        try:
            found = state.transition(_row(r), "compact_progress", "t1", r["worker_id"], **counts)
            return {"job_id": r["job_id"], "part_id": r["part_id"], "inputs": found["compact_input_part_count"], "outputs": found["compact_output_part_count"]}
        except state.IllegalTransition:
            return {"job_id": r["job_id"], "part_id": r["part_id"], "inputs": -1, "outputs": -1}

    rows = _rows(spark, sf_dir).join(fixtures.state(spark, sf_dir).select("part_id", F.col("destination_active_part_bytes").alias("bytes")), "part_id")
    return each(rows.filter("status = 'COMPACTING'"), written, "job_id string, part_id string, inputs long, outputs long")


@query(
    "compact_rows",
    DUCKDB + "SELECT job_id, output_id AS part_id, 'COMPACT_READY' AS status, 'JOB#' || job_id AS pk, 'PART#' || output_id AS sk, 'stage/' || output_id AS source_key, 'stage/' || output_id AS finished_key, array_to_string(inputs, ',') AS inputs, CAST(1 AS INTEGER) AS generation FROM outputs",
)
def compact_rows(spark, sf_dir):
    """Rows of compactions' outputs, with their inputs; the source is the finished part (row 145)."""

    def made(r):
        key = f"stage/{r['output']}"
        found = state.new_row(r["job_id"], r["output"], "b", key, key, "t0", status="COMPACT_READY", compact_generation=1, compact_input_part_ids=sorted(r["inputs"]), compact_ready_at="t0")
        return {k: found[k] for k in ("job_id", "part_id", "status", "pk", "sk", "source_key", "finished_key")} | {"inputs": ",".join(found["compact_input_part_ids"]), "generation": found["compact_generation"]}

    rows = fixtures.lineage(spark, sf_dir).groupBy("job_id", "output").agg(F.collect_list("input").alias("inputs"))
    return each(rows, made, "job_id string, part_id string, status string, pk string, sk string, source_key string, finished_key string, inputs string, generation int")


@query(
    "metric_events",
    DUCKDB + ", v AS (SELECT job_id, part_id, part_rows FROM st WHERE status = 'READY'), e AS (SELECT job_id, 'rewrite_started' AS event, 0 AS s FROM v UNION ALL SELECT job_id, CASE WHEN part_rows % 3 = 0 THEN 'rewrite_failed' ELSE 'rewrite_completed' END, 60 + part_rows FROM v"
    " UNION ALL SELECT job_id, 'compaction_started', 30 FROM v WHERE part_rows % 3 = 1 UNION ALL SELECT job_id, CASE WHEN part_rows % 2 = 0 THEN 'compaction_completed' ELSE 'compaction_without_gain' END, 10 FROM v WHERE part_rows % 3 = 1) SELECT job_id, event, CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS seconds FROM e GROUP BY ALL",
)
def metric_events(spark, sf_dir):
    """What the steps of parts count as: rewrites and compactions started, done, failed or without gain, with times (rows 135, 156)."""
    rows = fixtures.state(spark, sf_dir).filter("status = 'READY'").select("job_id", "part_id", F.col("destination_active_part_rows").alias("n"))
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    steps = [
        (F.lit(True), F.lit("READY"), F.lit(0)), (F.lit(True), F.lit("IN_PROGRESS"), F.lit(0)), (F.lit(True), F.when(F.col("n") % 3 == 0, "FAILED").otherwise("COMPACT_READY"), 60 + F.col("n")),
        (F.col("n") % 3 == 1, F.lit("COMPACTING"), 90 + F.col("n")), (F.col("n") % 3 == 1, F.when(F.col("n") % 2 == 0, "SUPERSEDED").otherwise("COMPACT_READY"), 100 + F.col("n")),
    ]
    versions = None
    for k, (has, to, seconds) in enumerate(steps):
        own = rows.filter(has).select("job_id", "part_id", F.lit(k).alias("version"), to.alias("status"), at(seconds).alias("at"))
        versions = own if versions is None else versions.unionAll(own)
    return metrics.events(versions)


_READY_FOR = "CAST(greatest(0, epoch(TIMESTAMP '{0}') - epoch(coalesce(s.compact_ready_at, s.progress_updated_at, s.updated_at))) AS BIGINT) * 1000".format(NOW)


def _reported(spark, sf_dir):
    """The state with all that the reports show."""
    rows = fixtures.state(spark, sf_dir)
    spent = F.when(F.col("destination_active_part_rows") % 2 == 0, F.create_map(F.lit("wait_merges"), F.col("destination_active_part_bytes") * 900, F.lit("insert_select"), F.col("destination_active_part_rows")))
    more = {
        "attempts": F.lit(1), "source_active_part_rows": F.col("read_rows"), "rewrite_stage_durations_ms": spent, "rewrite_stage_started_at": F.lit(None).cast("string"),
        "rewrite_stage_elapsed_ms": F.col("destination_active_part_rows") * 100, "rewrite_total_elapsed_ms": F.col("destination_active_part_rows") * 3700,
    }
    return rows.withColumns(more).withColumns({c: F.col(c).cast("string") for c in ("progress_updated_at", "updated_at", "compact_ready_at")})


def _shown(x: str) -> str:
    from .queries_state import _SHOWN

    return _SHOWN.format(x)


@query(
    "part_rows_report",
    DUCKDB + f", w AS (SELECT s.*, CAST(CASE WHEN part_rows % 2 = 0 THEN part_bytes * 900 WHEN rewrite_stage = 'wait_merges' THEN part_rows * 100 END AS BIGINT) AS waited, {_READY_FOR} AS since FROM st s),"
    " t AS (SELECT job_id, part_id, CASE WHEN count(*) = 1 THEN max(partition_id) ELSE string_agg(partition_id || ':' || n, ',' ORDER BY partition_id) END AS partitions FROM entries GROUP BY ALL)"
    " SELECT part_id, w.status, CAST(1 AS BIGINT) AS attempts, worker_id AS worker, CAST(read_rows AS BIGINT) AS read_rows, CASE WHEN read_bytes >= 1024 THEN CASE WHEN read_bytes % 1024 = 0 THEN (read_bytes // 1024) || '' ELSE printf('%.1f', read_bytes / 1024.0) END || ' KB' ELSE read_bytes || ' B' END AS read_size,"
    " CAST(written_rows AS BIGINT) AS written_rows, written_bytes || ' B' AS written_size, CAST(read_rows AS BIGINT) AS source_rows, CAST(part_rows AS BIGINT) AS dest_rows,"
    " CAST(CASE WHEN w.status = 'SUPERSEDED' THEN 0 WHEN w.status = 'COMPACTING' AND compact_input_part_count > 0 THEN compact_input_part_count ELSE greatest(source_active_part_count, 1) END AS BIGINT) AS input_parts,"
    " CAST(CASE WHEN w.status IN ('SUPERSEDED', 'READY') THEN 0 WHEN w.status = 'COMPACTING' AND compact_input_part_count > 0 THEN compact_output_part_count ELSE destination_active_part_count END AS BIGINT) AS output_parts,"
    f" CASE WHEN w.status IN ('READY', 'IN_PROGRESS') THEN '' ELSE partitions END AS partitions, CAST(coalesce(destination_failed_merges, 0) AS BIGINT) AS failed_merges, CASE WHEN waited IS NULL THEN '' ELSE {_shown('waited')} END AS settle_wait,"
    f" CASE WHEN w.status = 'COMPACT_READY' THEN {_shown('since')} ELSE '' END AS compact_ready_for, coalesce(CAST(progress_updated_at AS VARCHAR), '') AS progress_at, CAST(updated_at AS VARCHAR) AS updated_at, coalesce(error, '') AS error FROM w JOIN t USING (job_id, part_id)",
)
def part_rows_report(spark, sf_dir):
    """The report over parts: progress, sizes, partitions, waits and errors (row 155)."""
    return status.row_report(_reported(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query(
    "part_details_report",
    DUCKDB + ", d AS (SELECT *, CAST(part_rows * 100 AS BIGINT) AS e, CAST(part_rows * 3700 AS BIGINT) AS t, CAST(part_bytes * 900 AS BIGINT) AS m, CAST(part_rows AS BIGINT) AS i FROM st)"
    f" SELECT part_id, status, CAST(1 AS BIGINT) AS attempts, worker_id AS worker, coalesce(rewrite_stage, '') AS stage, CASE WHEN rewrite_stage IS NULL THEN '' ELSE {_shown('e')} END AS stage_elapsed, CASE WHEN rewrite_stage IS NULL THEN '' ELSE {_shown('t')} END AS total_elapsed, '' AS stage_started,"
    f" coalesce(CAST(progress_updated_at AS VARCHAR), '') AS progress_at, CAST(updated_at AS VARCHAR) AS updated_at, CASE WHEN part_rows % 2 = 0 THEN 'insert_select=' || {_shown('i')} || ',wait_merges=' || {_shown('m')} ELSE '' END AS stage_durations, coalesce(error, '') AS error FROM d",
)
def part_details_report(spark, sf_dir):
    """The report over parts' stages (row 155)."""
    return status.detail_report(_reported(spark, sf_dir))


@query("failure_diagnosis", "SELECT p_partkey, 'can''t read ' || p_name || chr(10) || 'into db.t' || p_partkey || chr(10) || 'select: ' || substring(repeat('SELECT ' || p_name || ' ', 60), 1, 1000) AS error FROM part")
def failure_diagnosis(spark, sf_dir):
    """What a failed part's row says: the error, the destination and the select, cut (row 158)."""
    from loomstone.streaming.worker import diagnosis

    def told(row):
        spec = ddl.TableSpec("db", f"t{row['p_partkey']}", T.StructType())
        return {"p_partkey": row["p_partkey"], "error": diagnosis(ValueError(f"can't read {row['p_name']}"), f"SELECT {row['p_name']} " * 60, spec)}

    return each(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), told, "p_partkey long, error string")


@query(
    "admin_commands",
    "SELECT * FROM (VALUES ('retry', 'p00,p03,p06,p09'), ('set', 'p01'), ('reset', 'p01,p02,p04,p05,p07,p08,p10,p11'), ('deleted', 'c1'), ('left', 'READY=10'), ('refused', 'yes')) AS v(command, parts)",
)
def admin_commands(spark, sf_dir):
    """Commands one after another on one log: retry, set, reset with its deletions in one commit, delete, and a refusal (row 133)."""
    from loomstone.operators.admin import Admin, Refused
    from loomstone.operators.state import StateLog, new_row, transition

    log = StateLog(spark, f"{_scratch(spark)}/log", every=4)
    admin, now = Admin(log), state.timestamp()
    parts = [new_row("j", f"p{i:02d}", "b", f"s/{i}", f"stage/jobs/j/finished/p{i:02d}", now) for i in range(12)]
    log.commit([transition(p, "claim", now, "w") for p in parts])
    rows = log.get("j")
    log.commit([transition(r, "fail" if i % 3 == 0 else "compact_ready", now, "w") for i, r in enumerate(rows)])
    done = [("retry", admin.retry("j", all_failed=True)), ("set", admin.set_state("j", "READY", ["p01"], force=True))]
    inputs = ["p02", "p04"]
    log.apply("j", inputs, "claim_compaction", worker="w", compact_output_part_id="c1")
    held = log.get("j", inputs)
    made = new_row("j", "c1", "b", "f", "stage/jobs/j/finished/c1", now, status="COMPACT_READY", compact_generation=1, compact_input_part_ids=inputs)
    log.commit([made, *(transition(r, "supersede", now, "w", superseded_by="c1") for r in held)])
    commits = log.refresh()
    found = admin.reset("j", False, force=True)
    if log.refresh() != commits + 1:
        raise AssertionError("a reset is one commit")
    done += [("reset", [p for p in sorted(found["reset"]) if p not in ("p00", "p03", "p06", "p09")]), ("deleted", found["deleted"])]
    admin.delete_parts("j", parts=["p10", "p11"], force=True)
    counts = {r["status"]: r["n"] for r in status.status_counts(log.view()).collect() if r["n"]}
    done.append(("left", [f"{k}={v}" for k, v in sorted(counts.items())]))
    try:
        admin.delete_parts("j", all_parts=True)
        done.append(("refused", ["no"]))
    except Refused:
        done.append(("refused", ["yes"]))
    return spark.createDataFrame([(c, ",".join(p)) for c, p in done], "command string, parts string")
