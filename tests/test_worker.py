import pytest
from pyspark.sql import functions as F

from loomstone.operators import compact, parts
from loomstone.operators.importer import NotEmpty, import_finished, registered, submit
from loomstone.operators.metrics import Gate, StageTimer
from loomstone.operators.rewrite import EmptyOutput, positional, read_staged, rewritten, staged
from loomstone.operators.state import StateLog
from loomstone.plans.ddl import TableSpec
from loomstone.plans.guard import NotRowLocal
from loomstone.streaming.worker import Worker, check_role, out_of_memory

SPEC = TableSpec.from_ddl("CREATE TABLE db.t (id Int64, name String, amount_text String, event_date Date, migrated UInt8) ENGINE = MergeTree PARTITION BY toYYYYMM(event_date) ORDER BY (event_date, id)")
SELECT = "SELECT id, name, cast(amount AS string), event_date, cast(1 AS short) FROM source"
ROWS = [(1, "alpha", 10, "2024-01-01"), (2, "bravo", 20, "2024-01-02"), (3, "charlie", 30, "2024-01-03"), (4, "delta", 40, "2024-01-04")]


def source(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, name string, amount long, d string").select("id", "name", "amount", F.to_date("d").alias("event_date"))
    for k in (0, 1):
        df.filter(F.col("id") > 2 if k else F.col("id") <= 2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"file://{tmp_path}/in"


def test_four_rows_from_end_to_end(spark, tmp_path):
    """Two parts of two rows each: rewritten, joined, finished, imported once."""
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    found = registered(spark, path, "j", "b", "stage", SPEC, SELECT)
    assert found.count() == 2 and sorted(r["part_id"] for r in found.collect()) == sorted(r["part_id"] for r in registered(spark, path, "j", "b", "stage", SPEC, SELECT).collect())
    submit(log, found, SPEC)
    worker = Worker(log, SPEC, SELECT, root)
    done = worker.run()
    assert [d.split()[0] for d in done] == ["rewrote", "rewrote", "joined", "finished"]
    assert sorted(r["status"] for r in log.get("j")) == ["FINISHED", "SUPERSEDED", "SUPERSEDED"]
    assert import_finished(log, "j", SPEC, root, f"{root}/table") == 1 and import_finished(log, "j", SPEC, root, f"{root}/table") == 0
    got = [tuple(r)[:3] + (str(r[3]), r[4]) for r in read_staged(spark, f"{root}/table", SPEC).orderBy("id").collect()]
    assert got == [(i, n, str(a), d, 1) for i, n, a, d in ROWS]
    log.apply("j", [r["part_id"] for r in log.get("j") if r["status"] == "IMPORTED"], "set", status="FINISHED")
    with pytest.raises(NotEmpty):
        import_finished(log, "j", SPEC, root, f"{root}/table")


def test_a_failing_part_is_marked(spark, tmp_path):
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)
    assert all(d.startswith("failed") for d in Worker(log, SPEC, SELECT + " WHERE id > 100", root, role="inserter").run())
    assert {(r["status"], "no rows" in r["error"]) for r in log.get("j")} == {("FAILED", True)}


def test_an_empty_select(spark, tmp_path):
    df = spark.read.parquet(source(spark, tmp_path))
    out = rewritten(df.filter("id > 100"), SELECT, SPEC)
    with pytest.raises(EmptyOutput):
        staged(out, SPEC, f"file://{tmp_path}/out")
    assert read_staged(spark, staged(out, SPEC, f"file://{tmp_path}/out", allow_empty=True), SPEC).isEmpty()


def test_writing_again_replaces(spark, tmp_path):
    df = rewritten(spark.read.parquet(source(spark, tmp_path)), SELECT, SPEC)
    for _ in range(2):
        staged(df, SPEC, f"file://{tmp_path}/out")
    assert read_staged(spark, f"file://{tmp_path}/out", SPEC).count() == 4


def test_positions_and_guard(spark):
    df = spark.range(3).selectExpr("id AS a", "id AS b")
    with pytest.raises(ValueError):
        positional(df, SPEC)
    with pytest.raises(NotRowLocal):
        rewritten(df, lambda d: d.groupBy("a").count(), SPEC)


def test_joining_is_refused_where_it_gains_nothing(spark, tmp_path):
    df = rewritten(spark.read.parquet(source(spark, tmp_path)), SELECT, SPEC)
    one, other = (staged(df.filter(c).withColumn("event_date", F.expr(d)), SPEC, f"file://{tmp_path}/{n}") for n, c, d in (("a", "id <= 2", "event_date"), ("b", "id > 2", "date '2024-05-01'")))
    assert compact.joined(spark, [one, other], f"file://{tmp_path}/c", SPEC)["accepted"] is False
    assert compact.joined(spark, [one], f"file://{tmp_path}/d", SPEC)["accepted"] is False


def test_replacing_rows(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k long, v long, t string")
    spec = lambda engine: TableSpec("d", "t", rows.schema, sort_by=("k",), engine=engine)
    assert sorted(tuple(r) for r in compact.replaced(rows, spec("ReplacingMergeTree(v)")).collect()) == [(1, 3, "c"), (2, 1, "x")]
    assert compact.replaced(rows, spec("ReplacingMergeTree")).count() == 2 and compact.replaced(rows, spec("MergeTree")).count() == 4


def test_a_stopped_worker_gives_its_part_back(spark, tmp_path):
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)

    def stop(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Worker(log, SPEC, stop, root).run()
    assert {r["status"] for r in log.get("j")} == {"READY"}


def test_registry(spark, tmp_path):
    found = parts.registry(spark, source(spark, tmp_path))
    assert found.count() == 2 and parts.duplicate_names(found).isEmpty() and parts.duplicate_names(found.unionAll(found)).count() == 2


def test_small_things():
    assert check_role("all", False) == "all"
    for bad in (("compactor", False), ("other", True)):
        with pytest.raises(ValueError):
            check_role(*bad)
    assert out_of_memory("java.lang.OutOfMemoryError: heap") and not out_of_memory("syntax")
    now = [0.0]
    timer, gate = StageTimer(lambda: now[0]), Gate(15, lambda: now[0])
    timer.start("a")
    now[0] = 2
    timer.start("b")
    now[0] = 5
    assert timer.progress() == {"rewrite_stage": "b", "rewrite_stage_elapsed_ms": 3000, "rewrite_total_elapsed_ms": 5000, "rewrite_stage_durations_ms": {"a": 2000}}
    timer.start("a")
    now[0] = 6
    assert timer.finish() == {"a": 3000, "b": 3000}
    assert gate() and not gate()
    now[0] = 30
    assert gate() and not Gate(0)()


def test_two_workers_never_take_one_part(spark, tmp_path):
    """Two drivers' logs over one folder: claims that meet are told apart by the commit, and all parts are rewritten once."""
    from concurrent.futures import ThreadPoolExecutor

    from loomstone.operators.state import new_row, timestamp

    path = f"file://{tmp_path}/log"
    StateLog(spark, path).commit([new_row("j", f"p{i:02d}", "b", "s", "f", timestamp()) for i in range(12)])
    logs = [StateLog(spark, path, every=4) for _ in range(2)]

    def take(k):
        taken = []
        while rows := logs[k].claim(f"w{k}", 2):
            taken += [r["part_id"] for r in rows]
        return taken

    with ThreadPoolExecutor(2) as pool:
        taken = list(pool.map(take, (0, 1)))
    assert sorted(taken[0] + taken[1]) == [f"p{i:02d}" for i in range(12)]
    rows = StateLog(spark, path, every=4).get("j")
    assert all(r["status"] == "IN_PROGRESS" and r["part_id"] in taken[int(r["worker_id"][1])] and r["attempts"] == 1 for r in rows)


def test_a_worker_stops_after_the_steps_it_is_given_and_goes_on(spark, tmp_path):
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)
    worker = Worker(log, SPEC, SELECT, root, slots=1)
    assert [d.split()[0] for d in worker.run(most=1)] == ["rewrote"]
    assert [d.split()[0] for d in worker.run()] == ["rewrote", "joined", "finished"]


def test_import_stops_at_the_first_error_and_goes_on_later(spark, tmp_path):
    from loomstone.operators.admin import Admin
    from loomstone.operators.importer import ImportFailed

    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)
    Worker(log, SPEC, SELECT, root, compaction=False).run()
    rows = log.get("j")
    assert [r["status"] for r in rows] == ["FINISHED"] * 2
    last = max(rows, key=lambda r: r["finished_key"])
    broken = f"{tmp_path}/work/{last['finished_key']}"
    __import__("os").rename(broken, broken + "-away")
    with pytest.raises(ImportFailed):
        import_finished(log, "j", SPEC, root, f"{root}/table")
    assert sorted(r["status"] for r in log.get("j")) == ["FAILED", "IMPORTED"]
    __import__("os").rename(broken + "-away", broken)
    Admin(log).retry("j", all_failed=True)
    assert import_finished(log, "j", SPEC, root, f"{root}/table") == 1
    assert read_staged(spark, f"{root}/table", SPEC).count() == 4
    # found IMPORTING after a crash: attached again, without doubles
    log.apply("j", [last["part_id"]], "set", status="FINISHED")
    log.apply("j", [last["part_id"]], "import")
    assert import_finished(log, "j", SPEC, root, f"{root}/table") == 1 and read_staged(spark, f"{root}/table", SPEC).count() == 4


def test_a_request_ends_a_compaction(spark, tmp_path, monkeypatch):
    """Asked for while parts are joined: the output is FINISHED at once, whatever the window."""
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)
    join = compact.joined

    def joined(*args, **more):
        log.apply("j", [r["part_id"] for r in log.get("j") if r["status"] == "COMPACTING"], "request_finalize")
        return join(*args, **more)

    monkeypatch.setattr(compact, "joined", joined)
    done = Worker(log, SPEC, SELECT, root, window=10**6).run()
    assert [d.split()[0] for d in done] == ["rewrote", "rewrote", "joined"]
    assert sorted(r["status"] for r in log.get("j")) == ["FINISHED", "SUPERSEDED", "SUPERSEDED"]


def test_joining_keeps_files_to_the_target(spark, tmp_path):
    df = rewritten(spark.read.parquet(source(spark, tmp_path)), SELECT, SPEC)
    one, other = (staged(df.filter(c), SPEC, f"file://{tmp_path}/{n}") for n, c in (("a", "id <= 2"), ("b", "id > 2")))
    size = spark.read.option("recursiveFileLookup", "true").parquet(one, other).select("_metadata.file_path", "_metadata.file_size").distinct().groupBy().sum("file_size").first()[0]
    assert compact.joined(spark, [one, other], f"file://{tmp_path}/c", SPEC, target_bytes=size)["outputs"] == 1
    found = compact.joined(spark, [one, other], f"file://{tmp_path}/d", SPEC, target_bytes=size // 4)
    assert found["outputs"] == 4 and found["rows"] == 4 and not found["accepted"]


def test_why_a_part_failed(spark, tmp_path):
    path, root = source(spark, tmp_path), f"file://{tmp_path}/work"
    log = StateLog(spark, f"{root}/state")
    submit(log, registered(spark, path, "j", "b", "stage", SPEC, "x"), SPEC)
    Worker(log, SPEC, SELECT.replace("name", "nothing_like_it") + " " * 3000, root, role="inserter").run()
    errors = [r["error"] for r in log.get("j")]
    assert all("nothing_like_it" in e and "into db.t" in e and "select: SELECT id" in e and len(e) < 2100 for e in errors)


def test_settings_come_back(spark, tmp_path, monkeypatch):
    from loomstone.streaming import worker

    name, tries = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []

    def full(*args):
        tries.append(spark.conf.get(name))
        raise MemoryError("Java heap: OutOfMemoryError")

    monkeypatch.setattr(worker, "staged", full)
    before = spark.conf.get(name)
    with pytest.raises(MemoryError):
        Worker(None, SPEC, SELECT, str(tmp_path))._write(spark.range(1), "x")
    assert tries[1:] == [str(32 << 20), str(16 << 20)] and spark.conf.get(name) == before
