import pytest

from loomstone.functions import ids
from loomstone.functions.sizing import GIB, MIB, Limits, heartbeat, insert_settings, merge_settings, settle_wait, source_wait_cap, stale_after, transfer_workers, wait_until_deadline
from loomstone.functions.text import duration_text
from loomstone.plans import ddl


@pytest.mark.parametrize(
    "statement, expected",
    [
        ("create table shop.orders (n Int32, note String) engine = ReplicatedSummingMergeTree('/a(b', concat('r', '1'), (n, f(n))) partition by n order by n  ;\n", "create table shop.orders (n Int32, note String) engine = SummingMergeTree((n, f(n))) partition by n order by n"),
        ("CREATE TABLE shop.log (n Int32) -- ENGINE = Log\nENGINE = ReplicatedMergeTree('/z', 'r') ORDER BY n", "CREATE TABLE shop.log (n Int32) -- ENGINE = Log\nENGINE = MergeTree ORDER BY n"),
        ("CREATE TABLE w (`ENGINE = x` Int8) ENGINE = AggregatingMergeTree ORDER BY tuple()", "CREATE TABLE w (`ENGINE = x` Int8) ENGINE = AggregatingMergeTree ORDER BY tuple()"),
    ],
)
def test_normalized(statement, expected):
    assert ddl.normalized(statement) == expected


@pytest.mark.parametrize("tail", ["", " ENGINE = Memory", " ENGINE = ReplicatedCollapsingMergeTree", " ENGINE = ReplicatedMergeTree('/alone')", " ENGINE = MergeTree("])
def test_rejected_engines(tail):
    with pytest.raises(ValueError):
        ddl.normalized(f"CREATE TABLE w (n Int32){tail} ORDER BY n")


def test_names():
    assert ddl.table_name("create  table `a``b` . `c.d` (n Int8)") == ("a`b", "c.d")
    assert ddl.table_name("CREATE TABLE IF NOT EXISTS readings (n Int8)") == ("", "readings")
    assert ddl.retargeted("CREATE TABLE IF NOT EXISTS readings (n Int8) ENGINE = MergeTree", "x", "y`z") == "CREATE TABLE IF NOT EXISTS `x`.`y``z` (n Int8) ENGINE = MergeTree"
    with pytest.raises(ValueError):
        ddl.destination("CREATE TABLE readings (n Int8)")
    assert ddl.split_arguments("[1, 2], g('x\\',', (y)), \"q,\"") == ["[1, 2]", "g('x\\',', (y))", '"q,"']
    assert ddl.literal("it's a\\b") == "'it''s a\\b'" and ddl.split_arguments("  ") == []
    for bad in ("g(x", "x)", "'x"):
        with pytest.raises(ValueError):
            ddl.split_arguments(bad)


def test_spec():
    spec = ddl.TableSpec.from_ddl("CREATE TABLE d.events (id UInt64, name LowCardinality(String), t Nullable(DateTime) CODEC(ZSTD(5)), m UInt8, p Decimal(10, 2), a Array(Int32)) ENGINE = ReplacingMergeTree(m) PARTITION BY toYYYYMM(t) ORDER BY (t, id) SETTINGS x = 1")
    assert [f.dataType.simpleString() for f in spec.schema] == ["decimal(20,0)", "string", "timestamp_ntz", "smallint", "decimal(10,2)", "array<int>"]
    assert spec.sort_by == ("t", "id") and spec.partition_by == "cast(year(t) * 100 + month(t) as bigint)" and spec.engine == "ReplacingMergeTree(m)"


def test_ids():
    import hashlib

    assert ids.short_hash("a", "b") == hashlib.sha256(b"a\0b\0").hexdigest()[:16]
    assert ids.compact_id(1, ["b", "a"]) == ids.compact_id(1, ["a", "b"]) != ids.compact_id(2, ["a", "b"])
    assert ids.job_prefix("job-1", "/x/jobs/job-1/source/p") == "x/jobs/job-1"
    for job, key in (("job-1", "x/jobs/job-10/source/p"), ("a/b", "x"), ("a*", "jobs/a*/x")):
        with pytest.raises(ValueError):
            ids.job_prefix(job, key)
    for bad in ("", "a/b", ".."):
        with pytest.raises(ValueError):
            ids.safe_segment(bad)
    assert ids.sibling_key("s/jobs/j/finished/p1", "c1") == "s/jobs/j/finished/c1"


@pytest.mark.parametrize("cpus", [1, 5, 12, 40, 100, 500])
@pytest.mark.parametrize("gib", [1, 9, 20, 77, 300, 5000])
def test_insert_threads(cpus, gib):
    """A quarter of the CPUs, but no more than 0.7 of the memory holds at six blocks of 2 GiB a thread."""
    threads = insert_settings(Limits(cpus, gib * GIB))["threads"]
    assert threads == max(1, min(cpus // 4, int(0.7 * gib / 12 + 1e-9)))


def test_sizing():
    merge = merge_settings(Limits(10, 44 * GIB))  # 0.6 of it over ten CPUs and eight blocks: 337.9 MiB, over the most
    assert merge == {"block_bytes": 256 * MIB, "block_rows": 262144, "pool": 13, "concurrency": 10}
    assert merge_settings(Limits(20, 10 * GIB))["block_bytes"] == 38 * MIB and merge_settings(Limits(20, 10 * GIB))["pool"] == 20
    with pytest.raises(ValueError):
        Limits(0, 1)
    assert (settle_wait(100, 20), settle_wait(10, 20), settle_wait(2, 20), settle_wait(-1, 20)) == (20, 2.5, 1, 0)
    assert (stale_after(10), stale_after(4000), heartbeat(500), heartbeat(3000), heartbeat(10**7)) == (300, 4000, 30, 150, 300)
    assert source_wait_cap(1000, True) == 300 and source_wait_cap(1000, False) == 1000 and source_wait_cap(20, True) == 20
    assert transfer_workers(6) == 42 and transfer_workers(300) == 1
    assert wait_until_deadline(50, 70, 100) == 30 and wait_until_deadline(50, 170, 100) == 0 and wait_until_deadline(50, 70, None) == 50
    assert [duration_text(s) for s in (7325, 0, 2.25, 119)] == ["2h2m5s", "0s", "2.25s", "1m59s"]


def test_limits_of_control_groups(tmp_path):
    from loomstone.functions import sizing

    assert [sizing.quota_cpus(x) for x in ("max 100000", "250000 100000\n", "10000 100000", "-1 100000", None)] == [None, 2, 1, None, None]
    assert [sizing.cpuset_size(x) for x in ("0-2,5,7-8\n", "3", " ", None)] == [6, 1, None, None]
    assert [sizing.memory_limit(x) for x in ("max", "1000", str((1 << 63) - 4096), None)] == [None, 1000, None, None]
    (tmp_path / "cpu.max").write_text("100000 100000\n")
    (tmp_path / "memory.max").write_text(f"{3 * GIB}\n")
    assert sizing.detected(str(tmp_path)) == Limits(1, 3 * GIB)
    (tmp_path / "cpu.max").unlink()
    (tmp_path / "cpu").mkdir()
    (tmp_path / "cpu" / "cpu.cfs_quota_us").write_text("-1\n")
    (tmp_path / "cpuset.cpus").write_text("0\n")
    assert sizing.detected(str(tmp_path)).cpus == 1 and sizing.detected(str(tmp_path / "nowhere")).cpus >= 1


def test_guard_names_the_reason(spark):
    from loomstone.plans.guard import NotRowLocal, check

    spark.range(5).createOrReplaceTempView("five")
    with pytest.raises(NotRowLocal, match="subquery"):
        check(spark.sql("SELECT id FROM five WHERE id IN (SELECT id FROM five)"))
    with pytest.raises(NotRowLocal, match="Window"):
        check(spark.sql("SELECT sum(id) OVER () AS s FROM five"))


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    from loomstone.plans.queries import QUERIES

    QUERIES["rewrite_events"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in plan and "Exchange" not in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
