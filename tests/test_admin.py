from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pytest

from loomstone.functions import config
from loomstone.operators.admin import Admin, Refused, summary_text
from loomstone.operators.state import StateLog, new_row, timestamp, transition

NOW = datetime.now(timezone.utc)


@pytest.fixture
def admin(spark, tmp_path):
    log = StateLog(spark, f"file://{tmp_path}/log")
    old = timestamp(NOW - timedelta(hours=1))
    make = lambda n, s, **more: new_row("j", n, "b", f"x/jobs/j/source/{n}", f"x/jobs/j/finished/{n}", old, **({"status": s, "destination_database": "d", "destination_table": "t", "destination_schema": "s"} | more))
    log.commit([
        make("a", "FAILED", error="boom"), make("b", "FINISHED"), make("c", "IN_PROGRESS", worker_id="w", progress_updated_at=old, rewrite_stage="insert_select"),
        make("d", "SUPERSEDED", superseded_by="out"), make("e", "SUPERSEDED", superseded_by="out"),
        make("out", "COMPACT_READY", compact_generation=1, compact_input_part_ids=["d", "e"], destination_active_part_count=1, destination_active_partition_counts={"1": 1}),
    ])
    return Admin(log)


def status(admin):
    return {r["part_id"]: r["status"] for r in admin.log.get("j")}


def test_reports(admin):
    assert admin.list_jobs() == ["j"]
    found = admin.job_status("j", parts=True)
    assert found["summary"]["status"] == "FAILED" and found["failed"] == [("a", "boom")] and found["stages"] == [("insert_select", 1)] and found["input_parts"] == 5
    assert [p["part_id"] for p in found["parts"]] == ["a", "b", "c", "out"] and "failed a: boom" in summary_text(found)
    with pytest.raises(Refused):
        admin.job_status("none")


def test_retry(admin):
    with pytest.raises(Refused):
        admin.retry("j", all_failed=True, part="a")
    with pytest.raises(Refused):
        admin.retry("j", part="b")
    assert admin.retry("j", all_failed=True) == ["a"] and status(admin)["a"] == "READY"
    assert admin.retry("j", stale_seconds=300) == ["c"] and status(admin)["c"] == "READY"
    assert admin.retry("j", part="b", force=True) == ["b"] and status(admin)["b"] == "READY"


def test_set_and_delete(admin):
    with pytest.raises(Refused):
        admin.set_state("j", "READY", parts=["a"])
    with pytest.raises(Refused):
        admin.set_state("j", "IMPORTED", parts=["a"], force=True)
    assert admin.set_state("j", "FINISHED", from_status="FAILED", force=True) == ["a"] and status(admin)["a"] == "FINISHED"
    assert admin.delete_parts("j", from_status="SUPERSEDED", force=True) == ["d", "e"] and "d" not in status(admin)
    deleted = []
    assert admin.delete_job("j", lambda b, p: deleted.append((b, p)), force=True)["deleted"] == ["a", "b", "c", "out"]
    assert deleted == [("b", "x/jobs/j")] and admin.list_jobs() == []


def test_reset(admin):
    admin.set_state("j", "READY", parts=["c"], force=True)
    out = admin.reset("j", compaction=True, force=True)
    assert out["deleted"] == ["out"] and out["prefixes"] == [("b", "x/jobs/j/finished/out")]
    assert set(status(admin).values()) == {"COMPACT_READY"}
    row = admin.log.get("j", ["d"])[0]
    admin.log.commit([transition(transition(row, "finalize", timestamp()), "import", timestamp()) | {"version": row["version"]}])
    with pytest.raises(Refused, match="import"):
        admin.reset("j", compaction=False, force=True)


def test_compaction_commands(admin):
    assert admin.finalize_jobs(0) == {}
    admin.set_state("j", "FINISHED", parts=["a", "c"], force=True)
    assert admin.finalize_jobs(0) == {"j": ["out"]}
    assert admin.reset_compact_timer("j") == ["a", "b", "c", "d", "e", "out"]
    admin.set_state("j", "COMPACT_READY", parts=["a"], force=True)
    admin.log.apply("j", ["a"], "claim_compaction", worker="w", compact_output_part_id="o2")
    assert admin.finalize_compaction("j", output="o2", force=True) == ["a"] and admin.log.get("j", ["a"])[0]["compact_finalize_requested_at"]


def test_config(spark):
    @dataclass
    class Options:
        role: str = "all"
        min_parts: int = 2
        once: bool = False

    flags, rest = config.parse_flags(["worker", "--min-parts", "3", "--unknown", "x", "--once"], {"role", "min_parts", "once"})
    assert rest == ["worker"] and config.resolve(Options, flags, {"min-parts": 9, "role": "inserter"}, {"role": "compactor", "worker": {}}) == Options("inserter", 3, True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with config.settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
