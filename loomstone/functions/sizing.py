"""Sizes derived from CPUs and memory, and the Spark settings they become."""

from __future__ import annotations

import os
from dataclasses import dataclass

MIB, GIB = 1 << 20, 1 << 30
# Fixed values of the sizing rules.
INSERT_MEMORY_PERCENT, INSERT_CPU_DIVISOR, INSERT_BLOCK_DIVISOR, INSERT_BLOCK_BYTES, ROW_BYTES = 70, 4, 6, 2 * GIB, 1024
INSERT_ROWS_LEAST, INSERT_ROWS_MOST = 8192, 8 * 1024 * 1024
MERGE_MEMORY_PERCENT, MERGE_DIVISOR, MERGE_POOL_LEAST, MERGE_CONCURRENCY_LEAST = 60, 8, 13, 2
MERGE_BYTES_LEAST, MERGE_BYTES_MOST, MERGE_ROWS_LEAST, MERGE_ROWS_MOST = 4 * MIB, 256 * MIB, 8192, 262144
TARGET_PART_BYTES = 150 * GIB


@dataclass(frozen=True)
class Limits:
    cpus: int
    memory: int

    def __post_init__(self):
        if self.cpus < 1 or self.memory < 1:
            raise ValueError("at least one CPU and some memory are needed")


def quota_cpus(text: str | None) -> int | None:
    """CPUs of a quota and a period, as in `150000 100000`: whole ones, at least one; None without a limit (`max`, -1 or no text)."""
    words = (text or "").split()
    if not words or words[0] == "max" or words[0].startswith("-"):
        return None
    return max(1, int(words[0]) // int(words[1] if len(words) > 1 else 100_000))


def cpuset_size(text: str | None) -> int | None:
    """CPUs of a list such as `0-3,8`; None without one."""
    if not (text or "").strip():
        return None
    found: set[int] = set()
    for run in text.strip().split(","):
        first, _, last = run.partition("-")
        found |= set(range(int(first), int(last or first) + 1))
    return len(found)


def memory_limit(text: str | None) -> int | None:
    """Bytes of a limit; None for `max` and for the number that stands for none."""
    word = (text or "").strip()
    return None if not word or word == "max" or int(word) >= 1 << 62 else int(word)


def limits(host_cpus: int, host_memory: int, quota: str | None = None, cpuset: str | None = None, memory: str | None = None) -> Limits:
    """The least of what the host has and what the texts of a control group allow."""
    cpus = [c for c in (host_cpus, quota_cpus(quota), cpuset_size(cpuset)) if c]
    return Limits(min(cpus), min(m for m in (host_memory, memory_limit(memory)) if m))


def detected(root: str = "/sys/fs/cgroup") -> Limits:
    """This process's CPUs and memory: the host's, or what its control group (of either version) leaves it."""

    def read(*names: str) -> str | None:
        for name in names:
            try:
                with open(f"{root}/{name}") as f:
                    return f.read()
            except OSError:
                continue
        return None

    quota = read("cpu.max")
    if quota is None and (old := read("cpu/cpu.cfs_quota_us")) is not None:
        quota = f"{old.strip()} {(read('cpu/cpu.cfs_period_us') or '100000').strip()}"
    host = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return limits(len(os.sched_getaffinity(0)), host, quota, read("cpuset.cpus.effective", "cpuset.cpus", "cpuset/cpuset.cpus"), read("memory.max", "memory/memory.limit_in_bytes"))


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def insert_settings(limits: Limits) -> dict[str, int]:
    """threads, memory, block_bytes and block_rows of a rewrite."""
    memory = limits.memory * INSERT_MEMORY_PERCENT // 100
    threads = max(1, min(limits.cpus // INSERT_CPU_DIVISOR, memory // (INSERT_BLOCK_DIVISOR * INSERT_BLOCK_BYTES)))
    block = memory // (INSERT_BLOCK_DIVISOR * threads)
    if not block:
        raise ValueError("too little memory for a block")
    return {"threads": threads, "memory": memory, "block_bytes": block, "block_rows": clamp(block // ROW_BYTES, INSERT_ROWS_LEAST, INSERT_ROWS_MOST)}


def merge_settings(limits: Limits) -> dict[str, int]:
    """block_bytes, block_rows, pool and concurrency of a merge."""
    block = limits.memory * MERGE_MEMORY_PERCENT // 100 // limits.cpus // MERGE_DIVISOR
    if not block:
        raise ValueError("too little memory for a block")
    block = clamp(block, MERGE_BYTES_LEAST, MERGE_BYTES_MOST) // MIB * MIB
    rows = clamp(block // ROW_BYTES, MERGE_ROWS_LEAST, MERGE_ROWS_MOST) // MERGE_ROWS_LEAST * MERGE_ROWS_LEAST
    return {"block_bytes": block, "block_rows": rows, "pool": max(MERGE_POOL_LEAST, limits.cpus), "concurrency": max(MERGE_CONCURRENCY_LEAST, limits.cpus)}


def transfer_workers(concurrency: int, total: int = 256) -> int:
    """Transfers that each of so many uploads may run."""
    return max(1, total // max(1, concurrency))


def spark_settings(limits: Limits) -> dict[str, str]:
    """The same as session settings: bytes a scan task reads, shuffle partitions, bytes that AQE joins into one."""
    own = insert_settings(limits)
    per_task = clamp(own["memory"] // (limits.cpus * 16), 16 * MIB, 256 * MIB)
    return {
        "spark.sql.files.maxPartitionBytes": str(per_task),
        "spark.sql.shuffle.partitions": str(max(8, limits.cpus * 3)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(16 * MIB, per_task // 2)),
    }


# Waits of a merge, in seconds.
def source_wait_cap(hard: float, compaction: bool, cap: float = 300.0) -> float:
    return min(hard, cap) if compaction else hard


def settle_wait(idle: float, cap: float) -> float:
    """A quarter of the idle wait, from one second to the cap; 0 without an idle wait."""
    return 0.0 if idle <= 0 else min(max(idle / 4, 1.0), cap)


def stale_after(window: float) -> float:
    return max(window, 300.0)


def heartbeat(stale: float) -> float:
    return min(max(stale / 20, 30.0), 300.0)


def wait_until_deadline(idle: float, now: float, deadline: float | None) -> float:
    return idle if deadline is None else max(0.0, min(idle, deadline - now))


def retry_threads(threads: int, tries: int) -> list[int]:
    """Threads of a rewrite's tries: half as many each time memory runs out, down to one."""
    out = [threads]
    while len(out) < tries and out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def retry_wait(attempt: int) -> int:
    """Seconds before the try after this one: 1, 2, 4, 8, then 10."""
    return 10 if attempt >= 5 else 1 << max(0, attempt - 1)
