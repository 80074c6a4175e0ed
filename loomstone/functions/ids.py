"""Deterministic identifiers and storage keys, in Python and as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(*values: str) -> str:
    """First 16 hex digits of SHA-256 over the values, each followed by a zero byte."""
    return hashlib.sha256(b"".join(v.encode() + b"\0" for v in values)).hexdigest()[:16]


def short_hash_column(*values: Column) -> Column:
    """short_hash of string columns; null counts as an empty value."""
    zero = F.lit(bytes(1))
    parts = [x for v in values for x in (F.coalesce(v, F.lit("")).cast("binary"), zero)]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def part_id(disk: str, path: str, name: str, source: str, destination: str, select: str) -> str:
    return "part-" + short_hash(disk, path, name, source, destination, select)


def job_id(*values: str) -> str:
    """A job's id derived from what it does, so that submitting it again changes nothing."""
    return "job-" + short_hash(*values)


def compact_id(generation: int, inputs: list[str]) -> str:
    return "compact-" + short_hash(str(generation), *sorted(inputs))


def compact_id_column(generation: Column, inputs: Column) -> Column:
    """compact_id of a generation and an array of input ids, in any order."""
    zero = F.lit(bytes(1))
    head = F.concat(generation.cast("string").cast("binary"), zero)
    data = F.aggregate(F.array_sort(inputs), head, lambda a, x: F.concat(a, x.cast("binary"), zero))
    return F.concat(F.lit("compact-"), F.substring(F.sha2(data, 256), 1, 16))


def safe_segment(value: str) -> str:
    """The value if it may be one segment of a path; ValueError otherwise."""
    if not value or "/" in value or ".." in value:
        raise ValueError(f"{value!r} can't be a path segment")
    return value


def source_key(prefix: str, job: str, part: str) -> str:
    return "/".join(x for x in (prefix.strip("/"), "jobs", safe_segment(job), "source", safe_segment(part)) if x)


def finished_key(prefix: str, job: str, part: str) -> str:
    return "/".join(x for x in (prefix.strip("/"), "jobs", safe_segment(job), "finished", safe_segment(part)) if x)


def sibling_key(key: str, part: str) -> str:
    """The key beside another, for the output of a compaction."""
    head, _, _ = key.rstrip("/").rpartition("/")
    return f"{head}/{safe_segment(part)}" if head else safe_segment(part)


def job_prefix(job: str, key: str) -> str:
    """The part of a key up to and with jobs/<job>; ValueError if the key isn't of the job or the job's id isn't safe."""
    if not job.strip() or "/" in job or set(job) & set("*?[]{}"):
        raise ValueError(f"job id {job!r} can't be part of a prefix that is deleted")
    segments = key.strip("/").split("/")
    for i in range(len(segments) - 1):
        if segments[i] == "jobs" and segments[i + 1] == job:
            return "/".join(segments[: i + 2])
    raise ValueError(f"key {key!r} isn't one of job {job}")


def job_prefix_column(job: Column, key: Column) -> Column:
    """job_prefix as an expression; null where the key isn't of the job."""
    trimmed = F.trim(key, F.lit("/"))
    segments = F.split(trimmed, "/")
    found = F.filter(F.sequence(F.lit(1), F.size(segments) - 1), lambda i: (F.element_at(segments, i) == "jobs") & (F.element_at(segments, i + 1) == job))
    return F.when((F.size(segments) > 1) & (F.size(found) > 0), F.array_join(F.slice(segments, F.lit(1), F.get(found, 0) + 1), "/"))
