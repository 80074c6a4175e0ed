"""Metrics as tables: counters by difference, gauges, histograms, stage times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A histogram's upper bounds in seconds, 1 to 2**15.
BUCKETS = [float(1 << k) for k in range(16)]


def deltas(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Samples with `delta`: how much a counter grew since the last sample of its key; never negative, first as it is."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return samples.withColumn("delta", F.greatest(F.col(value) - F.coalesce(before, F.lit(0)), F.lit(0)))


def histogram(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """keys, le, n: how many values are at most each bound; the last bound is infinite and counts all."""
    bounds = F.explode(F.lit([*BUCKETS, float("inf")])).alias("le")
    own = rows.select(*keys, value.alias("v")).groupBy(*keys, _bucket(F.col("v")).alias("b")).agg(F.count("*").alias("n"))
    spread = own.select(*keys, "n", "b", bounds).filter(F.col("b") <= F.col("le"))
    every = rows.select(*keys).distinct().select(*keys, F.explode(F.lit([*BUCKETS, float("inf")])).alias("le"))
    return every.join(spread.groupBy(*keys, "le").agg(F.sum("n").alias("n")), [*keys, "le"], "left").select(*keys, "le", F.coalesce("n", F.lit(0)).alias("n"))


def _bucket(v: Column) -> Column:
    """The smallest bound that holds a value, so that values are counted before they are spread."""
    return F.coalesce(F.get(F.filter(F.lit([*BUCKETS, float("inf")]), lambda b: v <= b), 0), F.lit(float("inf")))


def gauges(rows: DataFrame) -> DataFrame:
    """role, job_id, n and bytes of parts at work: rewrites and compactions."""
    role = F.when(F.col("status") == "IN_PROGRESS", "insert").when(F.col("status") == "COMPACTING", "compact")
    return rows.withColumn("role", role).filter("role is not null").groupBy("role", "job_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("destination_active_part_bytes"), F.lit(0)).alias("bytes"))


#: What a step from one status to another counts as.
STEPS = {
    ("READY", "IN_PROGRESS"): "rewrite_started", ("IN_PROGRESS", "COMPACT_READY"): "rewrite_completed", ("IN_PROGRESS", "FAILED"): "rewrite_failed",
    ("COMPACT_READY", "COMPACTING"): "compaction_started", ("COMPACTING", "SUPERSEDED"): "compaction_completed", ("COMPACTING", "COMPACT_READY"): "compaction_without_gain",
    ("COMPACTING", "FAILED"): "compaction_failed", ("IMPORTING", "IMPORTED"): "import_completed", ("IMPORTING", "FAILED"): "import_failed",
}


def events(versions: DataFrame) -> DataFrame:
    """job_id, event, n, seconds: what the steps between the versions of parts (job_id, part_id, version, status, at) count as, and how long they took.

    A part's versions are put in order within the part; a compaction counts once for each of its inputs.
    """
    w = Window.partitionBy("job_id", "part_id").orderBy("version")
    steps = versions.withColumn("was", F.lag("status").over(w)).withColumn("since", F.lag("at").over(w)).filter("was is not null")
    kinds = F.create_map(*[F.lit(x) for (a, b), name in STEPS.items() for x in (f"{a}>{b}", name)])
    found = steps.withColumn("event", kinds[F.concat("was", F.lit(">"), "status")]).filter("event is not null")
    seconds = F.greatest(F.unix_timestamp("at") - F.unix_timestamp("since"), F.lit(0))
    return found.groupBy("job_id", "event").agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))


class StageTimer:
    """How long each stage took: starting one ends the last; a stage that comes again adds up."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.began, self.stage, self.since, self.done = clock, clock(), None, clock(), {}

    def start(self, stage: str | None) -> None:
        now = self.clock()
        if self.stage is not None:
            self.done[self.stage] = self.done.get(self.stage, 0) + max(0, round((now - self.since) * 1000))
        self.stage, self.since = stage, now

    def finish(self) -> dict[str, int]:
        self.start(None)
        return dict(self.done)

    def progress(self) -> dict:
        """The attributes of a row that tell of it."""
        now = self.clock()
        return {
            "rewrite_stage": self.stage, "rewrite_stage_elapsed_ms": max(0, round((now - self.since) * 1000)) if self.stage else 0,
            "rewrite_total_elapsed_ms": max(0, round((now - self.began) * 1000)), "rewrite_stage_durations_ms": dict(self.done),
        }


class Gate:
    """Lets the first report through and then one an interval; none if the interval isn't above zero."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic):
        self.interval, self.clock, self.last = interval, clock, None

    def __call__(self) -> bool:
        if self.interval <= 0:
            return False
        now = self.clock()
        if self.last is not None and now - self.last < self.interval:
            return False
        self.last = now
        return True
