"""Workers: a driver loop over the state log, and a file stream that rewrites parts as they come.

One driver coordinates; the rows are rewritten by Spark's tasks. A part's output is a folder of its own that a
repeated try replaces, and the row in the log changes after it is whole, so a crash at any time costs a retry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions import ids
from loomstone.functions.config import settings
from loomstone.operators import compact, parts
from loomstone.operators.metrics import StageTimer
from loomstone.operators.rewrite import PARTITION, read_staged, rewritten, staged
from loomstone.operators.state import StateLog, new_row, timestamp
from loomstone.plans.ddl import TableSpec

ROLES = ("all", "inserter", "compactor")


def check_role(role: str, compaction: bool) -> str:
    if role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    if role == "compactor" and not compaction:
        raise ValueError("a compactor without compaction has nothing to do")
    return role


@dataclass
class Worker:
    """Takes READY parts, `slots` at a time, then joins COMPACT_READY ones, then makes what can't be joined FINISHED.

    Several workers, in one driver or many, may share a log: a part is claimed by a commit that only one can make.
    """

    log: StateLog
    spec: TableSpec
    select: str | Callable[[DataFrame], DataFrame]
    root: str
    name: str = "worker-1"
    role: str = "all"
    compaction: bool = True
    window: int = 0
    allow_empty: bool = False
    tries: int = 3
    slots: int = 4
    options: compact.Options = field(default_factory=compact.Options)

    def __post_init__(self):
        check_role(self.role, self.compaction)

    def run(self, most: int | None = None) -> list[str]:
        """Work until there is none, or for `most` steps if that is given; returns what was done."""
        done: list[str] = []
        while most is None or len(done) < most:
            step = self.step()
            if step is None:
                break
            done += step.split("\n")
        return done

    def step(self) -> str | None:
        """One unit of work: rewriting comes first."""
        if self.role != "compactor" and (found := self.rewrite_next()):
            return found
        if self.role != "inserter":
            if self.compaction and (found := self.compact_next()):
                return found
            return self.finalize()
        return None

    def rewrite_next(self) -> str | None:
        """Claim up to `slots` parts in one commit, rewrite them side by side, and tell of all in one commit."""
        from concurrent.futures import ThreadPoolExecutor

        from loomstone.operators.state import transition

        claimed = self.log.claim(self.name, self.slots, splay)
        if not claimed:
            return None
        try:
            with ThreadPoolExecutor(self.slots) as pool:
                found = list(pool.map(self._rewritten, claimed))
        except BaseException:  # the worker is told to stop: others may take the parts
            for r in claimed:
                self.log.apply(r["job_id"], [r["part_id"]], "release", worker=self.name)
            raise
        changed, done = [], []
        for r, (event, changes) in zip(claimed, found):
            row = self.log.get(r["job_id"], [r["part_id"]])[0]
            changed.append(transition(row, event, timestamp(), self.name, **changes) | {"version": row["version"]})
            done.append(f"{'failed' if event == 'fail' else 'rewrote'} {r['part_id']}")
        self.log.commit(changed)
        return "\n".join(done)

    def _rewritten(self, row: dict) -> tuple[str, dict]:
        """The event that a part's rewrite ends in, and what it changes."""
        timer = StageTimer()
        try:
            timer.start("insert_select")
            spark = self.log.spark
            path = f"{self.root}/{row['finished_key']}"
            self._write(rewritten(spark.read.parquet(row["source_key"]), self.select, self.spec), path)
            timer.start("measure_destination_parts")
            measured = measure(spark, path)
            counts = {r["partition_id"]: r["part_count"] for r in measured}
            return "compact_ready", {
                "destination_active_part_count": sum(counts.values()), "destination_active_part_rows": sum(r["part_rows"] for r in measured),
                "destination_active_part_bytes": sum(r["part_bytes"] for r in measured), "destination_active_partition_counts": counts,
                "rewrite_stage_durations_ms": timer.finish(), "written_rows": sum(r["part_rows"] for r in measured),
            }
        except Exception as e:
            return "fail", {"error": diagnosis(e, self.select, self.spec)}

    def _write(self, out: DataFrame, path: str) -> None:
        """Write a part; if its tasks run out of memory, again with tasks of half the size."""
        size = 64 << 20
        for k in range(self.tries):
            try:
                if k:
                    with settings(out.sparkSession, spark__sql__adaptive__advisoryPartitionSizeInBytes=str(max(1 << 20, size >> k))):
                        staged(out, self.spec, path, self.allow_empty)
                else:
                    staged(out, self.spec, path, self.allow_empty)
                return
            except Exception as e:
                if k + 1 == self.tries or not out_of_memory(str(e)):
                    raise

    def compact_next(self) -> str | None:
        """Join the next batch of any job, all or nothing."""
        rows = self.log.view()
        if rows.filter("status = 'COMPACT_READY'").isEmpty():
            return None
        plan = compact.batches(rows, self.options).orderBy(*compact.GROUP, "seq").collect()
        for job in dict.fromkeys(r["job_id"] for r in plan):
            chosen = [r["part_id"] for r in plan if r["job_id"] == job]
            inputs = self.log.get(job, chosen)
            generation = max(r["compact_generation"] or 0 for r in inputs) + 1
            output = ids.compact_id(generation, chosen)
            self.log.apply(job, chosen, "claim_compaction", worker=self.name, compact_output_part_id=output)
            key = ids.sibling_key(inputs[0]["finished_key"], output)
            try:
                result = compact.joined(self.log.spark, [f"{self.root}/{r['finished_key']}" for r in inputs], f"{self.root}/{key}", self.spec)
            except BaseException:
                self.log.apply(job, chosen, "release_compaction", worker=self.name)
                raise
            if not result["accepted"]:
                self.log.apply(job, chosen, "release_compaction", worker=self.name)
                continue
            self._supersede(job, chosen, output, key, generation, inputs)
            return f"joined {len(chosen)} parts as {output}"
        return None

    def _supersede(self, job: str, chosen: list[str], output: str, key: str, generation: int, inputs: list[dict]) -> None:
        """The new row and all superseded ones in one commit."""
        from loomstone.operators.state import transition

        now = timestamp()
        held = self.log.get(job, chosen)
        # who asked to finish the running compaction wants its output as it is, without further waiting
        ended = {"status": "FINISHED", "finished_at": now} if any((r["compact_finalize_requested_at"] or "").strip() for r in held) else {"status": "COMPACT_READY"}
        measured = measure(self.log.spark, f"{self.root}/{key}")
        counts = {r["partition_id"]: r["part_count"] for r in measured}
        ready = max((r["compact_ready_at"] or now for r in inputs), default=now)
        made = new_row(
            job, output, inputs[0]["bucket"], key, key, now, **ended, compact_generation=generation, compact_input_part_ids=sorted(chosen),
            destination_database=self.spec.database, destination_table=self.spec.table, destination_schema=inputs[0]["destination_schema"], compact_ready_at=ready,
            destination_active_part_count=sum(counts.values()), destination_active_part_rows=sum(r["part_rows"] for r in measured),
            destination_active_part_bytes=sum(r["part_bytes"] for r in measured), destination_active_partition_counts=counts,
        )
        gone = [transition(r, "supersede", now, self.name, superseded_by=output) | {"version": r["version"]} for r in held]
        self.log.commit([made, *gone])

    def finalize(self) -> str | None:
        """Make FINISHED what waits no longer."""
        rows = self.log.view()
        times = ["compact_ready_at", "progress_updated_at", "updated_at"]
        timed = rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in times else F.col(c) for c in rows.columns])
        found = compact.finalizable(timed, self.window, F.lit(timestamp()).cast("timestamp_ntz")).collect()
        for job in dict.fromkeys(r["job_id"] for r in found):
            self.log.apply(job, [r["part_id"] for r in found if r["job_id"] == job], "finalize")
        return f"finished {len(found)} parts" if found else None


def measure(spark: SparkSession, path: str) -> list:
    """partition_id, part_count, part_rows, part_bytes of a staged folder: one row a destination partition."""
    files = spark.read.parquet(path).groupBy(F.col(PARTITION).cast("string").alias("partition_id"), F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("part_rows"), F.max("_metadata.file_size").alias("part_bytes"))
    return parts.by_partition(files).orderBy("partition_id").collect()


def diagnosis(error: Exception, select, spec: TableSpec, most: int = 1000) -> str:
    """An error's text with where it was to go and the select, each cut to a length that a row can hold."""
    told = select if isinstance(select, str) else getattr(select, "__name__", "a function")
    return f"{str(error)[:most]}\ninto {spec.database}.{spec.table}\nselect: {told[:most]}"


def splay(window_ms: int = 250) -> float:
    """A random wait in seconds before a claim, so that workers that start together don't claim together."""
    import random

    return random.randint(0, window_ms) / 1000 if window_ms > 0 else 0.0


def out_of_memory(message: str) -> bool:
    text = message.lower()
    return any(m in text for m in ("outofmemory", "out of memory", "memory limit", "unable to acquire", "cannot allocate memory", "exit code 137"))


def stream(spark: SparkSession, source: str, schema: T.StructType, select, spec: TableSpec, target: str, checkpoint: str, files_per_batch: int = 1):
    """A stream of a folder's files, each batch rewritten into the target; ends when all files there are done.

    A restart on the same checkpoint takes only new files. A batch goes to a folder named by its number, so that
    a batch that is run again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        staged(rewritten(batch, select, spec), spec, f"{target}/batch={number}", allow_empty=True)

    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed(spark: SparkSession, target: str, spec: TableSpec) -> DataFrame:
    """What the stream has written."""
    schema = T.StructType([*spec.schema.fields, T.StructField(PARTITION, T.StringType()), T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(target).select(*spec.schema.names)


__all__ = ["Worker", "check_role", "diagnosis", "measure", "out_of_memory", "read_staged", "splay", "stream", "streamed"]
