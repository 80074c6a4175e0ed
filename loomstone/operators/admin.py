"""Administration of jobs over the state log: what to retry, set, finish, reset or delete, and the reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.ids import job_prefix

from . import compact, selection, state, status
from .state import StateLog, timestamp


class Refused(ValueError):
    """A change that isn't safe, or that needs to be forced."""


def one_of(**given) -> str:
    """The name of the one selector that is given; more or none is an error."""
    names = [k for k, v in given.items() if v]
    if len(names) != 1:
        raise Refused(f"give exactly one of {', '.join(given)}")
    return names[0]


@dataclass(frozen=True)
class Admin:
    """Commands on one log. Each writes all its changes in one commit."""

    log: StateLog

    def list_jobs(self) -> list[str]:
        return [r["job_id"] for r in state.distinct_jobs(self.log.view()).collect()]

    def job_status(self, job: str, parts: bool = False, all_parts: bool = False) -> dict:
        """The job's summary, counts by status, stages, failures, and with parts its visible rows."""
        rows = self._rows(job)
        out = {"summary": status.summary(rows).first(), "counts": {r["status"]: r["n"] for r in status.status_counts(rows).collect()}}
        out["stages"] = [(r["stage"], r["n"]) for r in status.stage_histogram(rows).orderBy("place").collect()]
        out["failed"] = [(r["part_id"], r["error"]) for r in status.failed_parts(rows).collect()]
        out["input_parts"], out["output_parts"] = (status.input_parts(rows).first() or {"input_parts": 0})["input_parts"], (status.current_output(rows).first() or {"output_parts": 0})["output_parts"]
        if parts:
            out["parts"] = status.visible(rows, all_parts).select("part_id", "status", "worker_id", "attempts", "updated_at", "error").orderBy("part_id").collect()
        return out

    def retry(self, job: str, all_failed: bool = False, part: str | None = None, stale_seconds: int = 0, in_progress: bool = False, force: bool = False) -> list[str]:
        """Put parts back to work: failed ones, one by id, or those whose progress is long past. Returns their ids."""
        how = one_of(all_failed=all_failed, part=part, stale_seconds=stale_seconds)
        if force and (stale_seconds or in_progress):
            raise Refused("force goes with neither stale nor in-progress")
        rows = self._rows(job)
        if how == "stale_seconds":
            times = rows.withColumn("progress_updated_at", F.col("progress_updated_at").cast("timestamp"))
            chosen = selection.stale_retry(times, F.lit(timestamp()).cast("timestamp"), stale_seconds)
        elif how == "part":
            own = selection.by_ids(rows, [part])
            chosen = selection.retry(own, in_progress, force)
            if chosen.isEmpty():
                raise Refused(f"part {part} is {own.first()['status']}, which can't be retried")
        else:
            chosen = selection.retry(rows, in_progress, force)
        return self._change(job, chosen, lambda r: ("force_retry" if force else "retry" if r["status"] == "FAILED" else "retry_in_progress", {}))

    def set_state(self, job: str, to: str, parts: list[str] = (), from_status: str | None = None, force: bool = False) -> list[str]:
        """Set rows to READY, COMPACT_READY or FINISHED."""
        self._forced(force)
        one_of(parts=parts, from_status=from_status)
        if to not in state.SETTABLE:
            raise Refused(f"a part can't be set to {to}")
        rows = self._rows(job)
        chosen = selection.by_ids(rows, list(parts)) if parts else selection.by_status(rows, from_status)
        return self._change(job, chosen, lambda r: ("set", {"status": to}))

    def finalize_compaction(self, job: str, all_running: bool = False, parts: list[str] = (), output: str | None = None, force: bool = False) -> list[str]:
        """Ask running compactions to end their wait."""
        self._forced(force)
        one_of(all_running=all_running, parts=parts, output=output)
        rows = self._rows(job)
        chosen = selection.by_ids(rows, list(parts)) if parts else selection.compacting(rows, output)
        return self._change(job, chosen, lambda r: ("request_finalize", {}))

    def reset_compact_timer(self, job: str) -> list[str]:
        """Begin the compact window anew for every row of the job, whatever its status."""
        return self._change(job, self._rows(job), lambda r: ("reset_compact_timer", {}))

    def finalize_jobs(self, window_seconds: int) -> dict[str, list[str]]:
        """Make FINISHED what waits no longer, in all jobs."""
        rows = self.log.view()
        times = ["compact_ready_at", "progress_updated_at", "updated_at"]
        timed = rows.select(*[F.col(c).cast("timestamp").alias(c) if c in times else F.col(c) for c in rows.columns])
        found: dict[str, list[str]] = {}
        for r in compact.finalizable(timed, window_seconds, F.lit(timestamp()).cast("timestamp")).collect():
            found.setdefault(r["job_id"], []).append(r["part_id"])
        for job, parts in found.items():
            self.log.apply(job, parts, "finalize")
        return found

    def reset(self, job: str, compaction: bool, force: bool = False) -> dict:
        """Undo a job's compactions, or its rewrites too: outputs' rows go, originals go back. Returns plan and data folders to delete."""
        self._forced(force)
        rows = self._rows(job)
        problems = selection.reset_blockers(rows, compaction).unionAll(selection.lineage_problems(rows)).limit(20).collect()
        cyclic = selection.lineage_cycles(selection.lineage_edges(rows)).limit(1).collect()
        if problems or cyclic:
            raise Refused("; ".join(sorted({f"{p['part_id']}: {p['problem']}" for p in problems})) or f"lineage of {cyclic[0]['output']} is a cycle")
        prefixes = [(r["bucket"], r["prefix"]) for r in selection.reset_prefixes(rows, compaction).collect()]
        plan = selection.reset_plan(rows, compaction).collect()
        back = [r["part_id"] for r in plan if r["action"] == "reset"]
        gone = [r["part_id"] for r in plan if r["action"] == "delete"]
        now, target = timestamp(), "COMPACT_READY" if compaction else "READY"
        held = {r["part_id"]: r for r in self.log.get(job, back + gone)}
        changed = [state.transition(held[p], "reset", now, status=target) | {"version": held[p]["version"]} for p in back]
        self.log.commit([*changed, *(held[p] | {"deleted": True} for p in gone)])
        return {"reset": back, "deleted": gone, "prefixes": prefixes}

    def delete_parts(self, job: str, all_parts: bool = False, parts: list[str] = (), from_status: str | None = None, force: bool = False) -> list[str]:
        """Delete rows; their data stay."""
        self._forced(force)
        one_of(all_parts=all_parts, parts=parts, from_status=from_status)
        rows = self._rows(job)
        chosen = rows if all_parts else selection.by_ids(rows, list(parts)) if parts else selection.by_status(rows, from_status)
        ids = [r["part_id"] for r in chosen.select("part_id").orderBy("part_id").collect()]
        if ids:
            self.log.delete(job, ids)
        return ids

    def delete_job(self, job: str, delete_folder, force: bool = False) -> dict:
        """Delete a job's folders by the function given, then its rows: a crash between leaves rows that can be deleted again."""
        self._forced(force)
        rows = self.log.get(job)
        prefixes = sorted({(r["bucket"], job_prefix(job, r["finished_key"])) for r in rows})
        for bucket, prefix in prefixes:
            delete_folder(bucket, prefix)
        return {"prefixes": prefixes, "deleted": self.delete_parts(job, all_parts=True, force=True)}

    def _rows(self, job: str) -> DataFrame:
        rows = self.log.view().filter(F.col("job_id") == job)
        if rows.isEmpty():
            raise Refused(f"job {job} has no rows")
        return rows

    def _forced(self, force: bool) -> None:
        if not force:
            raise Refused("this must be forced")

    def _change(self, job: str, chosen: DataFrame, event) -> list[str]:
        ids = [r["part_id"] for r in chosen.select("part_id").orderBy("part_id").collect()]
        now, out = timestamp(), []
        for r in self.log.get(job, ids) if ids else ():
            name, changes = event(r)
            out.append(state.transition(r, name, now, r["worker_id"], **changes) | {"version": r["version"]})
        self.log.commit(out)
        return ids


def summary_text(found: dict) -> list[str]:
    """A job's status as lines, in a fixed order."""
    s = found["summary"]
    lines = [f"{k}: {s[k]}" for k in ("job_id", "status", "total", "rewrite_completed", "rewrite_percent", "import_completed", "import_percent")]
    lines += [f"{k.lower()}: {found['counts'][k]}" for k in state.STATUSES]
    lines += [f"input_parts: {found['input_parts']}", f"output_parts: {found['output_parts']}"]
    lines += [f"stage {name}: {n}" for name, n in found["stages"]]
    return lines + [f"failed {part}: {error}" for part, error in found["failed"]]
