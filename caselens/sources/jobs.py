"""Work in the background of a session: started under a tag, asked about, cancelled, forgotten."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from threading import Event, Lock

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from caselens.operators import fusion
from caselens.operators.ingest import Mapping, Tables, ingest

from .scratch import held
from .store import Store


CANCEL_TRIES = 150


class NotAccepted(ValueError):
    """The tables of a submission didn't pass the gate."""


@dataclass(frozen=True)
class Status:
    state: str  # running, done, error or cancelled
    cse_id: str
    error: str | None = None
    tasks_done: int = 0  # of the stages that the tracker still knows
    tasks: int = 0


@dataclass
class _Job:
    cse_id: str
    thread: InheritableThread
    ended: Event
    state: str = "running"
    error: str | None = None


class Jobs:
    """Jobs of one session. Each runs in a thread of its own, whose Spark jobs carry the job's id as their tag: by it the
    tracker says how far they are, and by it they are cancelled. Any number run at once and share the cluster."""

    def __init__(self, spark: SparkSession):
        self.spark, self._jobs, self._lock = spark, {}, Lock()

    def start(self, cse_id: str, work: Callable[[], object]) -> str:
        """Run `work` and return the job's id at once. What it raises becomes its error."""
        job_id, ended = f"job-{uuid.uuid4().hex}", Event()

        def run() -> None:
            self.spark.sparkContext.addJobTag(job_id)
            try:
                work()
                self._end(job_id, "done", None)
            except Exception as e:  # noqa: BLE001  whatever it is, the one who asks is told
                self._end(job_id, "error", str(e) or type(e).__name__)
            finally:
                ended.set()

        thread = InheritableThread(target=run, daemon=True)
        with self._lock:
            self._jobs[job_id] = _Job(cse_id, thread, ended)
        thread.start()
        return job_id

    def _end(self, job_id: str, state: str, error: str | None) -> None:
        with self._lock:
            job = self._jobs.get(job_id)
            if job is not None and job.state == "running":
                job.state, job.error = state, error

    def ingest(self, tables: Callable[[], Tables], cse_id: str, store: Store, batch_id: str, submitted_at: str, overrides: Mapping | None = None) -> str:
        """Read a submission, pass it through the gate, fuse it and store it as a batch."""

        def work() -> None:
            got = ingest(tables(), cse_id, overrides)
            if got.log is None:
                raise NotAccepted("; ".join(got.gate.errors) or "no data")
            with got.log.held() as log:
                store.submit(log, held(fusion.fuse(log, got.low_confidence).concerns), batch_id, submitted_at, got.low_confidence)

        return self.start(cse_id, work)

    def status(self, job_id: str) -> Status:
        """An unknown job is an error, as one that was forgotten."""
        with self._lock:
            job = self._jobs.get(job_id)
        if job is None:
            return Status("error", "?", "unknown job")
        done, tasks = self._progress(job_id)
        return Status(job.state, job.cse_id, job.error, done, tasks)

    def _progress(self, job_id: str) -> tuple[int, int]:
        tracker = self.spark.sparkContext._jsc.sc().statusTracker()
        done = tasks = 0
        for job in tracker.getJobIdsForTag(job_id):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else []:
                of = tracker.getStageInfo(stage)
                if of.isDefined():
                    done, tasks = done + of.get().numCompletedTasks(), tasks + of.get().numTasks()
        return done, tasks

    def wait(self, job_id: str, seconds: float | None = None) -> Status:
        with self._lock:
            job = self._jobs.get(job_id)
        if job is not None:
            job.ended.wait(seconds)
        return self.status(job_id)

    def cancel(self, job_id: str) -> None:
        """Stop the Spark jobs under its tag, whose error ends the work, until it has ended."""
        self._end(job_id, "cancelled", None)
        with self._lock:
            job = self._jobs.get(job_id)
        for _ in range(CANCEL_TRIES if job is not None else 0):
            self.spark.sparkContext.cancelJobsWithTag(job_id)
            if job.ended.wait(0.2):  # it may have been between two Spark jobs
                break

    def forget(self, job_id: str) -> None:
        with self._lock:
            self._jobs.pop(job_id, None)
