"""Long work with progress and a way to stop it: jobs of one group, run beside a watch.

What is stopped leaves what its sinks leave of a run that breaks off: an index its last snapshot, an export nothing or a
stage that can be published to the end.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Jobs that have begun, and the tasks of their stages so far known."""

    jobs: int
    done: int
    tasks: int
    failed: int


class Cancelled(RuntimeError):
    pass


class Run:
    """A function in a thread of its own, whose Spark jobs are one group."""

    def __init__(self, spark: SparkSession, f: Callable[[], Any], name: str = "work"):
        self.sc, self.name, self.group = spark.sparkContext, name, f"{name}-{uuid.uuid4().hex}"
        self._result: Any = None
        self._error: BaseException | None = None
        self._stop = threading.Event()

        def work() -> None:
            self.sc.setJobGroup(self.group, name, interruptOnCancel=True)
            try:
                self._result = f()
            except BaseException as e:  # handed to whoever waits
                self._error = e

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()

    def progress(self) -> Progress:
        tracker, jobs, done, tasks, failed = self.sc.statusTracker(), 0, 0, 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            jobs += 1
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else []):
                if s := tracker.getStageInfo(stage):
                    done, tasks, failed = done + s.numCompletedTasks, tasks + s.numTasks, failed + s.numFailedTasks
        return Progress(jobs, done, tasks, failed)

    def cancel(self) -> None:
        """Stop its jobs, those running and those that it would still begin."""
        self._stop.set()
        while self._thread.is_alive():
            self.sc.cancelJobGroupAndFutureJobs(self.group) if hasattr(self.sc, "cancelJobGroupAndFutureJobs") else self.sc.cancelJobGroup(self.group)
            self._thread.join(0.2)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has ended."""
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def result(self) -> Any:
        self.wait()
        if self._stop.is_set():
            raise Cancelled(self.name) from self._error
        if self._error is not None:
            raise self._error
        return self._result


def watched(spark: SparkSession, f: Callable[[], Any], name: str, show: Callable[[Progress], None], every: float = 1.0) -> Any:
    """The function's result; its progress is shown as it goes on, and an interrupt from the keyboard stops it."""
    run, last = Run(spark, f, name), None
    try:
        while not run.wait(every):
            if (now := run.progress()) != last:
                show(now)
                last = now
    except KeyboardInterrupt:
        run.cancel()
    return run.result()
