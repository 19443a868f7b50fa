"""Running jobs: progress that others can watch, and a stop that others can ask for."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Tasks of the stages that run now; stages to come are not known before they start."""

    stages: int
    tasks: int
    done: int
    failed: int


class Run:
    """A group of jobs by name. ``cancel`` may be called from any thread, before, while or after jobs run.

    Tasks are interrupted where they can be, so a cancelled write leaves no committed output; a
    run that is cancelled stays so.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.cancelled = spark, name, threading.Event()

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(self.name)) if j is not None and j.status == "RUNNING"]
        stages = [s for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s is not None]
        total = lambda what: sum(getattr(s, what) for s in stages)
        return Progress(len(stages), total("numTasks"), total("numCompletedTasks"), total("numFailedTasks"))

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self.name)


class Cancelled(Exception):
    """The run was cancelled."""


@contextmanager
def run(spark: SparkSession, name: str, watch: Callable[[Progress], None] | None = None, every: float = 1.0) -> Iterator[Run]:
    """Jobs that this thread starts within the block belong to the run; ``watch`` is told of them every few seconds.

    Raises Cancelled at the end of a block that was cancelled, also where the
    cancelled job's own error would be raised. What ``watch`` raises ends the watching only.
    """
    context = spark.sparkContext
    kept = [context.getLocalProperty(k) for k in _PROPERTIES]
    this, over = Run(spark, name), threading.Event()
    context.setJobGroup(name, name, interruptOnCancel=True)

    def look():
        while not over.wait(every):
            watch(this.progress())

    watcher = threading.Thread(target=look, daemon=True) if watch else None
    if watcher:
        watcher.start()
    try:
        yield this
    except Exception as error:
        if this.cancelled.is_set():
            raise Cancelled(name) from error
        raise
    finally:
        over.set()
        if watcher:
            watcher.join()
        for key, value in zip(_PROPERTIES, kept, strict=True):
            context.setLocalProperty(key, value)
    if this.cancelled.is_set():
        raise Cancelled(name)


#: What a job group sets for a thread.
_PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
